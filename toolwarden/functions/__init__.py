"""Column helpers shared by the operators (all native Spark expressions)."""
