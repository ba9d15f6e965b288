"""DataFrame operators: detection, scoring, policy, responses, verdicts, metrics."""
