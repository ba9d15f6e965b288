"""Sources and sinks: messages, policy documents, audit log, reports, metrics."""
