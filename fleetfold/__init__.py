"""fleetfold: keyed telemetry analytics as DataFrame and Structured Streaming operators."""
