"""Sources and sinks: CSV with typed inference, file listings, rule and model files."""
