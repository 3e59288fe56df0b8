"""Sources and sinks: array files, metric folders, run tables and saved states."""
