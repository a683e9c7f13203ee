"""Table scans with declared schemas, and the JSON and CSV sinks."""
