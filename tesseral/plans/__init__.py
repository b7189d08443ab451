"""SQL text front end: script splitting, rewrites to Spark SQL, error names."""
