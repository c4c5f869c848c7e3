"""dnstide: query-log statistics and corpus preparation as PySpark jobs."""
