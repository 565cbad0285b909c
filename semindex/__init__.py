"""semindex: semantic search, incremental indexing and corpus preparation on PySpark."""
