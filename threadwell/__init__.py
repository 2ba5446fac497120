"""Search and analytics over transcripts and documents, expressed as Spark DataFrame operations."""
