"""quillstream: retrieval, session and log analytics as Spark DataFrame jobs."""
