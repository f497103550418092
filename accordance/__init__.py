"""Agreement analytics over semi-structured documents, on Spark."""
