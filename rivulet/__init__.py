"""rivulet: article-stream analytics on PySpark (URL identity, layered dedup, extraction, feeds, queues, search)."""
