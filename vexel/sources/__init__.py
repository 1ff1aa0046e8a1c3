"""Files in and out: tables, texts with metadata, vectors, logs and any file system that Spark reads."""
