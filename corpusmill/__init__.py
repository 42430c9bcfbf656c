"""corpusmill: Spark-native preparation, auditing and querying of large keyed corpora."""
