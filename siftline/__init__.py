"""siftline: a Spark-native engine for cleaning, normalising and deduplicating record files."""
