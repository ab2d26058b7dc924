"""DataFrame operators: line grammar, deduplication, chunk reports."""
