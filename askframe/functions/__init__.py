"""Plain functions on words, identifiers and literals; no Spark."""
