"""Operators for large training corpora, each a Spark job over a table of documents, pages or vectors."""
