"""Index, search and prepare collections of documents and source files on Spark."""
