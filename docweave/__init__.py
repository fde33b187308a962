"""Document analytics and retrieval on Spark: cleaning, chunking, indexing, retrieval, citations and evaluation as DataFrame plans."""
