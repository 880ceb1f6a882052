"""Context retrieval, ranking and packing over corpora of files, on Spark."""
