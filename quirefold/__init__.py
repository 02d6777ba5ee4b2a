"""Document question-answering analytics on Spark: blocks, retrieval, context packing, threads, exports."""
