"""Knowledge-corpus analytics on Spark: chunks, hybrid retrieval, graph, evaluation."""
