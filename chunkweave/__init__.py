"""chunkweave: graph-expansion retrieval and corpus processing as Spark DataFrame operators."""
