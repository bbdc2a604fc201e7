"""Road graph: extraction, partitions, shortest paths, binary formats."""
