"""Relational operators: chunking, resolution, graph, retrieval, answering."""
