"""Relational operators: predicates, noise learning, chunking, embedding, retrieval, jobs."""
