"""Relational operators: k-mers, dictionaries, seed joins, thinning, extension, fragments, chunking."""
