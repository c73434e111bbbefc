"""Relational building blocks: chunking, matching, ranking, fusion, facets, grouping."""
