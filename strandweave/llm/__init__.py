"""Operators for large training-data collections, and their registered queries."""

from . import contamination, grid_clusters, packing, set_overlap, subjects, term_counts, top_terms

MODULES = [term_counts, grid_clusters, set_overlap, top_terms, packing, contamination, subjects]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
