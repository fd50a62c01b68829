"""Spark-native analysis of DNA sequence data: k-mers, graphs, alignments, clusters and reports."""
