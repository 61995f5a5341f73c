"""Spark-native analytics over pools of candidate protein designs and peptide libraries."""
