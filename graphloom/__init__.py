"""Spark-native engine for drafting, validating, repairing and scoring RDF-style graphs."""
