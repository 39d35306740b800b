"""Gridscribe: a Spark-native engine that flattens tables into self-describing text."""
