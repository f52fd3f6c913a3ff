"""Operators for preparing large language-model training data, as Spark jobs."""
