"""Spark-native screening analytics: features, similarity, evaluation and audits as DataFrame plans."""
