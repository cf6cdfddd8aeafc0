"""Spark-native audit engine for learner-interaction logs."""
