"""Spark-native connectivity analytics: patches, corridors, budgets, landscape and graph metrics."""
