"""Spark-native engine for panel-style engagement data: cleaning, entity resolution, features, targets, profiling, models."""
