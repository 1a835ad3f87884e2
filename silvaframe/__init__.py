"""Spark-native operators for object inventories taken from aerial imagery."""
