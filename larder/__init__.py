"""Nutrition and care analytics as Spark DataFrame operators."""
