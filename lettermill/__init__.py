"""Spark-native text-corpus engine for citizen letters and court rulings."""
