"""Spark-native catalog retrieval, preference ranking and evaluation."""
