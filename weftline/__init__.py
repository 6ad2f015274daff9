"""Spark-native interval, transcript and text-corpus analytics."""
