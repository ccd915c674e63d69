"""Spark-native analytics for frame sequences, rigs, corrections and job ledgers."""
