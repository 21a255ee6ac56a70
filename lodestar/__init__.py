"""Spark-native search and ranking over file and document collections."""
