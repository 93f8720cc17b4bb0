"""Corpuscle: a PySpark-native engine for document corpora and research evidence."""
