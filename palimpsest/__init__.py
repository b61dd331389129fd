"""Sensitive-data redaction, classification and restoration on Spark."""
