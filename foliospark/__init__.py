"""Foliospark: rule-driven extraction and collection operators as Spark jobs."""
