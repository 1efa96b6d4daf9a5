"""Semantic-search analytics and corpus operators on Spark."""
