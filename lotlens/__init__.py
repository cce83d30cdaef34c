"""Listing-market analytics as Spark jobs."""
