"""Queries on tables derived from the driver's, with their SQL."""
