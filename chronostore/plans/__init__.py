"""Registered queries, their SQL, and views for Spark SQL."""
