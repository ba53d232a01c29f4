"""Whole queries: table reports and the queries that the driver runs."""
