"""Whole plans: the query catalogue over the tables, the ranking of nested records, the offline build."""
