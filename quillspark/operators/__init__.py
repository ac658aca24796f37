"""Operators on papers, records and tables; functions from DataFrame to DataFrame."""
