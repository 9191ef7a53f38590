"""Readers of posts: CSV files, landed API responses, the store."""
