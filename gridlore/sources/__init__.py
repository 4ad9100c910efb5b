"""Readers of sitemaps, feeds, article pages and stored tables, and writers of feeds."""
