"""Inputs: site and bot lists, access-log tables, sitemaps."""
