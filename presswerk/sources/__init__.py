"""Readers of feeds, interfaces, pages and configuration, and the stored table and artifacts."""
