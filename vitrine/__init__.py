"""Catalogue analytics on PySpark: scans, extraction, de-duplication, search, roll-ups and streaming upkeep."""
