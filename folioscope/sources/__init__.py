"""Scans of the metadata table and of the text folder."""
