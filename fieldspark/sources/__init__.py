"""Readers and writers: text ingest, window scans, archives, and publication."""
