"""Readers and writers: CSV bundles, Parquet tables, scoring configurations."""
