"""Readers: parquet tables, files in several formats, bibliographic libraries, thesauri."""
