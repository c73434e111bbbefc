"""Incremental ingestion: manifests and Structured Streaming file sources."""
