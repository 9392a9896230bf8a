"""Incremental ingest; an extension, as finite inputs are the engine's main use."""
