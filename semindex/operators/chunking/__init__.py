"""Chunking: files to semantic chunks, one flat map over (path, content)."""
