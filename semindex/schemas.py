"""Schemas of the engine's tables."""

from __future__ import annotations

#: One semantic chunk of a file.
CHUNK = (
    "chunk_id string, content string, chunk_type string, start_line int, end_line int, file_path string, relative_path string,"
    " folder_structure array<string>, name string, parent_name string, docstring string, decorators array<string>,"
    " imports array<string>, tags array<string>, complexity_score int, content_preview string"
)
#: A chunk with its vector, as the index keeps it.
INDEXED = f"{CHUNK}, embedding array<float>, model string"
#: A node of a file tree.
NODE = "path string, parent string, name string, depth int, hash string, is_file boolean, size long"
#: One snapshot's facts; its nodes are in a table of their own.
SNAPSHOT = "project_id string, snapshot_id long, snapshot_ts timestamp, project_path string, project_name string, root_hash string, file_count long, chunks_indexed long, incremental boolean"
#: A project and where its current version is.
PROJECT = "project_id string, name string, path string, total_chunks long, last_indexed timestamp"
