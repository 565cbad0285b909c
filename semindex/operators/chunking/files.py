"""The flat map from files to chunk rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semindex.functions import ids, rules
from semindex.functions import text as T
from semindex.operators.chunking import config, markup, plain, scanner
from semindex.operators.chunking.model import Piece
from semindex.operators.chunking.python_code import python_pieces

CHUNKERS = {
    "python": python_pieces,
    "markdown": plain.markdown_pieces,
    "html": markup.html_pieces,
    "xml": markup.xml_pieces,
    "svelte": markup.svelte_pieces,
    "astro": markup.astro_pieces,
    "css": config.css_pieces,
    "json": config.json_pieces,
    "yaml": config.yaml_pieces,
    "toml": config.toml_pieces,
} | {name: (lambda text, language=language: scanner.pieces(text, language)) for name, language in scanner.LANGUAGES.items()}


def register(language: str, chunker) -> None:
    """Add or replace a chunker: a function from text to a list of Piece. (The file's ending must
    be in the rule table; functions travel to the workers with the job.)"""
    CHUNKERS[language] = chunker


def chunk_text(text: str | None, path: str, language: str | None, is_text: bool, chunkers: dict | None = None) -> tuple[list[Piece], str | None, str | None]:
    """(pieces, language or None for plain text, error). A chunker that fails or finds nothing
    gives way to plain text where the file's ending allows it."""
    error = None
    if language is not None and text is not None:
        try:
            if found := (chunkers or CHUNKERS)[language](text):
                return found, language, None
        except Exception as e:  # one bad file must not stop the job; the error is in its row
            error = f"{type(e).__name__}: {e}"[:300]
    if is_text and text is not None:
        return plain.text_pieces(text, path.rsplit("/", 1)[-1]), None, error
    return [], language, error


_RAW = (
    "relative_path string, node_type string, content string, start_line int, end_line int, name string, parent_name string,"
    " docstring string, decorators array<string>, flags array<string>, language string, error string"
)


def raw_pieces(files: DataFrame, keep_errors: bool = False) -> DataFrame:
    """Pieces of ``files`` (path relative to the root, content as text or bytes), unnormalised."""
    is_bytes = dict(files.dtypes)["content"] == "binary"
    chunkers = dict(CHUNKERS)
    path = F.col("path")
    routed = files.filter(rules.is_supported(path)).select(
        path.alias("path"), "content", rules.language(path).alias("language"), rules.ending(path).isin(*rules.TEXT_ENDINGS).alias("is_text")
    )
    names = [x.split()[0] for x in _RAW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), strings, strings, pa.string(), pa.string()]
        for batch in batches:
            for p, content, language, is_text in zip(*(batch.column(i) for i in range(4)), strict=True):
                p, language, content = p.as_py(), language.as_py(), content.as_py()
                strict = content
                if is_bytes and content is not None:
                    try:
                        strict = content.decode("utf-8")
                    except UnicodeDecodeError:  # parsers want valid text, plain text is lenient
                        strict, language = content.decode("utf-8", "replace"), None
                found, told, error = chunk_text(strict, p, language, is_text.as_py(), chunkers)
                rows = [
                    (p, x.node_type, x.content, x.start_line, x.end_line, x.name, x.parent_name, x.docstring, x.decorators, sorted(x.flags), told, error)
                    for x in found
                ]
                if not rows and error and keep_errors:
                    rows = [(p, None, None, None, None, None, None, None, [], [], told, error)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return routed.mapInArrow(run, _RAW)


def chunk_files(files: DataFrame, root: str = "") -> DataFrame:
    """Chunk rows of ``files``: see semindex.schemas.CHUNK."""
    raw = raw_pieces(files)
    path = F.col("relative_path")
    flag = lambda name: F.array_contains("flags", name)
    kind = rules.chunk_type(F.col("node_type"), F.col("parent_name"))
    plain_tags = F.array_compact(F.array(F.lit("text"), F.when(rules.ending(path) != "", F.substring(rules.ending(path), 2, 99))))
    tags = F.when(F.col("language").isNull(), plain_tags).otherwise(
        rules.semantic_tags(flag("async"), flag("generator"), flag("export"), flag("generic"), flag("component"), F.col("language"))
    )
    return raw.select(
        ids.chunk_id(path, F.col("name"), F.col("start_line"), kind).alias("chunk_id"),
        "content", kind.alias("chunk_type"), "start_line", "end_line",
        F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), path).alias("file_path"), "relative_path",
        T.folder_parts(path).alias("folder_structure"), "name", "parent_name", "docstring", "decorators",
        F.array().cast("array<string>").alias("imports"), tags.alias("tags"), F.lit(0).alias("complexity_score"),
        F.col("content").alias("content_preview"),
    )
