"""Secret scanning (operator 7).

A keyword automaton (Aho-Corasick) runs over each whole text, in lower case; a regular expression
is tried only where a keyword stands, anchored to that place. Two kinds carry a checksum that is
verified (``github``, ``npm``: the last six characters are the CRC-32 of the rest, in base 62).
Runs of hexadecimal digits have no keyword; one linear expression finds them.

Null texts count as empty and have no spans. Ids may repeat or be null: each row gives one row.
Empty tables give empty results; other columns are not read. Offsets are code points, ends
exclusive. Work is by row in Arrow batches: no shuffle, memory of one batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from semindex.llm.common import table, tidied

ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])"""
    r"""|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CRC = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")}
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
BASE, EXTRA = ("assign", "access", "hex"), ("github", "npm")
MIN_VALUE, MIN_ACCESS = 8, 16
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def crc_base62(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = ALPHABET[digit] + out
    return out.rjust(6, "0")


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by kind as listed in BASE and EXTRA, then start."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # some letters grow in lower case
        lower = text.translate(_ASCII_LOWER)
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *EXTRA)}
    until = dict.fromkeys(spans, 0)
    hits: list[tuple[int, str]] = sorted((end + 1 - n, kind) for end, (n, kind) in _automaton().iter(lower))
    for start, kind in hits:
        if start < until[kind]:
            continue
        pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CRC[kind]
        if (m := pattern.match(text, start)) is None:
            continue
        until[kind] = m.end()  # a match that fails the check below is used up all the same
        if kind == "assign":
            good = len(m[2]) >= MIN_VALUE
        elif kind == "access":
            good = len(m[0]) >= MIN_ACCESS
        else:
            good = crc_base62(m[1]) == m[2]
        if good:
            spans[kind].append(m.span())
    spans["hex"] = [m.span() for m in HEX.finditer(text)]
    return [(kind, s, e) for kind, found in spans.items() for s, e in found]


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(tidied(run), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets(): spans by start, then by kind as listed."""
    order = {k: i for i, k in enumerate((*BASE, *EXTRA))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in order}
            shas, texts = [], []
            for value in batch.column(1):
                rows = sorted(((x["start"], order[x["kind"]], x["end"], x["kind"]) for x in value.as_py()))
                for k in order:
                    counts[k].append(sum(r[3] == k for r in rows))
                shas.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in rows if k in BASE).encode()).hexdigest())
                texts.append(",".join(f"{k}:{s}:{e}" for s, _, e, k in rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(shas, pa.string()), pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int64()) for k in EXTRA]],
                names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", *[f"n_{k}" for k in EXTRA]],
            )

    return found.mapInArrow(tidied(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_github long, n_npm long"
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))
