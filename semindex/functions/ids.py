"""Identity rules."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(relative_path: Column, name: Column, start_line: Column, kind: Column) -> Column:
    """md5 of path, name, first line and type; a missing name is the word None."""
    return F.md5(F.concat_ws(":", relative_path, F.coalesce(name, F.lit("None")), start_line.cast("string"), kind))


def project_id(path: str) -> str:
    return hashlib.md5(path.encode()).hexdigest()


def vector_id(chunk_ids: Column) -> Column:
    """63-bit number of a chunk id (blake2b of 8 bytes, big-endian, sign bit off)."""

    @F.pandas_udf("bigint")
    def number(values: pd.Series) -> pd.Series:
        return values.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") & 0x7FFFFFFFFFFFFFFF)

    return number(chunk_ids)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)
