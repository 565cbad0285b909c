"""Removal of repeated byte strings (operator 4) by depth-limited radix sort.

Every string of LENGTH bytes that starts at two places or more, in one document or several, is
repeated, and all bytes that repeated strings cover go. Strings are judged on the input texts as
UTF-8, never across documents.

A full order of all suffixes is not needed: a most-significant-digit sort to the depth LENGTH that
drops every group of one after each pass leaves exactly the repeated strings. To move few rows,
the passes sort whole ranges of neighbouring string starts first and single starts last:

1. The first digit of a string is its smallest gram (GRAM bytes, by hash). Neighbouring strings
   share it, so a row stands for a range of up to LENGTH - GRAM + 1 starts. Equal strings have
   equal smallest grams at equal offsets, whatever stands around them. Ranges whose gram occurs
   once hold no repeated string and leave.
2. The next digit is all text that a range covers. Ranges with equal text are repeated wholly.
3. What is left shares its gram with another text: ranges are cut into runs of STEP starts, by
   distance from the gram. The digit is what all strings of a run share; runs alone with it leave.
   Runs whose whole text is equal are repeated wholly.
4. The last digit is the string itself, one row for each start of the runs that are left.

Digits are 128-bit hashes of their bytes. Each pass shuffles narrow rows, pre-aggregated before
the shuffle; groups of copies are one row of a text from pass 3 on. Documents meet their spans
by a join on the document. Long documents are read in segments, so a task holds one segment.

Null texts count as empty. Ids may repeat or be null: rows are told apart by id and text, and each
input row gives one row. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm import textbytes as tb
from semindex.llm.common import cut, scan_parallelism, table, tidied

LENGTH, GRAM, STEP = 200, 32, 16
SEGMENT = 1 << 19
BROADCAST_DOCS = 1_000_000
_POS = 28  # bits of a position within a segment or chunk


def _ranges(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(document, anchor, first start, last start, gram hash, two hashes of the covered text) of all
    ranges of starts with one smallest gram. Positions count from the start of ``data``."""
    n = len(data)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, tb.U)] * 3
    if n < length:
        return none
    values = tb.RANDOM[data]
    s1 = tb.prefix_sums(values, tb.POWERS)
    starts = np.arange(n - gram + 1)
    grams = tb.mix((s1[gram:] - s1[:-gram]) * tb.POWERS(n + 1)[1][: n - gram + 1])
    key = (grams & ~tb.U((1 << _POS) - 1)) | starts.astype(tb.U)
    wide = length - gram + 1
    low, span = key, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: n - length + 1], low[wide - span : wide - span + n - length + 1])
    anchor = (low & tb.U((1 << _POS) - 1)).astype(np.int64)
    # starts whose string ends within its document
    lengths = np.diff(offsets)
    mark = np.zeros(n - length + 2, np.int32)
    fits = lengths >= length
    np.add.at(mark, offsets[:-1][fits], 1)
    np.add.at(mark, offsets[1:][fits] - length + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(edge & valid)
    if not len(first):
        return none
    stop = np.ones(len(anchor), bool)
    stop[:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    a = anchor[first]
    s2 = tb.prefix_sums(values, tb.POWERS2)
    shape = tb.mix(((a - first) * 512 + (last - first)).astype(tb.U) + tb.U(1))
    c1 = tb.mix(tb.span_hash(s1, first, last + length, tb.POWERS) + shape)
    c2 = tb.mix(tb.span_hash(s2, first, last + length, tb.POWERS2) ^ shape)
    docs = np.searchsorted(offsets, first, "right") - 1
    return docs, a, first, last, grams[a], c1, c2


def _segments(column: pa.Array, length: int):
    """(first row, bytes, offsets, base) of runs of rows; a long row comes in segments that overlap
    by length - 1 bytes, base is where the segment starts in its row."""
    for first, _, data, offsets in tb.chunks(column):
        if len(data) <= SEGMENT or len(offsets) > 2:
            yield first, data, offsets, 0
            continue
        for base in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[base : base + SEGMENT + length - 1]
            yield first, part, np.array([0, len(part)]), base


_I = pa.int64()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), _I)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_id, _h, spans): for each text with repeated strings its spans struct<s,e>, unmerged.

    ``docs`` has the columns _id, _h (hash of the text) and _t (text)."""
    parts = scan_parallelism(docs)

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets, _ in _segments(batch.column(2), length):
                _, _, _, _, g, c1, c2 = _ranges(data, offsets, length, gram)
                _, at, n = np.unique(c1 ^ tb.mix(c2), return_index=True, return_counts=True)  # pre-aggregation
                yield pa.RecordBatch.from_arrays([_signed(g[at]), _signed(c1[at]), _signed(c2[at]), pa.array(n, _I)], names=["g", "c1", "c2", "n"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for row, data, offsets, base in _segments(batch.column(2), length):
                d, a, first, last, _, c1, c2 = _ranges(data, offsets, length, gram)
                d_row = pa.array(d + row)
                start = offsets[d]
                place = ((first - start + base) << 16) | ((a - first) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays([ids.take(d_row), hashes.take(d_row), pa.array(place, _I), _signed(c1), _signed(c2)], names=["_id", "_h", "place", "c1", "c2"])

    # passes 1 and 2: the kind of each covered text. Both counts use one exchange by gram.
    texts = docs.mapInArrow(tidied(digits), "g long, c1 long, c2 long, n long").repartition(parts, "g").groupBy("g", "c1", "c2").agg(F.sum("n").alias("n"))
    grams = texts.groupBy("g").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("texts")).filter("all > 1")
    kinds = cut(texts.join(grams.hint("shuffle_hash"), "g").selectExpr("c1", "c2", "g", "n > 1 as whole", "texts > 1 as mixed"))
    found = docs.mapInArrow(tidied(ranges), "_id long, _h long, place long, c1 long, c2 long")
    found = cut(found.join(kinds.hint("merge"), ["c1", "c2"]))
    first = F.shiftright("place", 16)
    last = first + F.col("place").bitwiseAND(255)
    spans = found.filter("whole").select("_id", "_h", first.alias("s"), (last + length).alias("e"))

    # passes 3 and 4: texts that share a gram with other texts; of equal texts one stands for all
    mixed = found.filter("mixed").groupBy("c1", "c2").agg(F.min(F.struct("_id", "_h", "place", "g")).alias("r")).select("r.*")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, data, places, g in _with_places(batches):
            s1, s2 = _sums(data)
            low, width = places >> 16, places & 255
            a, high = low + ((places >> 8) & 255), low + width
            q0, q1 = (a - high) // STEP, (a - low) // STEP
            count = q1 - q0 + 1
            k = np.repeat(np.arange(len(a)), count)
            q = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + q0[k]
            near, far = a[k] - STEP * q, a[k] - STEP * q - (STEP - 1)
            lo, hi = np.maximum(low[k], far), np.minimum(high[k], near)
            salt = tb.mix(g[k] + tb.mix(q.astype(tb.U) + tb.U(7)))
            k1, k2 = _digit(s1, s2, near, far + length, salt)
            full = (lo == far) & (hi == near)
            u1, u2 = _digit(s1, s2, np.where(full, far, lo), np.where(full, near, hi) + length, salt + full.astype(tb.U) + tb.U(1))
            yield _rows(ids, hashes, len(k), {"lo": lo, "n": hi - lo + 1, "k1": k1, "k2": k2, "u1": u1, "u2": u2, "full": full})

    run = "_id long, _h long, lo long, n long, k1 long, k2 long, u1 long, u2 long, full boolean"
    cores, wholes = "(partition by k1, k2)", "(partition by k1, k2, u1, u2)"
    kept = (
        _texts_with(docs, mixed).mapInArrow(tidied(runs), run)
        .selectExpr("*", f"count(1) over {cores} as alike", f"row_number() over {wholes[:-1]} order by _id, _h, lo) as nth", f"count(1) over {wholes} as same")
        .filter("alike > 1")
        .selectExpr("*", "full and same > 1 as whole")
        .selectExpr("*", f"count_if(not whole) over {cores} as open")
        # of whole runs with equal text one goes on as partner, if others of its core are still open
        .selectExpr("_id", "_h", "lo", "n", "whole", "not whole or (open > 0 and nth = 1) as on")
    )
    kept = cut(kept)
    spans = spans.unionByName(kept.filter("whole").selectExpr("_id", "_h", "lo as s", f"lo + n - 1 + {length} as e"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, data, places, _ in _with_places(batches):
            s1, s2 = _sums(data)
            low, count = places >> 16, places & 255
            at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.unique(at)
            k1, k2 = _digit(s1, s2, at, at + length, tb.U(0))
            yield _rows(ids, hashes, len(at), {"s": at, "k1": k1, "k2": k2})

    left = kept.filter("on").selectExpr("_id", "_h", "lo * 65536 + n as place", "0L as g")
    each = _texts_with(docs, left).mapInArrow(tidied(strings), "_id long, _h long, s long, k1 long, k2 long")
    each = each.selectExpr("_id", "_h", "s", "count(1) over (partition by k1, k2) as n").filter("n > 1")
    return spans.unionByName(each.selectExpr("_id", "_h", "s", f"s + {length} as e"))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = tb.RANDOM[data]
    return tb.prefix_sums(values, tb.POWERS), tb.prefix_sums(values, tb.POWERS2)


def _digit(s1, s2, start, end, salt) -> tuple[np.ndarray, np.ndarray]:
    return tb.mix(tb.span_hash(s1, start, end, tb.POWERS) + salt), tb.mix(tb.span_hash(s2, start, end, tb.POWERS2) ^ salt)


def _rows(doc_id, doc_hash, n: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(v) if v.dtype == bool else _signed(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.repeat(doc_id, n), pa.repeat(doc_hash, n), *arrays], names=["_id", "_h", *columns])


def _texts_with(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(_id, _h, _t, places, gs) of the texts that have rows (_id, _h, place, g)."""
    lists = rows.groupBy("_id", "_h").agg(F.collect_list(F.struct("place", "g")).alias("r"))
    lists = cut(lists.selectExpr("_id", "_h", "r.place as places", "r.g as gs"))
    some, _ = _split(docs, lists)
    joined = some.alias("d").join(lists.hint("merge").alias("l"), F.expr("d._id <=> l._id and d._h = l._h"))
    return joined.selectExpr("d._id", "d._h", "d._t", "l.places", "l.gs")


def _split(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``docs`` with a key (_id, _h) in ``keys``, and those without; all rows and None if
    there are too many keys to broadcast."""
    if keys.count() > BROADCAST_DOCS:
        return docs, None
    some = F.broadcast(keys.select("_id", "_h"))
    same = docs["_id"].eqNullSafe(some["_id"]) & (docs["_h"] == some["_h"])
    return docs.join(some, same, "left_semi"), docs.join(some, same, "left_anti")


def _with_places(batches: Iterator[pa.RecordBatch]):
    """(id, hash, bytes, places, grams) of each row, once for each id and text in a batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_buffer()
            places, g = batch.column(3)[i].values, batch.column(4)[i].values
            yield batch.column(0)[i], batch.column(1)[i], np.frombuffer(text, np.uint8), places.to_numpy(), g.to_numpy().view(tb.U)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    base = base.select("_id", F.xxhash64("_t").alias("_h"), "_t")
    spans = cut(repeated_spans(base, length).groupBy("_id", "_h").agg(F.collect_list(F.struct("s", "e")).alias("r")))
    some, rest = _split(base, spans)  # texts without spans stay where they are
    joined = some.alias("d").join(spans.hint("merge").alias("p"), F.expr("d._id <=> p._id and d._h = p._h"), "left").selectExpr("d._id", "d._t", "p.r.s", "p.r.e")
    if rest is not None:
        nothing = "cast(null as array<bigint>)"
        joined = joined.unionByName(rest.selectExpr("_id", "_t", f"{nothing} as s", f"{nothing} as e"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = text.as_buffer()
                n, pieces, at, removed, count = len(data), [], 0, 0, 0
                if s.is_valid:
                    for a, b in merge(s.values.to_numpy(), e.values.to_numpy()):
                        pieces.append(data.slice(at, a - at).to_pybytes())
                        at, removed, count = b, removed + b - a, count + 1
                pieces.append(data.slice(at).to_pybytes())
                kept = b"".join(pieces)
                for column, value in zip(out, (n, removed, count, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            kinds = [_I, _I, _I, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(tidied(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return list(zip(starts[new].tolist(), reach[last].tolist(), strict=True))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
