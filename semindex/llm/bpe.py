"""BPE encoding and decoding (operator 8) by a table of distinct words.

1. Each task splits its documents at ASCII white space and numbers the distinct words of a block
   of documents by falling count. A block leaves as one row of positions (which word stands where,
   compressed) and, for each word partition, one row with the block's words of that partition.
2. All occurrences of a word meet in its word partition, where the tokenizer encodes it once; ids
   become pieces through the id-to-piece table. Each block's row of words returns as rows of ids.
3. Positions and ids of a block meet again, and the ids are joined back by position.

The tokenizer is read from a public vocabulary file, given by path; the driver reads it and sends
its text. Splitting at ASCII white space is exact for tokenizers that never let a token span white
space: normalisation, special tokens and pre-tokens all stay within such a word.

Null texts count as empty and have no tokens. Ids may repeat or be null: each row gives one row.
Empty tables give empty results; other columns are not read. A frequent word is one entry in each
block's row, however often it stands there, so no key is hot; a very long text makes a block alone.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import scan_parallelism, table, tidied, tidy

BLOCK_CHARS = 24_000_000
VOCABULARY = "word_bpe_49k.json"

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(data, asbytes=True)


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


class Block:
    """Documents whose words are numbered together."""

    def __init__(self) -> None:
        self.docs, self.null, self.counts, self.at, self.chars = array("q"), bytearray(), array("I"), array("I"), 0
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        self.docs.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.counts.append(len(words))
        self.at.extend(map(self.words.__getitem__, words))
        self.chars += len(text or "") + 16

    def rows(self, block: str, home: int, parts: int) -> Iterator[tuple]:
        """(dest, home, block, kind, n, a, b, c, d, e): kind 1 is words, kind 0 positions."""
        at = np.frombuffer(self.at, np.uint32)
        words = list(self.words)
        self.words.clear()
        count = np.bincount(at, minlength=len(words)) if len(words) else np.zeros(0, int)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        part = np.fromiter((zlib.crc32(words[i]) % parts for i in order), np.uint32, len(words))
        yield home % parts, home, block, 0, len(words), np.frombuffer(self.docs, np.int64).tobytes() + bytes(self.null), _pack(np.frombuffer(self.counts, np.uint32)), _pack(rank[at]) if len(at) else b"", b"", _pack(part) if len(part) else b""
        by_part = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            mine = [words[order[i]] for i in by_part[bounds[p] : bounds[p + 1]]]
            yield int(p), home, block, 1, len(mine), _squeeze(b" ".join(mine)), str(sum(map(len, mine)) + len(mine) - 1).encode(), str(p).encode(), b"", b""


MOVED = "dest int, home int, block string, kind int, n int, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in MOVED.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


class Words:
    """Encodes the words of a partition, each once, and knows their ids: as much memory as the
    partition has distinct words, of which there are fewer the more partitions there are."""

    def __init__(self, vocabulary: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)
        self.known: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, bytes]:
        """(number of ids of each word, all ids as bytes of ``kind``)."""
        known = self.known
        new = [w for w in words if w not in known]
        for i in range(0, len(new), 2_000):
            some = new[i : i + 2_000]
            for w, e in zip(some, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, self.kind).tobytes()
        found = [known[w] for w in words]
        return np.fromiter(map(len, found), np.uint32, len(found)) // np.uint32(self.kind.itemsize), b"".join(found)


def pieces(vocabulary: str) -> list[str]:
    """The id-to-piece table, indexed by id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    found = {i: w for w, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [found.get(i, "") for i in range(max(found, default=-1) + 1)]


#: What encode() can return of each row.
COLUMNS = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string", "decoded": "string"}
DIGEST = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids", "decoded"), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The named COLUMNS of every row."""
    wanted = [c for c in COLUMNS if c in columns]
    with open(path or default_path(), encoding="utf-8") as file:  # a small public file beside the library, on the driver
        told = file.read()
    context = docs.sparkSession.sparkContext
    vocabulary, id_pieces = context.broadcast(told), context.broadcast(pieces(told))
    parts = max(17, scan_parallelism(docs) | 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, n = Block(), 0

        def out() -> Iterator[pa.RecordBatch]:
            name, rows = f"{task}-{n}", []
            for row in block.rows(name, task * 4 + n, parts):
                rows.append(row)
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if block.chars >= block_chars:
                    yield from out()
                    block, n = Block(), n + 1
        if block.docs:
            yield from out()

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] == 1:
                    words = words or Words(vocabulary.value)
                    mine = pa.decompress(row[5], decompressed_size=int(row[6]), codec="zstd", asbytes=True).split(b" ")
                    lengths, ids = words.ids(mine)
                    row = (*row[:5], _pack(lengths), _squeeze(ids) if ids else b"", row[7], str(int(lengths.sum())).encode(), str(words.kind.itemsize).encode())
                yield _batch([row])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = None
        held: dict[int, tuple[list[str], list[str], np.ndarray, np.ndarray]] = {}
        current = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] != current:
                    held, current = {}, row[2]
                if row[3] == 1:
                    if table_ is None:
                        table_ = np.array(id_pieces.value, object), np.array([str(i) for i in range(len(id_pieces.value))], object)
                    lengths, total = _unpack(row[5], row[4], np.uint32), int(row[8])
                    kind = np.dtype(f"u{int(row[9])}")
                    ids = np.frombuffer(pa.decompress(row[6], decompressed_size=total * kind.itemsize, codec="zstd", asbytes=True), kind) if total else np.zeros(0, kind)
                    ends = np.cumsum(lengths)
                    piece, number = table_[0][ids].tolist(), table_[1][ids].tolist()
                    spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                    held[int(row[7])] = ([" ".join(number[a:b]) for a, b in spans], [" ".join(piece[a:b]) for a, b in spans], lengths, ids)
                    continue
                n_docs = len(row[5]) // 9
                part = _unpack(row[9], row[4], np.uint32) if row[4] else np.zeros(0, np.uint32)
                if sum(len(h[2]) for h in held.values()) != row[4]:
                    raise RuntimeError(f"block {current}: not all words came back")
                number, piece, lengths, first = [""] * row[4], [""] * row[4], np.zeros(row[4], np.int64), np.zeros(row[4], np.int64)
                every, at_id = [np.zeros(0, np.int32)], 0
                for p, (a, b, size, ids) in held.items():
                    mine = np.flatnonzero(part == p)
                    for i, k in enumerate(mine.tolist()):
                        number[k], piece[k] = a[i], b[i]
                    lengths[mine] = size
                    first[mine] = np.cumsum(size) - size + at_id
                    every.append(ids.astype(np.int32))
                    at_id += len(ids)
                held = {}
                counts = _unpack(row[6], n_docs, np.uint32).astype(np.int64)
                at = _unpack(row[7], int(counts.sum()), np.uint32) if counts.sum() else np.zeros(0, np.uint32)
                yield from results(np.frombuffer(row[5][: 8 * n_docs], np.int64), np.frombuffer(row[5][8 * n_docs :], np.uint8), counts, at, number, piece, lengths, first, np.concatenate(every))
                del number, piece, lengths, first, every, at, part
                tidy()

    def results(doc_ids, null, counts, at, number, piece, lengths, first, every) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(counts)
        tokens = np.concatenate([[0], np.cumsum(lengths[at])])
        for i in range(0, len(doc_ids), 500):
            j = min(i + 500, len(doc_ids))
            low, high = ends[i] - counts[i], ends[j - 1]
            numbers, texts = [], []
            for k in range(i, j):
                words = at[ends[k] - counts[k] : ends[k]].tolist()
                texts.append(" ".join(filter(None, map(piece.__getitem__, words))))
                if "ids_sha256" in wanted:
                    numbers.append(hashlib.sha256(" ".join(filter(None, map(number.__getitem__, words))).encode()).hexdigest())
            bounds = tokens[np.append(ends[i:j] - counts[i:j], high)]
            out = {"doc_id": pa.array(doc_ids[i:j], pa.int64(), mask=null[i:j].astype(bool)), "n_tokens": pa.array(np.diff(bounds), pa.int64())}
            if "ids" in wanted:  # each word's ids, word after word
                size = lengths[at[low:high]]
                place = np.repeat(first[at[low:high]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(every[place]))
            out["ids_sha256"] = pa.array(numbers, pa.string()) if numbers else None
            out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()) if "decoded_sha256" in wanted else None
            out["decoded"] = pa.array(texts, pa.string()) if "decoded" in wanted else None
            yield pa.RecordBatch.from_arrays([out[c] for c in wanted], names=wanted)

    moved = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(tidied(split), MOVED)
    encoded = moved.repartitionById(parts, F.col("dest")).mapInArrow(tidied(encode_words), MOVED)
    met = encoded.repartitionById(parts, F.pmod(F.col("home"), F.lit(parts)).cast("int")).sortWithinPartitions("block", F.desc("kind"))
    return met.mapInArrow(tidied(join), ", ".join(f"{c} {COLUMNS[c]}" for c in wanted))


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece) of the vocabulary: as many rows as the file has entries."""
    with open(path or default_path(), encoding="utf-8") as file:
        found = pieces(file.read())
    return spark.createDataFrame(list(enumerate(found)), "id int, piece string")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids, through a join with the id-to-piece table (whose size is
    that of the vocabulary file, so it is broadcast)."""
    spark = encoded.sparkSession
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col(ids_col).alias("_ids"))
    each = rows.select("doc_id", "_row", F.posexplode_outer("_ids").alias("_pos", "id"))
    joined = each.join(F.broadcast(piece_table(spark, path)), "id", "left")
    grouped = joined.groupBy("doc_id", "_row").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_pos", "piece")))).alias("_p"))
    return grouped.select("doc_id", F.array_join(F.transform("_p", lambda x: x["piece"]), " ").alias("text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), columns=DIGEST)
