"""Similarity join of documents on word shingles (operator 3), by chosen paths.

A document is the set of its shingles (five words, lower case A-Z); equal sets are one class from
the start, so copies never meet each other. Two sets match at Jaccard similarity THRESHOLD or more.

Chosen paths: in each run, a set of n shingles follows every shingle whose hash in this run is
below SPREAD / n. Sets that follow the same shingle are a bucket. A bucket of more than BUCKET sets
is split: each of its sets follows SPREAD more shingles on average, chosen by a hash of the bucket
and the shingle out of a pool of about POOL of the set's shingles, and so on down to DEPTH shingles
a path. So what many different texts share (a license line) falls apart, while near copies stay
together. Runs repeat until matching pairs are found with probability RECALL: see _runs(), which
counts every level of a path, so that no size of a bucket lowers it.

Buckets are brute-forced: whole up to BLOCK sets, else in blocks of about BLOCK sets, every block
with every other. No bucket is cut short or thinned. The comparison there is by size and bit sketch
(some bits of the smallest hash of each bin); a cell of blocks returns no pairs but what they
connect, as stars, so its rows grow with the sets and not with the pairs.

What the stars connect are the candidate groups. The sets of a group are compared exactly, all
with all, in blocks of CELL shingles: this gives the links of each set (counted in place, without
rows for pairs) and again stars, whose components are the classes. The work within a
group grows with the square of its distinct sets; without link counts most of it is left out,
since sets that are connected already needn't be compared.

Null, empty and blank texts have no words and form one class. Texts of one to four words have
one shingle. Very long texts are one set like any other and a block of their own. Ids may repeat or
be null, rows may repeat in full; each input row gives one row, and a class's id is the smallest
that isn't null (null if all are). Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm import textbytes as tb
from semindex.llm.common import cut, join_by_hot_key, same_order, table, tidied, without
from semindex.llm.graph import connected_components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
SPREAD, DEPTH, POOL = 2.0, 3, 32
#: Sets of a bucket that is not split, and of a block of a bucket, about.
BUCKET, BLOCK = 4096, 1024
#: Sets of a bucket whose pairs are compared together with those of other buckets.
SMALL = 8
#: Sketch: the smallest hash of each of BINS bins, BITS bits of it, WORDS numbers of 64 bits.
BINS, BITS = 256, 4
WORDS = BINS * BITS // 64
#: Standard deviations above the expected number of different bins of matching sets.
SIGMAS = 4.0
BROADCAST_IDS = 1_000_000
#: Shingles of a block of a group's sets, about.
CELL = 1 << 16


def _missed(shared: float) -> float:
    """Probability that one run doesn't find two matching sets that share ``shared`` shingles of
    their pools, if every bucket on their paths is split down to DEPTH."""
    found = 1.0
    for level in range(DEPTH):
        last = level == DEPTH - 1
        found = 1 - math.exp(-SPREAD * (THRESHOLD if last else shared / POOL) * found)
    return 1 - found


def _runs() -> int:
    """Runs until matching pairs are missed with probability 1 - RECALL at most, at worst: similar
    by just THRESHOLD, of very different sizes, in large buckets at every level. What they share of
    their pools is a Poisson number and the same in all runs."""
    mean = THRESHOLD * POOL
    weights = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(4 * POOL)]
    misses = [_missed(min(k, POOL)) for k in range(4 * POOL)]
    runs = 1
    while sum(w * m**runs for w, m in zip(weights, misses, strict=True)) > 1 - RECALL:
        runs += 1
    return runs


RUNS = _runs()
RECORD = "doc_id long, text_hash long, fp1 long, fp2 long, n int, s binary, t array<bigint>, pool array<bigint>"


def fingerprint(u: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a, b = (u * tb.BASE).sum(dtype=tb.U), tb.mix(u ^ tb.BASE2).sum(dtype=tb.U)
    return int(a.view(np.int64)), int(b.view(np.int64))


_SHIFT = tb.U(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=tb.U) << _SHIFT


def sketch(u: np.ndarray) -> bytes:
    """BITS bits of the smallest hash in each bin (u: sorted hashes). Empty bins are 0."""
    at = np.searchsorted(u, _EDGES)
    low = u[np.minimum(at, len(u) - 1)]
    full = (at < len(u)) & ((low >> _SHIFT) == np.arange(BINS, dtype=tb.U))
    value = np.where(full, tb.mix(low) & tb.U((1 << BITS) - 1), tb.U(0)).reshape(WORDS, 64 // BITS)
    return (value << (np.arange(64 // BITS, dtype=tb.U) * tb.U(BITS))).sum(1, dtype=tb.U).tobytes()


#: For each run, and at last for the pool, an odd number that hashes a shingle by multiplication.
_FACTORS = (tb.mix(np.arange(1, RUNS + 2, dtype=tb.U) * tb.BASE) | tb.U(1))[:, None]


def followed(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first shingles of a set's paths in all runs, its pool)"""
    limit = np.full(RUNS + 1, math.ceil(SPREAD / len(u) * (1 << 24)))
    limit[-1] = math.ceil(POOL / len(u) * (1 << 24))
    run, at = np.nonzero((u * _FACTORS) >> tb.U(40) < limit.astype(tb.U)[:, None])
    first = np.searchsorted(run, RUNS)
    # the same shingle is another path in each run
    return (u[at[:first]] ^ _FACTORS[run[:first], 0]).view(np.int64), u[at[first:]].view(np.int64)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    longs = pa.list_(pa.int64())
    for batch in batches:
        for first, end, data, offsets in tb.chunks(batch.column(1)):
            rows = []
            for u in tb.shingles(data, offsets, SHINGLE):
                if len(u):
                    rows.append((*fingerprint(u), len(u), sketch(u), *followed(u)))
                else:
                    rows.append((0, 0, 0, bytes(WORDS * 8), [], []))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), longs, longs]
            own = [batch.column(i).slice(first, end - first) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in tb.chunks(batch.column(1)):
            found = list(tb.shingles(data, offsets, SHINGLE))
            prints = [fingerprint(u) if len(u) else (0, 0) for u in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([u.tobytes() for u in found], pa.binary())],
                names=["doc_id", "fp1", "fp2", "u"],
            )


def _connected(m: int, x: int, near: Callable[[int, slice], np.ndarray]) -> np.ndarray:
    """For each of ``m`` sets the first that it is connected to. ``near(i, part)`` tells which sets of
    a part of them match set i. If ``x`` < m, only pairs across that border count.

    Pairs within the largest component so far are not looked at: sets outside it, one by one, are
    compared to all others, until none is left that hasn't been.
    """
    label, tried = np.arange(m), np.zeros(m, bool)
    while True:
        open_ = ~tried & (label != np.bincount(label).argmax())
        if tried[:x].all() or not open_.any():
            break
        for i in np.flatnonzero(open_)[:64].tolist():
            tried[i] = True
            part = slice(0, m) if x == m else slice(x, m) if i < x else slice(0, x)
            hit = np.flatnonzero(near(i, part)) + part.start
            hit = hit[label[hit] != label[i]]
            if len(hit):
                label[np.isin(label, label[hit])] = label[i]
                if 2 * (label == label[i]).sum() > m:  # most are connected: look at the rest only
                    break
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    return first[of]


def _star(cid: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): what a cell connects, as pairs of a component's first set and each other one."""
    far = np.flatnonzero(label != np.arange(len(label)))
    return cid[label[far]], cid[far]


_NIBBLES = tb.U(0x1111111111111111)
_MOST = (1 - THRESHOLD) * BINS + SIGMAS * (THRESHOLD * (1 - THRESHOLD) * BINS) ** 0.5


def _different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a ^ b
    v |= v >> tb.U(1)
    v |= v >> tb.U(2)
    return np.bitwise_count(v & _NIBBLES).sum(1, dtype=np.int64)


def _alike(n: np.ndarray, s: np.ndarray) -> Callable[[int | np.ndarray, slice | np.ndarray], np.ndarray]:
    """Which sets of a part may match set i (or the set at the same place of i), by size and sketch?

    Sets that match share THRESHOLD / (1 + THRESHOLD) of their joint size at least. Each bin that
    differs holds a shingle of one set alone, which bounds the bins that differ. Large sets put many
    shingles in a bin: there the smallest hash belongs to one set alone with probability
    1 - THRESHOLD, and SIGMAS standard deviations above that bound it.
    """
    first, rest = np.ascontiguousarray(s[:, : WORDS // 4]), s[:, WORDS // 4 :]

    def near(i: int | np.ndarray, part: slice | np.ndarray) -> np.ndarray:
        other = n[part]
        most = np.minimum((other + n[i]) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-6, _MOST)
        low = _different(first[part], first[i])
        good = (other >= THRESHOLD * n[i]) & (other * THRESHOLD <= n[i]) & (low <= most)
        at = np.flatnonzero(good)
        mine = rest[i] if np.ndim(i) == 0 else rest[i[at]]
        good[at] = low[at] + _different(rest[part][at], mine) <= most[at]
        return good

    return near


def _matching(sets: list[np.ndarray]) -> Callable[[int, slice], np.ndarray]:
    """Which sets match set i, exactly?"""
    sizes = np.array([len(u) for u in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]

    def near(i: int, part: slice) -> np.ndarray:
        u = sets[i]
        low = np.searchsorted(flat, u)
        many = np.searchsorted(flat, u, "right") - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        return (shared / (len(u) + sizes - shared) >= THRESHOLD)[part]

    return near


def _cells(members: pa.StructArray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(sets of the first block, places in ``members`` by block) of each cell of _dealt()."""
    block = members.field("block").to_numpy()
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        order = a + np.argsort(block[a:b], kind="stable")
        yield int((block[order] == block[order[0]]).sum()), order


_LONGS = [np.zeros(0, np.int64)]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs that connect what may match in the cells of buckets: all that match of cells of
    SMALL sets or fewer, which are compared together, else spanning stars."""
    for batch in batches:
        members, sizes = batch.column(0).flatten(), batch.column(0).value_lengths().to_numpy().astype(np.int64)
        ends, cid, n = np.cumsum(sizes), members.field("cid").to_numpy(), members.field("n").to_numpy().astype(float)
        s = np.frombuffer(b"".join(members.field("s").to_pylist()), tb.U).reshape(len(cid), WORDS)
        pairs = [(*_LONGS, *_LONGS)]
        for m in range(2, SMALL + 1):
            i, j = ((ends[sizes == m] - m)[:, None] + side for side in np.triu_indices(m, 1))
            good = _alike(n, s)(i.ravel(), j.ravel())
            pairs.append((cid[i.ravel()[good]], cid[j.ravel()[good]]))
        for x, at in _cells(members, ends[sizes > SMALL], sizes[sizes > SMALL]):
            pairs.append(_star(cid[at], _connected(len(at), x, _alike(n[at], s[at]))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], names=["a", "b"])


def _links(count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, null): spanning stars of what matches in the cells of groups; and with ``count``
    (a, null, n): the number of matches of each set there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, sizes = batch.column(0).flatten(), batch.column(0).value_lengths().to_numpy().astype(np.int64)
            cids, sets = members.field("cid").to_numpy(), members.field("u")
            stars, counts = [(*_LONGS, *_LONGS)], [(*_LONGS, *_LONGS)]
            for x, at in _cells(members, np.cumsum(sizes), sizes):
                cid, m = cids[at], len(at)
                near = _matching([np.frombuffer(sets[i].as_buffer(), tb.U) for i in at.tolist()])
                if count:
                    good = np.zeros((m, m), bool)
                    for i in range(x):
                        part = slice(0, m) if x == m else slice(x, m)
                        good[i, part] = near(i, part)
                    good |= good.T
                    np.fill_diagonal(good, False)
                    n = good.sum(1)
                    counts.append((cid[n > 0], n[n > 0]))
                    near = lambda i, part, good=good: good[i, part]
                stars.append(_star(cid, _connected(m, x, near)))
            (a, b), (of, n) = ([np.concatenate(c) for c in zip(*found, strict=True)] for found in (stars, counts))
            none = [pa.nulls(len(of), pa.int64()), pa.nulls(len(a), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(a, of)), pa.concat_arrays([pa.array(b), none[0]]), pa.concat_arrays([none[1], pa.array(n)])], names=["a", "b", "n"])

    return run


def _dealt(rows: DataFrame, key: str, member: list[str]) -> DataFrame:
    """(members): a row for each pair of blocks of each ``key``, and each block with itself: lists of
    block and ``member``. ``rows`` has cid and ``blocks``, the number of blocks of its key."""
    block = F.pmod(F.xxhash64("cid"), "blocks")
    sent = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = sent.groupBy(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # a cell that one block alone fell into is that of the block with itself
    full = (F.col("i") == F.col("j")) | (F.exists("members", lambda m: m["block"] == F.col("i")) & F.exists("members", lambda m: m["block"] == F.col("j")))
    return cells.agg(F.collect_list(F.struct("block", *member)).alias("members")).filter(full & (F.size("members") > 1)).select("members")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, cid, size) of the keys that several sets have. (Checkpointed.)"""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return cut(rows.join(sizes, "key"))


def _followed_further(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cid): the paths of the members of ``rows`` (key, cid), one shingle longer."""
    limit = F.ceil(F.lit(SPREAD * (1 << 20)) / F.least(F.col("n"), F.lit(POOL)))

    def chosen(token: Column) -> Column:
        return F.xxhash64("key", token).bitwiseAND(F.lit((1 << 20) - 1)) < limit

    of = rows.join(classes.select("cid", "n", "pool"), "cid")
    return of.select(F.explode(F.transform(F.filter("pool", chosen), lambda token: F.xxhash64(token, "key"))).alias("key"), "cid")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, cid, size): the members of all buckets to be brute-forced."""
    rows = _shared(classes.select(F.explode("t").alias("key"), "cid"))
    done = None
    for _ in range(DEPTH - 1):
        large = rows.filter(F.col("size") > BUCKET)
        if large.isEmpty():
            break
        small = rows.filter(F.col("size") <= BUCKET)
        done = small if done is None else done.unionByName(small)
        rows = _shared(_followed_further(large.select("key", "cid"), classes))
    return rows if done is None else done.unionByName(rows)


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, component): groups of sets that what may match connects."""
    rows = _buckets(classes).withColumn("blocks", F.when(F.col("size") > BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("long"))
    cells = _dealt(rows.join(classes.select("cid", "n", "s"), "cid"), "key", ["cid", "n", "s"])
    return connected_components(cells.mapInArrow(tidied(_edges), "a long, b long"))


def _sets_of(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cid, u): the shingles of the classes of ``chosen`` (cid, rep, fp1, fp2; checkpointed)."""
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    reps = side.select("rep").distinct()
    theirs = texts.join(reps, texts["doc_id"].eqNullSafe(reps["rep"]), "left_semi").mapInArrow(tidied(_sets), "doc_id long, fp1 long, fp2 long, u binary")
    # an id that repeats, or a null one, can stand for several texts: the set's fingerprint decides
    return theirs.alias("t").join(side.alias("s"), F.expr("t.doc_id <=> s.rep and t.fp1 = s.fp1 and t.fp2 = s.fp2")).groupBy("cid").agg(F.first("u").alias("u"))


def _compared(texts: DataFrame, classes: DataFrame, groups: DataFrame, count: bool) -> DataFrame:
    """(a, b, n) as of _links(), of all pairs of sets in each of ``groups``. (Checkpointed.)"""
    chosen = cut(classes.select("cid", "rep", "fp1", "fp2", "n").join(groups.select(F.col("node").alias("cid"), "component"), "cid"))
    blocks = chosen.groupBy("component").agg(F.ceil(F.sum("n") / CELL).cast("long").alias("blocks"))
    of = chosen.select("cid", "component").join(blocks, "component")
    cells = _dealt(_sets_of(texts, chosen.select("cid", "rep", "fp1", "fp2")).join(of, "cid"), "component", ["cid", "u"])
    return cut(cells.mapInArrow(tidied(_links(count)), "a long, b long, n long"))


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_links: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, classes, links, counts): members (doc_id, fp1, fp2, text_hash) has a row for each
    input row; classes (cid, rep, size, n, fp1, fp2) a row for each distinct set; links (a, b) are
    pairs that connect the classes that verified matches connect; counts (cid, n_links) how
    many other sets match a set, of those with any, and is empty without ``with_links``."""
    texts = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    records = cut(texts.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").mapInArrow(tidied(_records), RECORD))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "n", "s", "t", "pool")).alias("r")
    grouped = records.groupBy("fp1", "fp2").agg(first, F.count(F.lit(1)).alias("size"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("cid"), F.col("r.doc_id").alias("rep"), "size", "fp1", "fp2", *[F.col(f"r.{c}").alias(c) for c in ("n", "s", "t", "pool")]))
    found = _compared(texts, classes, _candidates(classes), with_links)
    counts = found.filter("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links"))
    members = records.select("doc_id", "fp1", "fp2", "text_hash")
    return members, classes.select("cid", "rep", "size", "n", "fp1", "fp2"), found.filter("b is not null").select("a", "b"), counts


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False, with_links: bool = True) -> DataFrame:
    """One row for each input row: doc_id, class_id (smallest id among all documents that links
    connect), n_links (other sets that match its set), text_class (smallest id with the same set),
    n_same (documents with that set). ``with_hash`` adds text_hash and class_key, which is the
    class's own number; without ``with_links`` there is no n_links, and nothing is counted for it."""
    members, classes, links, counts = near_join(docs, id_col, text_col, with_links)
    linked = classes.select("cid", "rep").join(connected_components(links).withColumnRenamed("node", "cid"), "cid")
    root = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    of = linked.join(root, "component").select("cid", "component", "class_id")
    told = []
    if with_links:
        of = of.join(counts, "cid")
        told = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    whole = classes.join(of, "cid", "left").select(
        "fp1", "fp2", F.coalesce("class_id", "rep").alias("class_id"), *told,
        F.col("rep").alias("text_class"), F.col("size").alias("n_same"), F.coalesce("component", "cid").alias("class_key"),
    )
    found = join_by_hot_key(members, cut(whole), ["fp1", "fp2"], "n_same").drop("fp1", "fp2")
    return found if with_hash else found.drop("text_hash", "class_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, with its own columns: that with the smallest id, and of
    rows with that id the one whose text hashes lowest, then the one whose columns do."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    classes = cut(near_duplicate_classes(docs, id_col, text_col, with_hash=True, with_links=False).select("doc_id", "class_key", "text_hash"))
    # the narrow rows of a hot class meet as one minimum of each task
    kept = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash"))
    dropped = classes.select("doc_id", "text_hash").distinct().exceptAll(kept)
    left = without(docs, [docs[id_col].cast("long"), F.xxhash64(text)], dropped)
    if classes.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return left
    # rows that agree in id and text; whole rows take part in the partial aggregation
    row = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.col(id_col).alias("_id"), text.alias("_t"), same_order(left).alias("_o"))
    return row.groupBy("_id", "_t").agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
