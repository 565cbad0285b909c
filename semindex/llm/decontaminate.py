"""Benchmark decontamination (operator 10) by spaced seeds, DataFrame operations only.

Texts become lower-case words (runs of letters and digits). A window of WINDOW words matches when
at most TOLERANCE words of it differ from a window of a benchmark item. The WINDOW positions fall
into TOLERANCE + 1 classes by remainder; each fixed mask reads one class and ignores the others,
so any TOLERANCE substitutions leave one mask untouched: the seeds miss nothing. Hashes of all
masks at all positions of all documents meet the hashes of the benchmark; around each hit the
whole window is compared word by word.

Items of MIN_WORDS to WINDOW - 1 words are windows of their own length, with the same share of
substitutions (one from six words on, none at five) and as many masks. Shorter items are too common
in any text to be evidence: they match documents that hold nothing else. One pass over the documents
makes the seeds of all lengths.

Null texts count as empty. Equal windows of several items are one row of the benchmark's side, so
copies there don't multiply hits. Ids may repeat or be null in the benchmark; rows of ``docs`` with
equal ids count as one document, while null ids are told apart by their texts. Very long texts are
read whole. Empty tables give empty results; other columns are not read.

The benchmark's distinct windows are broadcast if there are BROADCAST_WINDOWS at most (counted
first); beyond that the hashes meet in a shuffle join, which Spark splits where it is skewed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import cut, table, text_or_empty, without

WINDOW, TOLERANCE, MIN_WORDS = 12, 2, 5
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _reach(size: int, masks: int) -> int:
    """Words from the first to the last that a seed reads."""
    return (size // masks - 1) * masks + 1


def _seeds(w: Column, size: int, masks: int) -> Column:
    """Entry p is the hash of the words at p, p + masks, p + 2 masks, ... within a window's reach.

    Mask m at window start s reads the words from s + m on in steps of ``masks``, which is entry
    s + m: one hash at each position serves all masks.
    """
    last = F.size(w) - _reach(size, masks)

    def seed(p: Column) -> Column:
        return F.xxhash64(*[F.get(w, p + step) for step in range(0, _reach(size, masks), masks)], F.lit(size))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _slices(w: Column, size: int) -> Column:
    """All runs of ``size`` words; ``w`` has as many words at least."""

    def run(first: Column) -> Column:
        return F.slice(w, first, size)

    return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), run)


def _windows(items: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(_item, _bw): all windows of items, shorter items as one."""
    every = []
    for size in sizes:
        sized = items.filter(F.size("_w") >= size) if size == window else items.filter(F.size("_w") == size)
        every.append(sized.select(F.col("_id").alias("_item"), F.explode(_slices(F.col("_w"), size)).alias("_bw")))
    return functools.reduce(DataFrame.unionByName, every)


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int, tolerance: int) -> DataFrame:
    """find_overlaps() with _h, which tells null ids apart and is 0 for others."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(0).alias("_h"), words(text).alias("_w"))
    items = cut(benchmark.select(F.col(item_id).alias("_id"), words(text_or_empty(item_text)).alias("_w")).filter(F.size("_w") > 0))
    # at most WINDOW lengths
    lengths = sorted(r[0] for r in items.filter(F.size("_w") < window).select(F.size("_w")).distinct().collect())
    sizes = [window, *(n for n in lengths if n >= MIN_WORDS)]
    masks = {size: size * tolerance // window + 1 for size in sizes}
    sides, before, offset = [], F.lit(0), F.lit(0)
    for size in sizes:
        # one row for each distinct window and mask; the items of a window travel apart from it
        distinct = _windows(items, [size], window).select("_bw").distinct()
        sides.append(distinct.select("_bw", F.posexplode(_seeds(F.col("_bw"), size, masks[size])).alias("_mask", "_seed"), F.lit(masks[size] - 1).alias("_allowed")))
        if size != window:  # where this length's seeds start among all seeds of a document
            offset = F.when(F.size("_bw") == size, before).otherwise(offset)
        before = before + F.greatest(F.lit(0), F.size("_w") - (_reach(size, masks[size]) - 1))
    seeds = cut(functools.reduce(DataFrame.unionByName, sides))
    side = F.broadcast(seeds) if seeds.count() <= BROADCAST_WINDOWS else seeds
    made = [_seeds(F.col("_w"), size, masks[size]) for size in sizes]
    every = base.select("_id", "_h", "_w", F.posexplode(F.concat(*made) if len(made) > 1 else made[0]).alias("_at", "_seed"))
    start = F.col("_at") - F.col("_mask") - offset
    window_words = F.slice("_w", start + 1, F.size("_bw"))
    differ = F.aggregate(F.zip_with(window_words, F.col("_bw"), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    inside = (start >= 0) & (start + F.size("_bw") <= F.size("_w"))
    hits = every.join(side, "_seed").select("_id", "_h", start.alias("_start"), "_bw", "_allowed", F.when(inside, differ).alias("_differ"))
    found = hits.filter(F.col("_differ") <= F.col("_allowed")).select("_id", "_h", "_start", "_bw")
    tiny = items.filter(F.size("_w") < MIN_WORDS)
    owned = _windows(items, sizes, window)
    if lengths and lengths[0] < MIN_WORDS:
        whole = base.filter(F.size("_w") < MIN_WORDS).join(tiny.select(F.col("_w").alias("_bw")).distinct(), F.col("_w") == F.col("_bw"))
        found = found.unionByName(whole.select("_id", "_h", F.lit(0).alias("_start"), "_bw"))
        owned = owned.unionByName(tiny.select(F.col("_id").alias("_item"), F.col("_w").alias("_bw")))
    # which items: by the content of the window, once for each document and content
    contents = found.groupBy("_id", "_h", "_bw").agg(F.min("_start").alias("_first"), F.collect_set("_start").alias("_starts"))
    owners = owned.groupBy("_bw").agg(F.min("_item").alias("_item"), F.collect_set("_item").alias("_items"))
    return (
        contents.join(owners, "_bw", "left")
        .groupBy(F.col("_id").alias("doc_id"), "_h")
        .agg(
            F.min("_item").alias("item_id"),
            F.size(F.array_distinct(F.flatten(F.collect_set("_items")))).cast("long").alias("n_items"),
            F.size(F.array_distinct(F.flatten(F.collect_list("_starts")))).cast("long").alias("n_windows"),
            F.min("_first").cast("long").alias("first_word"),
        )
    )


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, tolerance: int = TOLERANCE,
) -> DataFrame:
    """One row for each contaminated document: doc_id, item_id (smallest item that it overlaps),
    n_items, n_windows (window starts with an overlap), first_word (where the first one starts)."""
    return _overlaps(docs, benchmark, id_col, text_col, item_id, item_text, window, tolerance).drop("_h")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any overlap, with its own columns."""
    found = _overlaps(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW, TOLERANCE).select("doc_id", "_h")
    told = F.when(docs[id_col].isNull(), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))).otherwise(0)
    return without(docs, [docs[id_col], told], found)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS w FROM documents
), b AS (
  SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS w FROM benchmark
), sizes AS (
  SELECT {WINDOW} AS size, {TOLERANCE} AS allowed
  UNION SELECT len(w), len(w) * {TOLERANCE} // {WINDOW} FROM b WHERE len(w) BETWEEN {MIN_WORDS} AND {WINDOW - 1}
), dw AS (
  SELECT doc_id, size, allowed, s, w[s : s + size - 1] AS x FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(s)
), bw AS (
  SELECT item_id, size, allowed, w[s : s + size - 1] AS x FROM b, sizes, unnest(range(1, len(w) - size + 2)) AS u(s)
  WHERE size = {WINDOW} OR len(w) = size
), dk AS (
  SELECT *, m, [y FOR y, i IN x IF (i - 1) % (allowed + 1) = m] AS k FROM dw, unnest(range(0, allowed + 1)) AS v(m)
), bk AS (
  SELECT *, m, [y FOR y, i IN x IF (i - 1) % (allowed + 1) = m] AS k FROM bw, unnest(range(0, allowed + 1)) AS v(m)
), hit AS (
  SELECT DISTINCT doc_id, item_id, s FROM dk JOIN bk USING (size, allowed, m, k)
  WHERE list_sum([CASE WHEN y <> bk.x[i] THEN 1 ELSE 0 END FOR y, i IN dk.x]) <= allowed
  UNION SELECT doc_id, item_id, 1 FROM d JOIN b USING (w) WHERE len(w) BETWEEN 1 AND {MIN_WORDS - 1}
)
SELECT doc_id, min(item_id) AS item_id, count(DISTINCT item_id) AS n_items, count(DISTINCT s) AS n_windows,
       min(s) - 1 AS first_word
FROM hit GROUP BY doc_id
"""
