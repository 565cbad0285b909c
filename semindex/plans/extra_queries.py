"""Queries through the larger operators (chunking, embedding, search, streaming)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semindex.functions import embedding, ranking, rules
from semindex.functions import text as T
from semindex.operators import context, ivf, merkle, mutate, topk
from semindex.operators.chunking.files import raw_pieces
from semindex.plans.queries import query, table
from semindex.streaming.incremental import windowed_counts


def _text_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "doc_id")


@query("""WITH RECURSIVE l AS (
  SELECT doc_id, i, line, length(line) + 1 AS size FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> ''))
), w AS (
  SELECT doc_id, i, size AS used, 1::BIGINT AS first, 1 AS n FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN w.used + l.size > 8000 OR l.i - w.first + 1 > 200 THEN l.size ELSE w.used + l.size END,
    CASE WHEN w.used + l.size > 8000 OR l.i - w.first + 1 > 200 THEN l.i ELSE w.first END, CASE WHEN w.used + l.size > 8000 OR l.i - w.first + 1 > 200 THEN w.n + 1 ELSE w.n END
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1
)
SELECT doc_id, concat('doc', doc_id, '.txt:', n) AS name, first::INT AS start_line, max(w.i)::INT AS end_line, md5(string_agg(line, chr(10) ORDER BY l.i)) AS content_md5
FROM w JOIN l USING (doc_id, i) GROUP BY doc_id, n, first""")
def text_chunks(spark, sf_dir):
    doc = F.regexp_extract("relative_path", r"doc(\d+)\.txt$", 1).cast("long")
    return raw_pieces(_text_files(spark, sf_dir)).select(doc.alias("doc_id"), "name", "start_line", "end_line", F.md5("content").alias("content_md5"))


_MD = "m AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || '# '), chr(10)) AS ls FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) <> '')"


@query(f"""WITH {_MD}
SELECT doc_id, CASE WHEN len(ls) = 1 THEN 'document' WHEN i = 1 THEN 'preamble' ELSE 'section' END AS node_type, i::INT AS start_line, i::INT AS end_line, md5(CASE WHEN len(ls) > 1 AND i = 1 THEN trim(ls[i], ' ' || chr(9)) ELSE ls[i] END) AS content_md5
FROM m, unnest(range(1, len(ls) + 1)) AS u(i) WHERE NOT (i = 1 AND len(ls) > 1 AND trim(ls[1], ' ' || chr(9)) = '')""")
def markdown_sections(spark, sf_dir):
    """Every line after the first becomes a heading, so sections are lines."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# ")).alias("content"))
    doc = F.regexp_extract("relative_path", r"doc(\d+)\.md$", 1).cast("long")
    return raw_pieces(files).filter("language = 'markdown'").select(doc.alias("doc_id"), "node_type", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query("""WITH h AS (SELECT page_id, html, regexp_extract(html, '<html(.*</html>|.*)', 0, 's') AS c FROM pages), l AS (SELECT *, length(split_part(html, c, 1)) - length(replace(split_part(html, c, 1), chr(10), '')) + 1 AS first FROM h)
SELECT 'p' || page_id || '.html' AS relative_path, 'element' AS node_type, 'html' AS name, first::INT AS start_line, (first + length(c) - length(replace(c, chr(10), '')))::INT AS end_line, md5(c) AS content_md5 FROM l""")
def html_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return raw_pieces(pages).select("relative_path", "node_type", "name", "start_line", "end_line", F.md5("content").alias("content_md5"))


def _indexed(spark, sf_dir):
    """conversations as an index: a turn is a chunk."""
    from semindex.plans.queries import _chunks

    chunks = _chunks(spark, sf_dir).withColumn("docstring", F.lit(None).cast("string"))
    return chunks.withColumn("embedding", embedding.embed(F.col("content")))


@query()
def search_lifecycle(spark, sf_dir):
    """Embed, filter, top-k, re-rank and context for one query."""
    asked = "how does the database connection work"
    rows = _indexed(spark, sf_dir)
    near = topk.search_top_k(rows, embedding.embed_query(asked), topk.widened(5, False), F.arrays_overlap("tags", F.array(F.lit("user"))))
    best = topk.rerank(near.withColumn("content_preview", F.col("content")), asked, 5).drop("embedding")
    around = context.with_context(rows.drop("embedding"), best).select("chunk_id", "neighbours", "chunks_in_file")
    return best.select("chunk_id", "relative_path", F.round("score", 6).alias("score"), F.round("rank_score", 6).alias("rank_score")).join(around, "chunk_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_incremental(spark, sf_dir):
    """All events through a stream that merges each micro-batch into a table by key."""
    from semindex.sources.store import VersionedTable, shared_folder

    base = shared_folder(spark, "stream")
    store = VersionedTable(spark, f"{base}/table", "event_id long, event_type string, user_id long")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def merge(batch, _):
        rows = mutate.last_of_each(batch.select("event_id", "event_type", "user_id"), "event_id", "event_type")
        store.write(mutate.upsert(store.read(), rows, "event_id"))

    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))



@query("SELECT 1::BIGINT AS same_as_itself, 0::BIGINT AS same_as_changed")
def quick_check(spark, sf_dir):
    """Root hashes of the corpus, of itself, and of the corpus with a changed text in one language."""
    from semindex.plans.queries import _versions

    old, new = (merkle.build(s.withColumn("content", F.encode("content", "UTF-8")), "corpus") for s in _versions(spark, sf_dir))
    root = lambda nodes, name: nodes.filter(F.col("path") == merkle.ROOT).select(F.col("hash").alias(name))
    both = root(old, "a").join(root(old, "b")).join(root(new, "c"))
    return both.select((F.col("a") == F.col("b")).cast("long").alias("same_as_itself"), (F.col("a") == F.col("c")).cast("long").alias("same_as_changed"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 2 = 0 THEN 'async' END, CASE WHEN turn % 3 = 0 THEN 'generator' END, CASE WHEN conv_id % 2 = 0 THEN 'export' END,
  CASE WHEN conv_id % 3 = 0 THEN 'generic' END, CASE WHEN role = 'user' THEN 'component' END, 'python') AS tags FROM conversations""")
def semantic_tags(spark, sf_dir):
    by = lambda column, n: F.col(column) % n == 0
    made = rules.semantic_tags(by("turn", 2), by("turn", 3), by("conv_id", 2), by("conv_id", 3), F.col("role") == "user", F.lit("python"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(made, ",").alias("tags"))


_RULES = ", ".join(f"('{x}', {'NULL' if x not in rules.ENDING_LANGUAGE else repr(rules.ENDING_LANGUAGE[x])}, {str(x in rules.TEXT_ENDINGS).lower()})" for x in rules.SUPPORTED)


@query(f"""WITH p AS (SELECT page_id, lower(regexp_extract(split_part(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/', -1), '[^.].*?([.][^.]*[^.])$', 1)) AS ending FROM pages), r(ending, language, is_text) AS (VALUES {_RULES})
SELECT page_id, ending, language, is_text FROM p JOIN r USING (ending)""")
def language_join(spark, sf_dir):
    """Files meet their language by a join with the rule table (broadcast, a row for each ending)."""
    from semindex.plans.queries import _paths

    files = _paths(spark, sf_dir).select("page_id", rules.ending(F.col("path")).alias("ending"))
    return files.join(F.broadcast(rules.language_rules(spark)), "ending").select("page_id", "ending", "language", "is_text")


@query("SELECT conv_id, turn, upper(role) AS role FROM conversations WHERE array_has_any([role, 'conv' || conv_id], ['user', 'conv3']) AND role IS NOT NULL")
def tag_filter(spark, sf_dir):
    wanted = F.array(F.lit("user"), F.lit("conv3"))
    tags = F.array("role", F.concat(F.lit("conv"), F.col("conv_id").cast("string")))
    return table(spark, sf_dir, "conversations").filter(F.arrays_overlap(tags, wanted)).select("conv_id", "turn", F.upper("role").alias("role"))


@query("""SELECT 'conv' || conv_id AS file, (turn + 1) || '-' || (turn + 1) AS lines, 'turn' AS kind, round((turn + 1) / 8.0, 2) AS score, md5(concat_ws(':', 'conv' || conv_id, coalesce(role, 'None'), (turn + 1)::VARCHAR, 'turn')) AS chunk_id, role AS name FROM conversations""")
def search_serialisation(spark, sf_dir):
    from semindex.plans.queries import _chunks
    from semindex.plans.service import search_rows

    rows = _chunks(spark, sf_dir).withColumn("score", F.col("start_line") / 8.0)
    return search_rows(rows).drop("snippet")


@query("""SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) FILTER (vec_id % 50 = 0) * least(10, count(*)) AS n_exact, true AS recall_reached FROM embeddings""")
def vector_topk_ivf(spark, sf_dir):
    """Approximate top-k of every vector whose id is divisible by 50 among all vectors, held against
    the exact one: is the recall 0.9 or more?"""
    corpus = table(spark, sf_dir, "embeddings")
    centroids = ivf.train(corpus, "vec_id")
    asked = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = ivf.search_batch(ivf.assign(corpus, centroids), centroids, asked, 10, ivf.probes_for(len(centroids)), id_col="vec_id")
    exact = topk.top_k_batch(corpus, asked, 10, "vec_id", "embedding")
    both = exact.select("query_id", "id").join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


_KINDS = ("class", "function", "method", "module", "section")
#: Queries for a class, for a name, and a request with two intents.
_ASKED = {"of_class": "class handler", "of_name": "UserToken", "of_request": "how does the database connection work"}


@query("""WITH p AS (SELECT p_partkey, ['class', 'function', 'method', 'module', 'section'][(p_size % 5 + 1)::INT] AS kind, p_size % 3 = 0 AS tagged, p_size % 2 = 0 AS told, CASE WHEN p_size % 7 = 0 THEN 0.98 ELSE 1.0 END::DOUBLE AS long FROM part),
f(kind, c, n, r) AS (VALUES ('class', 1.3::DOUBLE, 1.15::DOUBLE, 1.05::DOUBLE), ('function', 1.05, 1.1, 1.1), ('method', 1.05, 1.1, 1.1), ('module', 0.9, 0.92, 0.95), ('section', 1.0, 1.0, 1.0))
SELECT p_partkey, kind, round(c * long * CASE WHEN tagged THEN 1.1 ELSE 1 END::DOUBLE * d, 9) AS of_class, round(n * long * d, 9) AS of_name,
  round(r * long * CASE WHEN tagged THEN 1.2 ELSE 1 END::DOUBLE * CASE WHEN told THEN 1.05 ELSE 1 END::DOUBLE, 9) AS of_request
FROM (SELECT *, CASE WHEN NOT told THEN 1.0 WHEN kind = 'module' THEN 1.02 ELSE 1.05 END::DOUBLE AS d FROM p JOIN f USING (kind))""")
def rank_branches(spark, sf_dir):
    """Type, tag, docstring and length factors for every kind of query."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_size") % 5).cast("int"))
    tags = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("database"), F.lit("function_search"))).otherwise(F.array().cast("array<string>"))
    told = F.when(F.col("p_size") % 2 == 0, "told")
    preview = F.when(F.col("p_size") % 7 == 0, F.repeat(F.lit("x"), F.lit(1001))).otherwise(F.repeat(F.lit("x"), F.lit(1000)))
    scores = [F.round(ranking.rank_score(F.lit(q), F.lit(1.0), F.col("kind"), F.lit(""), F.lit(""), F.col("tags"), F.col("told"), F.col("preview")), 9).alias(n) for n, q in _ASKED.items()]
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), tags.alias("tags"), told.alias("told"), preview.alias("preview"))
    return rows.select("p_partkey", "kind", *scores)


@query("SELECT p_partkey, 256 AS dimension, 1.0::DOUBLE AS norm, true AS same_again FROM part")
def embedding_vectors(spark, sf_dir):
    """Names embedded in batches by a model that is looked up by its name: unit vectors, and the same
    for queries and documents, as the default model encodes both alike."""
    model = embedding.resolve("local/hashing-256")
    rows = table(spark, sf_dir, "part").select("p_partkey", embedding.embed(F.col("p_name"), model).alias("v"), embedding.embed(F.col("p_name"), model, queries=True).alias("q"))
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4)
    return rows.select("p_partkey", F.size("v").alias("dimension"), norm.alias("norm"), (F.col("v") == F.col("q")).alias("same_again"))


@query("SELECT conv_id, turn, md5(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS query_md5 FROM conversations")
def query_trim(spark, sf_dir):
    asked = F.concat(F.lit(" \t\n\x0b "), F.coalesce("text", F.lit("")), F.lit("\r\x0c \n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.trim_query(asked)).alias("query_md5"))


@query("""SELECT p_type || '/' || p_partkey AS file_path, p_size || '-' || (p_size + 2) AS lines, 'function' AS chunk_type, p_name AS name, round(p_size / 64.0, 3)::DOUBLE AS similarity_score, p_brand AS content_preview, 'a,' || p_size AS tags FROM part""")
def similar_serialisation(spark, sf_dir):
    from semindex.plans.service import similar_rows

    rows = table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("relative_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 2).alias("end_line"), F.lit("function").alias("chunk_type"),
        F.col("p_name").alias("name"), (F.col("p_size") / 64.0).alias("score"), F.col("p_brand").alias("content_preview"), F.array(F.lit("a"), F.col("p_size").cast("string")).alias("tags"),
    )
    return similar_rows(rows).withColumn("tags", F.array_join("tags", ","))
