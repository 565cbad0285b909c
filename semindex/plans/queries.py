"""Registered queries over the given tables, each beside its SQL.

``documents`` stands for files (source = folder, doc_id = file name), ``conversations`` for chunks of
a file in order, ``embeddings`` for the vector index, ``pages.url`` for paths, ``events`` for the
history of snapshots, ``part`` for named chunks. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.functions import globs, ids, ranking, rules, vectors
from semindex.functions import text as T
from semindex.operators import changes, context, index_stats, merkle, mutate, snapshots, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors -----------------------------------------------------------------------------------

_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_E = f"e AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings)"
_Q = "q AS (SELECT u AS qu FROM e WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _probe(spark: SparkSession, sf_dir: str) -> tuple[int, list[float]]:
    """The vector with the smallest id is the query."""
    return tuple(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("vec_id", "embedding").first())


def _scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("vec_id", *columns, F.round("score", 6).alias("score"))


@query(f"WITH {_E}, {_Q} SELECT vec_id, label, round(list_inner_product(u, qu), 6) AS score FROM e, q ORDER BY list_inner_product(u, qu) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return _scored(topk.top_k(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir)[1], 10, "vec_id"), "label")


@query(f"""WITH {_E}, s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.u, b.u) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""")
def vector_topk_batch(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = topk.top_k_batch(corpus, queries, 5, "vec_id", "embedding", exclude_self=True)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_E}, {_Q} SELECT vec_id, label, round(list_inner_product(u, qu), 6) AS score FROM e, q WHERE label = 3 ORDER BY list_inner_product(u, qu) DESC, vec_id LIMIT 10")
def vector_topk_prefilter(spark, sf_dir):
    found = topk.search_top_k(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir)[1], 10, F.col("label") == 3, "pre", "vec_id")
    return _scored(found, "label")


@query(f"""WITH {_E}, {_Q}, c AS (SELECT vec_id, label, list_inner_product(u, qu) AS s FROM e, q ORDER BY s DESC, vec_id LIMIT 200)
SELECT vec_id, label, round(s, 6) AS score FROM c WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10""")
def vector_topk_postfilter(spark, sf_dir):
    found = topk.search_top_k(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir)[1], 10, F.col("label") == 3, "post", "vec_id")
    return _scored(found, "label")


@query(f"""WITH {_E}, {_Q}, c AS (SELECT vec_id, label, list_inner_product(u, qu) AS s FROM e, q ORDER BY s DESC, vec_id LIMIT 15)
SELECT vec_id, label, round(s, 6) AS score FROM c WHERE vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY s DESC, vec_id LIMIT 5""")
def similar_to_chunk(spark, sf_dir):
    own, vector = _probe(spark, sf_dir)
    near = topk.top_k(table(spark, sf_dir, "embeddings"), vector, topk.similar_fetch(5), "vec_id")
    return _scored(near.filter(F.col("vec_id") != own).orderBy(F.desc("score"), "vec_id").limit(5), "label")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def l2_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


# --- hashes, trees, differences ----------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


_FILES = "f AS (SELECT source, concat(source, '/doc', doc_id, '.txt') AS path, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)"
_DIRS = "d AS (SELECT source AS path, sha256(concat(source, string_agg(hash, '' ORDER BY hash))) AS hash, sum(size)::BIGINT AS size FROM f GROUP BY source)"
_ROOT = "r AS (SELECT sha256(concat('corpus', string_agg(hash, '' ORDER BY hash))) AS hash, sum(size)::BIGINT AS size FROM d)"


@query(f"WITH {_FILES} SELECT path, hash, size FROM f")
def content_hash(spark, sf_dir):
    return merkle.file_nodes(_files(spark, sf_dir)).select("path", "hash", "size")


@query(f"WITH {_FILES}, {_DIRS}, {_ROOT} SELECT path, hash, size, false AS is_file FROM d UNION ALL SELECT path, hash, size, true FROM f UNION ALL SELECT '.', hash, size, false FROM r")
def merkle_nodes(spark, sf_dir):
    return merkle.build(_files(spark, sf_dir), "corpus").select("path", "hash", "size", "is_file")


@query(f"WITH {_FILES}, {_DIRS}, {_ROOT} SELECT hash AS root_hash, size AS total_size, (SELECT count(*) FROM f) AS file_count, (SELECT count(*) + 1 FROM d) AS directory_count, (SELECT count(*) FROM f) + (SELECT count(*) + 1 FROM d) AS node_count FROM r")
def dag_stats(spark, sf_dir):
    return merkle.stats(merkle.build(_files(spark, sf_dir), "corpus"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus by rule: the new one lacks texts in one language, has every text in
    another one extended, and has a new file for each source."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    old = docs.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), "lang")
    new = old.filter("lang <> 'es'").withColumn("content", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    fresh = docs.select(F.concat(F.col("source"), F.lit("/README.md")).alias("path"), F.col("source").alias("content")).distinct()
    return old.select("path", "content"), new.select("path", "content").unionByName(fresh)


_STATES = """a AS (SELECT concat(source, '/doc', doc_id, '.txt') AS path, coalesce(text, '') AS content, lang FROM documents),
o AS (SELECT path, sha256(content) AS hash FROM a),
n AS (SELECT path, sha256(CASE WHEN lang = 'fr' THEN content || '!' ELSE content END) AS hash FROM a WHERE lang <> 'es'
      UNION ALL SELECT DISTINCT source || '/README.md', sha256(source) FROM documents),
c AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change_type,
      o.hash AS old_hash, n.hash AS new_hash FROM o FULL JOIN n ON o.path = n.path)"""


def _diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return changes.diff(*[s.select("path", F.sha2("content", 256).alias("hash")) for s in (old, new)])


@query(f"WITH {_STATES} SELECT * FROM c")
def change_detect(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"WITH {_STATES} SELECT {', '.join(f'count(*) FILTER (change_type = {k!r}) AS {k}' for k in ('added', 'removed', 'modified', 'unchanged'))}, count(*) FILTER (change_type <> 'unchanged') AS total_changed FROM c")
def change_summary(spark, sf_dir):
    return changes.summary(_diff(spark, sf_dir))


@query(f"""WITH {_STATES}, x AS (SELECT * FROM c WHERE change_type <> 'unchanged')
SELECT 'file_extensions' AS category, regexp_extract(path, '\\.[^./]+$') AS value, count(*) AS count FROM x GROUP BY 2
UNION ALL SELECT 'directories', split_part(path, '/', 1), count(*) FROM x GROUP BY 2
UNION ALL SELECT 'change_types', change_type, count(*) FROM x GROUP BY 2""")
def change_patterns(spark, sf_dir):
    return changes.patterns(_diff(spark, sf_dir))


@query(f"""WITH {_STATES}, od AS (SELECT split_part(path, '/', 1) AS path, string_agg(hash, '' ORDER BY hash) AS h FROM o GROUP BY 1),
nd AS (SELECT split_part(path, '/', 1) AS path, string_agg(hash, '' ORDER BY hash) AS h FROM n GROUP BY 1)
SELECT nd.path FROM nd LEFT JOIN od USING (path) WHERE od.h IS DISTINCT FROM nd.h
UNION ALL SELECT '.' WHERE (SELECT string_agg(path || h, '' ORDER BY path) FROM od) <> (SELECT string_agg(path || h, '' ORDER BY path) FROM nd)""")
def changed_dirs(spark, sf_dir):
    old, new = (merkle.build(s.withColumn("content", F.encode("content", "UTF-8")), "corpus") for s in _versions(spark, sf_dir))
    return changes.changed_directories(old, new)


@query(f"WITH {_STATES} SELECT path FROM c WHERE change_type IN ('added', 'modified')")
def files_to_reindex(spark, sf_dir):
    return changes.to_reindex(_diff(spark, sf_dir))


@query(f"WITH {_STATES} SELECT path FROM c WHERE change_type IN ('removed', 'modified')")
def files_to_remove(spark, sf_dir):
    return changes.to_remove(_diff(spark, sf_dir))


# --- paths and rules ---------------------------------------------------------------------------

_PATHS = r"p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(f"WITH {_PATHS} SELECT page_id, path FROM p WHERE regexp_full_match(path, '.*/[^/]*1[0-9]/?[^/]*') OR regexp_full_match(path, '(.*/)?.*/en/.*') OR regexp_full_match(path, '.*[.]html')")
def glob_filter(spark, sf_dir):
    return _paths(spark, sf_dir).filter(globs.matches_globs(F.col("path"), ["*/en/*", "*.html"]) | F.col("path").rlike("^.*/[^/]*1[0-9]/?[^/]*$"))


_ENDINGS = ", ".join(f"('{a}', '{b}')" for a, b in rules.ENDING_LANGUAGE.items())
_SUPPORTED = ", ".join(f"'{x}'" for x in rules.SUPPORTED)


@query(f"""WITH {_PATHS}, x AS (SELECT page_id, path, lower(regexp_extract(split_part(path, '/', -1), '[^.].*?([.][^.]*[^.])$', 1)) AS ending FROM p), m(ending, language) AS (VALUES {_ENDINGS})
SELECT page_id, ending, language, ending IN ({_SUPPORTED}) AS supported FROM x LEFT JOIN m USING (ending)""")
def extension_routing(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("page_id", rules.ending(path).alias("ending"), rules.language(path).alias("language"), rules.is_supported(path).alias("supported"))


@query(f"WITH {_PATHS} SELECT page_id, array_to_string(string_split(path, '/')[:-2], '|') AS folders, len(string_split(path, '/')) - 1 AS depth FROM p")
def folder_structure(spark, sf_dir):
    parts = T.folder_parts(F.col("path"))
    return _paths(spark, sf_dir).select("page_id", F.array_join(parts, "|").alias("folders"), F.size(parts).cast("long").alias("depth"))


_IGNORED = ", ".join(f"'{x}'" for x in rules.IGNORED if not x.startswith("*"))


@query(f"""WITH {_PATHS} SELECT page_id, path FROM p WHERE NOT (len(list_intersect(string_split(path, '/'), [{_IGNORED}])) > 0
OR len([x FOR x IN string_split(path, '/') IF ends_with(x, '.pyc') OR ends_with(x, '.pyo')]) > 0)""")
def ignore_pruning(spark, sf_dir):
    return _paths(spark, sf_dir).filter(~rules.is_ignored(F.col("path")))


_NODES = ", ".join(f"('{a}', '{b}')" for a, b in rules.NODE_CHUNK_TYPE.items())


@query(f"""WITH n AS (SELECT conv_id, turn, list_extract([x FOR x IN {sorted(rules.NODE_CHUNK_TYPE)!r}], ((conv_id + turn) % {len(rules.NODE_CHUNK_TYPE)} + 1)::INT) AS node, CASE WHEN role = 'user' THEN 'Parent' END AS parent FROM conversations),
m(node, kind) AS (VALUES {_NODES})
SELECT conv_id, turn, node, CASE WHEN parent IS NOT NULL AND kind = 'function' THEN 'method' ELSE coalesce(kind, node) END AS chunk_type FROM n LEFT JOIN m USING (node)""")
def chunk_type_rules(spark, sf_dir):
    nodes = F.array(*[F.lit(x) for x in sorted(rules.NODE_CHUNK_TYPE)])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(nodes, ((F.col("conv_id") + F.col("turn")) % len(rules.NODE_CHUNK_TYPE)).cast("int")).alias("node"), F.when(F.col("role") == "user", "Parent").alias("parent"))
    return rows.select("conv_id", "turn", "node", rules.chunk_type(F.col("node"), F.col("parent")).alias("chunk_type"))


# --- query text --------------------------------------------------------------------------------

_INTENTS = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{T.intent_pattern(name)}') THEN '{name}' END" for name in rules.INTENTS)


@query(f"SELECT conv_id, turn, array_to_string([x FOR x IN [{_INTENTS}] IF x IS NOT NULL], ',') AS intents FROM conversations")
def intent_detect(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.intents(F.col("text")), ",").alias("intents"))


_WORDS = "regexp_extract_all(lower(translate(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"SELECT conv_id, turn, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations)")
def tokenise(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS.format('p_name')}) AS token FROM part) GROUP BY token")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_ACTIONS = ", ".join(f"'{w}'" for w in rules.ACTION_WORDS)


@query(f"""WITH w AS (SELECT conv_id, turn, text, {_WORDS.format('lower(text)')} AS w FROM conversations)
SELECT conv_id, turn, len(w) <= 3 AND len(list_intersect(w, [{_ACTIONS}])) = 0 AND (regexp_matches(text, '[A-Z][a-z]+[A-Z]') OR len(w) <= 2) AS entity_like FROM w""")
def entity_like(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.entity_like(F.col("text")).alias("entity_like"))


_SPACE = "[\\s\\x1C-\\x1F]"


@query(f"""WITH l AS (SELECT doc_id, [trim(regexp_replace(x, '{_SPACE}+', ' ', 'g')) FOR x IN string_split(coalesce(text, ''), chr(10))] AS x FROM documents),
s AS (SELECT doc_id, coalesce([y FOR y IN x IF y <> ''][1], '') AS s FROM l)
SELECT doc_id, CASE WHEN length(s) > 160 THEN s[:157] || '...' ELSE s END AS snippet FROM s""")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


RANK_QUERY = "small blue ring"
_QW = "['small', 'blue', 'ring']"


@query(f"""WITH w AS (SELECT *, {_WORDS.format('p_name')} AS nw, {_WORDS.format("translate(lower(p_type || '/' || p_brand), '/', ' ')")} AS pw FROM part),
s AS (SELECT *, len(list_intersect(list_distinct(nw), {_QW})) / 3.0 AS share, len(list_intersect(list_distinct(pw), {_QW})) AS shared FROM w)
SELECT p_partkey, round(name_boost, 6) AS name_boost, round(path_boost, 6) AS path_boost,
  round(p_retailprice / 1000 * name_boost * path_boost * CASE WHEN p_size % 2 = 0 THEN 1.05 ELSE 1.1 END * CASE WHEN p_size > 25 THEN 1.05 ELSE 1.0 END, 12) AS rank_score
FROM (SELECT *, CASE WHEN lower(p_name) = '{RANK_QUERY}' THEN 1.4 WHEN share = 0 THEN 1.0 WHEN share >= 0.8 THEN 1.3 WHEN share >= 0.5 THEN 1.2 WHEN share >= 0.3 THEN 1.1 ELSE 1.05 END::DOUBLE AS name_boost, 1.0::DOUBLE + 0.05::DOUBLE * shared AS path_boost FROM s)""")
def rank_scores(spark, sf_dir):
    path = F.concat_ws("/", "p_type", "p_brand")
    asked, name = F.lit(RANK_QUERY), F.col("p_name")
    kind = F.when(F.col("p_size") % 2 == 0, "class").otherwise("function")
    docstring = F.when(F.col("p_size") > 25, "told")
    none = F.array().cast("array<string>")
    score = ranking.rank_score(asked, F.col("p_retailprice") / 1000, kind, name, path, none, docstring, F.lit(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(ranking.name_factor(asked, name), 6).alias("name_boost"),
        F.round(ranking.path_factor(asked, path), 6).alias("path_boost"),
        F.round(score, 12).alias("rank_score"),
    )


@query("""WITH p AS (SELECT doc_id, concat_ws(chr(10), 'Name: doc' || doc_id, 'Type: document', 'Context: ' || source, 'Tags: ' || concat_ws(', ', lang, 'text')) AS facts, 'text in ' || lang AS doc, coalesce(text, '') AS body FROM documents),
h AS (SELECT *, facts || chr(10) || 'Docstring: ' || doc AS header FROM p)
SELECT doc_id, md5(CASE WHEN body = '' THEN header ELSE header || chr(10) || left(body, 2047 - length(header)) END) AS text_md5, CASE WHEN body = '' THEN length(header) ELSE length(header) + 1 + least(length(body), 2047 - length(header)) END AS n_chars FROM h""")
def embedding_text(spark, sf_dir):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    made = T.embedding_text(name, F.lit("document"), F.col("source"), F.array(F.col("lang"), F.lit("text")), F.concat(F.lit("text in "), F.col("lang")), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("t"))
    return rows.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query("SELECT conv_id, turn, md5(concat_ws(':', 'conv' || conv_id, CASE WHEN role = 'user' THEN 'u' ELSE 'None' END, turn::VARCHAR, 'turn')) AS chunk_id FROM conversations")
def chunk_ids(spark, sf_dir):
    made = ids.chunk_id(F.concat(F.lit("conv"), F.col("conv_id").cast("string")), F.when(F.col("role") == "user", "u"), F.col("turn"), F.lit("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("chunk_id"))


# --- context, statistics, state ----------------------------------------------------------------


def _chunks(spark, sf_dir):
    """conversations as chunks: a conversation is a file, a turn a chunk of one line."""
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    line = F.col("turn").cast("int") + 1
    return c.select(
        ids.chunk_id(path, F.col("role"), line, F.lit("turn")).alias("chunk_id"), path.alias("relative_path"), line.alias("start_line"), line.alias("end_line"),
        F.lit("turn").alias("chunk_type"), F.col("role").alias("name"), F.lit(None).cast("string").alias("content_preview"), F.col("text").alias("content"),
        F.array("role").alias("tags"), F.array(path).alias("folder_structure"),
    )


_CHUNKS = "k AS (SELECT md5(concat_ws(':', 'conv' || conv_id, coalesce(role, 'None'), (turn + 1)::VARCHAR, 'turn')) AS chunk_id, 'conv' || conv_id AS relative_path, (turn + 1)::INT AS line, role, text FROM conversations)"


@query(f"""WITH {_CHUNKS}, w AS (SELECT chunk_id, relative_path, count(*) OVER (PARTITION BY relative_path) AS chunks_in_file,
  lag(chunk_id) OVER o AS before, lead(chunk_id) OVER o AS after, lag(text) OVER o AS tb, lead(text) OVER o AS ta FROM k WINDOW o AS (PARTITION BY relative_path ORDER BY line, chunk_id))
SELECT chunk_id, relative_path, chunks_in_file, concat_ws(',', before, after) AS neighbours,
  md5(concat_ws('|', CASE WHEN length(tb) > 200 THEN tb[:200] || '...' ELSE tb END, CASE WHEN length(ta) > 200 THEN ta[:200] || '...' ELSE ta END)) AS previews_md5 FROM w""")
def file_neighbors(spark, sf_dir):
    found = context.with_context(_chunks(spark, sf_dir))
    return found.select(
        "chunk_id", "relative_path", "chunks_in_file",
        F.array_join(F.transform("neighbours", lambda x: x["chunk_id"]), ",").alias("neighbours"),
        F.md5(F.array_join(F.transform("neighbours", lambda x: x["preview"]), "|")).alias("previews_md5"),
    )


@query("SELECT 'conv' || conv_id AS relative_path, count(*) AS n FROM conversations GROUP BY conv_id")
def chunks_in_file(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'chunk_types' AS category, 'turn' AS value, count(*) AS count FROM conversations HAVING count(*) > 0
UNION ALL SELECT 'top_tags', role, count(*) FROM conversations GROUP BY role UNION ALL SELECT 'top_folders', 'conv' || conv_id, count(*) FROM conversations GROUP BY conv_id""")
def index_stats_counts(spark, sf_dir):
    return index_stats.counts(_chunks(spark, sf_dir))


@query("""SELECT value, count, rank FROM (SELECT *, row_number() OVER (ORDER BY count DESC, value)::INT AS rank FROM (SELECT 'conv' || conv_id AS value, count(*) AS count FROM conversations GROUP BY conv_id)) WHERE rank <= 10""")
def top_folders(spark, sf_dir):
    return index_stats.top(index_stats.counts(_chunks(spark, sf_dir)), "top_folders")


@query("SELECT count(*) AS total_chunks, count(DISTINCT conv_id) AS files_indexed FROM conversations")
def index_summary(spark, sf_dir):
    return index_stats.summary(_chunks(spark, sf_dir)).select("total_chunks", "files_indexed")


def _doc_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("relative_path"), F.md5(F.coalesce("text", F.lit(""))).alias("content_md5"))


@query("""SELECT doc_id::VARCHAR AS chunk_id, source AS relative_path, CASE WHEN lang = 'fr' THEN 'new' ELSE md5(coalesce(text, '')) END AS content_md5 FROM documents""")
def upsert(spark, sf_dir):
    new = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("relative_path"), F.lit("new").alias("content_md5"))
    return mutate.upsert(_doc_index(spark, sf_dir), new)


@query("SELECT doc_id::VARCHAR AS chunk_id, source AS relative_path, md5(coalesce(text, '')) AS content_md5 FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_by_file(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").select("source").distinct().filter(F.col("source").isin("src1", "src2"))
    return mutate.delete_files(_doc_index(spark, sf_dir), gone)


@query("SELECT doc_id::VARCHAR AS chunk_id, source AS relative_path, md5(coalesce(text, '')) AS content_md5 FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return mutate.lookup(_doc_index(spark, sf_dir), "7")


_SNAPS = "s AS (SELECT user_id AS project_id, ts AS snapshot_ts, event_id AS snapshot_id, md5(props) AS root_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events)"


def _snapshots(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("snapshot_id"), F.md5("props").alias("root_hash"))


@query(f"WITH {_SNAPS} SELECT project_id, snapshot_id, rank FROM s WHERE rank <= 5")
def snapshot_retention(spark, sf_dir):
    return snapshots.newest(_snapshots(spark, sf_dir), 5).select("project_id", "snapshot_id", "rank")


@query(f"""WITH {_SNAPS}, l AS (SELECT * FROM s WHERE rank = 1), n AS (SELECT max(ts) AS now FROM events)
SELECT project_id, snapshot_id, round((epoch_us(now) - epoch_us(snapshot_ts)) / 1e6, 3) AS age_seconds, root_hash <> md5('{{"k": 1}}') OR (epoch_us(now) - epoch_us(snapshot_ts)) / 1e6 > 3600 AS needs_reindex FROM l, n""")
def needs_reindex(spark, sf_dir):
    rows = _snapshots(spark, sf_dir)
    now = F.lit(rows.agg(F.max("snapshot_ts")).first()[0])
    last = snapshots.newest(rows, 1)
    root = F.md5(F.lit('{"k": 1}'))
    return last.select(
        "project_id", "snapshot_id", F.round(snapshots.age_seconds(F.col("snapshot_ts"), now), 3).alias("age_seconds"),
        snapshots.needs_reindex(F.col("snapshot_ts"), F.col("root_hash"), root, now, 60).alias("needs_reindex"),
    )


@query("""WITH c AS (SELECT 0 AS ord, p_brand AS value, count(*) AS count, 'Find ' || p_brand || ' related code' AS suggestion FROM part GROUP BY p_brand
UNION ALL SELECT 1, lower(p_type), count(*), 'Show all ' || lower(p_type) || 's' FROM part GROUP BY 2)
SELECT ord, value, count, suggestion FROM c WHERE contains(lower(value), 'a') ORDER BY ord, count DESC, value LIMIT 5""")
def suggestions(spark, sf_dir):
    chunks = table(spark, sf_dir, "part").select(F.lower("p_type").alias("chunk_type"), F.array("p_brand").alias("tags"), F.array().cast("array<string>").alias("folder_structure"))
    return index_stats.suggestions(index_stats.counts(chunks), "a")
