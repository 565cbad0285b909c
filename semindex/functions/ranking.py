"""Rank factors of search results, as columns; query columns may be literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semindex.functions import text as T
from semindex.functions.rules import TYPE_FACTORS


def _factors(kind: Column, table: dict[str, float]) -> Column:
    out = None
    for name, factor in table.items():
        out = F.when(kind == name, F.lit(factor)) if out is None else out.when(kind == name, F.lit(factor))
    return out.otherwise(F.lit(1.0))


def type_factor(query: Column, kind: Column) -> Column:
    return (
        F.when(F.contains(F.lower(query), F.lit("class")), _factors(kind, TYPE_FACTORS["class"]))
        .when(T.entity_like(query), _factors(kind, TYPE_FACTORS["entity"]))
        .otherwise(_factors(kind, TYPE_FACTORS["other"]))
    )


def name_factor(query: Column, name: Column) -> Column:
    words = F.array_distinct(T.query_tokens(query))
    shared = F.size(F.array_intersect(words, T.tokens(name)))
    share = shared / F.size(words)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit(1.0))
        .when(F.lower(query) == F.lower(name), F.lit(1.4))
        .when((F.size(words) == 0) | (shared == 0), F.lit(1.0))
        .when(share >= 0.8, F.lit(1.3))
        .when(share >= 0.5, F.lit(1.2))
        .when(share >= 0.3, F.lit(1.1))
        .otherwise(F.lit(1.05))
    )


def path_factor(query: Column, path: Column) -> Column:
    words = T.tokens(F.translate(F.lower(F.coalesce(path, F.lit(""))), "/\\", "  "))
    return F.lit(1.0) + 0.05 * F.size(F.array_intersect(T.query_tokens(query), words))


def tag_factor(query: Column, tags: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.lit(1.0) + 0.1 * F.size(F.array_intersect(T.intents(query), F.coalesce(tags, none)))


def docstring_factor(query: Column, kind: Column, docstring: Column) -> Column:
    return F.when(F.coalesce(docstring, F.lit("")) == "", F.lit(1.0)).when(T.entity_like(query) & (kind == "module"), F.lit(1.02)).otherwise(F.lit(1.05))


def length_factor(preview: Column) -> Column:
    return F.when(F.length(F.coalesce(preview, F.lit(""))) > 1000, F.lit(0.98)).otherwise(F.lit(1.0))


def rank_score(query: Column, similarity: Column, kind: Column, name: Column, path: Column, tags: Column, docstring: Column, preview: Column) -> Column:
    return (
        similarity * type_factor(query, kind) * name_factor(query, name) * path_factor(query, path)
        * tag_factor(query, tags) * docstring_factor(query, kind, docstring) * length_factor(preview)
    )
