"""Query and chunk text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semindex.functions.rules import ACTION_WORDS, INTENTS

#: Letters, digits and underscore in any script: the same class in Java, RE2 and Python.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trim_query(query: Column) -> Column:
    return F.regexp_replace(query, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words; camelCase, snake_case and kebab-case fall apart."""
    apart = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(F.translate(apart, "_-", "  ")), F.lit(f"{WORD}+"), F.lit(0))


def query_tokens(query: Column) -> Column:
    """Tokens of a query, which is lower-cased first: its camelCase stays whole."""
    return tokens(F.lower(query))


def entity_like(query: Column) -> Column:
    """Does the query look like a name: few words, none of them an action?"""
    words = query_tokens(query)
    actions = F.array(*[F.lit(w) for w in ACTION_WORDS])
    camel = query.rlike("[A-Z][a-z]+[A-Z]")
    return (F.size(words) <= 3) & ~F.arrays_overlap(words, actions) & (camel | (F.size(words) <= 2))


def intent_pattern(intent: str) -> str:
    """One expression for an intent. Engines differ in what they take for a word boundary beside
    letters of other scripts, so each boundary is spelt out."""
    sides = (r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])")
    return "|".join(p.replace(r"\b", sides[0], 1).replace(r"\b", sides[1]) for p in INTENTS[intent])


def intents(query: Column) -> Column:
    """Names of all intents of a query, in the order of the table."""
    low = F.lower(query)
    # (?d): a dot stops at line feeds only
    return F.array_compact(F.array(*[F.when(low.rlike("(?d)" + intent_pattern(name)), F.lit(name)) for name in INTENTS]))


SNIPPET, SNIPPET_CUT = 160, 157


def snippet(preview: Column) -> Column:
    """First line that isn't blank, white space collapsed, shortened with an ellipsis."""
    lines = F.transform(F.split(F.coalesce(preview, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    first = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(F.length(first) > SNIPPET, F.concat(F.substring(first, 1, SNIPPET_CUT), F.lit("..."))).otherwise(first)


PREVIEW = 200


def neighbour_preview(preview: Column, content: Column) -> Column:
    """The preview, or else the start of the content."""
    text = F.coalesce(content, F.lit(""))
    short = F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(preview, F.lit("")) != "", preview).otherwise(short)


def folder_parts(relative_path: Column) -> Column:
    """Components of the path above the file."""
    parts = F.split(relative_path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


MAX_EMBEDDED = 2048


def embedding_text(name: Column, kind: Column, parent: Column, tags: Column, docstring: Column, content: Column, most: int = MAX_EMBEDDED) -> Column:
    """What is embedded of a chunk: a header of facts, then content up to ``most`` characters.

    The docstring is whole when it is shorter than half of what the facts leave, else it gets 30 %.
    """
    blank = F.lit("")
    title = F.concat(F.lit("Name: "), F.when(F.coalesce(name, blank) != "", name).otherwise("unknown"))
    facts = F.array_compact(
        F.array(
            title,
            F.concat(F.lit("Type: "), F.when(F.coalesce(kind, blank) != "", kind).otherwise("unknown")),
            F.when(F.coalesce(parent, blank) != "", F.concat(F.lit("Context: "), parent)),
            F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
        )
    )
    left = F.lit(most - 10) - F.aggregate(facts, F.lit(0), lambda s, x: s + F.length(x) + 1)
    doc, body = F.coalesce(docstring, blank), F.coalesce(content, blank)
    share = F.when(F.length(doc) < left * 0.5, F.length(doc)).otherwise(F.least(F.length(doc), F.floor(left * 0.3).cast("int")))
    told = F.when(doc != "", F.concat(F.lit("Docstring: "), F.substr(doc, F.lit(1), share)))
    header = F.array_join(F.array_compact(F.array_append(facts, told)), "\n")
    room = F.greatest(F.lit(0), F.lit(most - 1) - F.length(header))
    whole = F.when(body == "", header).otherwise(F.concat(header, F.lit("\n"), F.substr(body, F.lit(1), room)))
    return F.when(left <= 20, F.concat(title, F.lit("\n"), F.substring(body, 1, most // 2))).otherwise(whole)
