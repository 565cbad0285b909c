"""Personal data detection (operator 2), DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs,
value ranges for addresses, digit counts for phones) and context words near a span adjust its
score. The patterns never look at what surrounds a match, except that a match can't begin inside
a run whose first character already failed; so a text splits into the pieces between matches, and
the lengths of pieces and matches give exact offsets (code points, end exclusive).

Null texts count as empty and have no spans. Ids may repeat or be null: each input row gives one
output row. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import table, text_or_empty

# Each pattern equals the plain one in the comment; quantifiers are possessive where the next
# token can't match inside the run, and \G or a look-behind skips starts that must fail, so that
# long runs cost linear time.
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x2D]))[A-Za-z0-9._%+\x2D]++@[A-Za-z0-9\x2D]++(?:\.[A-Za-z0-9\x2D]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
# [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20\x2D]?+[0-9])++"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9\x2D]+[0-9]"
# Added by this method: an IBAN in its written forms, confirmed by mod 97.
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"

#: Words that make a span likelier when they stand in the CONTEXT characters before it.
CONTEXT_WORDS = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)[^a-z]ip[^a-z]|address|server|host|adresse",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|contact|anruf",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
#: Score without context by kind, and what a context word adds.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
BONUS, CONTEXT = 0.1, 48
KINDS = ("email", "ip", "card", "phone", "iban")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for a non-empty string of digits whose Luhn sum ends in 0."""

    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * 2
        return total + F.when(pair["odd"] == 0, pair["d"]).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    numbered = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")),
    )
    return (F.length(digits) > 0) & (F.aggregate(numbered, F.lit(0), add) % 10 == 0)


def mod97(iban: Column) -> Column:
    """True for an IBAN (letters and digits only) whose ISO 7064 remainder is 1."""
    moved = F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))

    def safe(rest: Column, c: Column) -> Column:
        return F.when(
            (F.ascii(c) >= 48) & (F.ascii(c) <= 57), (rest * 10 + F.ascii(c) - 48) % 97
        ).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), safe) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (
            F.lpad(F.ltrim(part, F.lit("0")), 3, "0") <= "255"
        )
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        n = F.length(_digits(match))
        return n.between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    packed = F.regexp_replace(match, "\x20", "")
    return F.length(packed).between(15, 34) & mod97(packed)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m,before>> of all matches: offsets, the match and the piece before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    paired = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string,before:string>>))")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(
            end.alias("at"),
            F.concat(
                state["out"],
                F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(CONTEXT)).alias("before"))),
            ).alias("out"),
        )

    return F.aggregate(paired, empty, step, lambda state: state["out"])


#: A text without this can't hold a match of the kind: the costly expressions don't run on it.
MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20\x2D]?){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, text, and an array column for each kind with confirmed
    spans struct<s,e,m,score>."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    text = F.col("_text")
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,before:string>>)")
    raw = base.select(
        "doc_id",
        "_text",
        *[
            F.when(
                F.contains(text, F.lit("@")) if kind == "email" else text.rlike(MAYBE[kind]),
                _spans(text, globals()[kind.upper()]),
            ).otherwise(none).alias(f"_{kind}")
            for kind in KINDS
        ],
    )

    def scored(kind: str) -> Column:
        ok = F.filter(F.col(f"_{kind}"), lambda x: _valid(kind, x["m"]))
        return F.transform(
            ok,
            lambda x: F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                x["m"].alias("m"),
                (F.lit(BASE_SCORE[kind]) + F.when(x["before"].rlike(CONTEXT_WORDS[kind]), F.lit(BONUS)).otherwise(F.lit(0.0))).alias("score"),
            ),
        )

    return raw.select("doc_id", F.col("_text").alias("text"), *[scored(kind).alias(kind) for kind in KINDS])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text with every confirmed span replaced by [KIND]. Overlapping spans go together."""
    found = find_pii(docs, id_col, text_col)

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind.upper()).alias("k")))

    every = F.array_sort(F.concat(*[named(k) for k in KINDS]))

    def step(state: Column, x: Column) -> Column:
        return F.when(
            x["s"] >= state["at"],
            F.struct(x["e"].alias("at"), F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1, x["s"] - state["at"]), F.lit("["), x["k"], F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(state["at"], x["e"]).alias("at"), state["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return found.select(
        "doc_id",
        F.aggregate(every, start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1, F.length("text")))).alias("text"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_pii()."""
    listed = lambda kind: F.transform(F.col(kind), lambda x: F.concat(F.lit(f"{kind}:"), x["s"], F.lit(":"), x["e"]))
    base, extra = KINDS[:4], KINDS[4:]
    joined = found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_join(F.concat(*[listed(k) for k in base]), ",").alias("_base"),
        F.array_join(F.concat(*[listed(k) for k in (*base, *extra)]), ",").alias("spans"),
        F.coalesce(F.array_max(F.concat(*[F.transform(F.col(k), lambda x: x["score"]) for k in KINDS])), F.lit(0.0)).alias("max_score"),
    )
    return joined.select(
        "doc_id", *[f"n_{k}" for k in base], F.sha2("_base", 256).alias("base_sha256"), "spans", *[f"n_{k}" for k in extra], "max_score"
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))


# --- the same in SQL ---------------------------------------------------------------------------

#: The plain patterns, without what only saves time.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
}
_DIGITS = "regexp_replace(m[i], '[^0-9]', '', 'g')"
_CHECKS = {
    "email": "true",
    "ip": "len([1 FOR x IN string_split(m[i], '.') IF length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255']) = 0",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN j % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END FOR c, j IN string_split(reverse({_DIGITS}), '')]) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "length(replace(m[i], ' ', '')) BETWEEN 15 AND 34 AND list_reduce(string_split(array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END"
    " FOR c IN string_split(replace(m[i], ' ', '')[5:] || replace(m[i], ' ', '')[:4], '')], ''), '')::INT[], lambda a, b: (a * 10 + b) % 97) = 1",
}


def _sql() -> str:
    parts = []
    for kind in KINDS:
        pattern = _PLAIN[kind].replace("'", "''")
        start = "coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0)"
        score = f"{BASE_SCORE[kind]} + CASE WHEN regexp_matches(right(p[i], {CONTEXT}), '{CONTEXT_WORDS[kind]}') THEN {BONUS} ELSE 0.0 END"
        rows = f"[{{'s': {start}, 'm': m[i], 'score': ({score})::DOUBLE}} FOR i IN range(1, len(m) + 1) IF {_CHECKS[kind]}]"
        parts.append(f"{kind} AS (SELECT n, {rows} AS {kind} FROM (SELECT n, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d))")
    told = {k: f"[concat('{k}:', x.s, ':', x.s + length(x.m)) FOR x IN {k}]" for k in KINDS}
    base = " || ".join(told[k] for k in KINDS[:4])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents), {", ".join(parts)}
SELECT doc_id, {", ".join(f"len({k}) AS n_{k}" for k in KINDS)}, sha256(array_to_string({base}, ',')) AS base_sha256,
  array_to_string({base} || {told["iban"]}, ',') AS spans,
  coalesce(list_max({" || ".join(f"[x.score FOR x IN {k}]" for k in KINDS)}), 0.0)::DOUBLE AS max_score
FROM d {" ".join(f"JOIN {k} USING (n)" for k in KINDS)}
"""


SQL = _sql()
