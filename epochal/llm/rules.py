"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and
one integer whose bit ``i`` says that rule ``i`` failed. A policy is a version
name and a mask; a document passes a policy when ``fail_bits & mask = 0``, so
that a new policy or an ablation needs the ledger alone, not the texts.

The ledger is a table of its own (``stored``), so that it is computed once for
all policies and ablations.

Null text has no words; null ids are ids like others. Texts of any length are measured whole; the work is
``n log n`` in a text's words. Repeated rows are judged row by row. Column names
of the ledger that the input has too are replaced; other columns are not read.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Rule name and failure condition over the measurements, by bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
POLICIES = {"base-1": BASE, "full-1": (1 << len(RULES)) - 1}
CURRENT = "full-1"


def repeat_words(ws: Column, n: int = 5) -> Column:
    """Words covered by windows of ``n`` words that occur twice or more in the array ``ws``.

    Windows are hashes over their words' hashes. Only where a window repeats at
    all are they sorted with their places: a window repeats when a neighbour in
    that order has its hash, and the repeated places, sorted again, cover
    ``least(n, distance to the next)`` words each.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("end")), lambda a, p: F.struct((a["sum"] + p + n - F.greatest(p, a["end"])).alias("sum"), (p + n).alias("end")), lambda a: a["sum"])

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        twin = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"])))
        return covered(F.sort_array(F.transform(twin, lambda x: x["i"])))

    def counted(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, repeated))

    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))
        return let(F.transform(starts, lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])), counted)

    return let(F.transform(ws, lambda x: F.xxhash64(x)), windows)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    body = let(words(F.col(text_col)), lambda a: F.struct(F.size(a).cast("long").alias("n_words"), repeat_words(a).cast("long").alias("n_repeat_words")))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(id_col, body.alias("b"), line.alias("l"), (F.length(t) - count(BLANKS)).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"), count(UPPER).alias("n_upper")).select(id_col, "b.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "b.n_repeat_words", "l.n_lines", "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: measurements and ``fail_bits``."""
    bits = " | ".join(f"(CASE WHEN {cond} THEN {1 << i}L ELSE 0L END)" for i, (_, cond) in enumerate(RULES))
    return measure(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def stored(rows: DataFrame) -> DataFrame:
    """The ledger as a written table."""
    return saved(rows, "ledger")


def apply_policy(rows: DataFrame, version: str = CURRENT, out: str = "kept") -> DataFrame:
    return rows.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0, out: F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0})


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents fail it, fail it alone, and pass once it is left out."""
    mask, bits = POLICIES[version], F.col("fail_bits")
    aggs = []
    for i, (name, _) in enumerate(RULES):
        bit = 1 << i
        if mask & bit:
            aggs.append(F.struct(F.lit(name).alias("rule"), F.count(F.when(bits.bitwiseAND(F.lit(bit)) != 0, 1)).alias("n_failed"), F.count(F.when(bits.bitwiseAND(F.lit(mask)) == bit, 1)).alias("n_failed_alone"), F.count(F.when(bits.bitwiseAND(F.lit(mask & ~bit)) == 0, 1)).alias("n_kept_without")))
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*").withColumn("policy", F.lit(version))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', chr(10)) AS gram
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest(generate_series(0, 4)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
             + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_upper > 40 * word_chars THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, CAST(bits AS BIGINT) AS fail_bits, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept FROM b
"""

#: The ablation of the current policy, from the same ledger.
ABLATION_ORACLE = "WITH ledger AS (" + ORACLE + ") " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (fail_bits & {1 << i} <> 0) AS n_failed, count(*) FILTER (fail_bits & {POLICIES[CURRENT]} = {1 << i}) AS n_failed_alone, count(*) FILTER (fail_bits & {POLICIES[CURRENT] & ~(1 << i)} = 0) AS n_kept_without, '{CURRENT}' AS policy FROM ledger" for i, (name, _) in enumerate(RULES)
)
