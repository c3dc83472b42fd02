"""Mixing sources to target weights.

Every document gets a hash-random key, from its id and text. Within a source, documents are sorted by
that key inside key ranges; the ranges' totals give prefix sums, so the place of
a document in its source's order, measured in words, is known without gathering
a source in one task. A source whose target is ``e`` whole passes and a rest is
taken ``e`` times whole, and once more up to the document at which the rest is
reached: a document belongs to the last pass when its middle word lies within
the rest, so the taken words miss the target by half a document at most.

Targets: source ``i`` (in code-point order, null last) weighs 1, 2, 3, 1, ...;
all targets add up to all words; a target stops at ``cap`` times its source's
words and the excess goes to the others by weight until none is above. With the
sources sorted by ``cap * size / weight`` the stopped ones are a prefix, which
prefix sums over the sources' totals (one row a source) find without a loop.

Null text has size 0 and is taken 0 times a word; null sources form one source;
rows that repeat a document id are documents of their own, null ids too, and
rows that agree in id and text are alike: it makes no difference which is taken.
Texts of any length are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, words

SEED = "mix-1"
CAP = 3
WEIGHTS = (1, 2, 3)


def mix_plan(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, size, source, source_size, target, passes (how often it is taken), taken, and the columns in ``keep``."""
    size = F.size(words(F.col(text_col))).cast("long") if size is None else size
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    d = docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *keep).withColumn("range", F.substring("key", 1, 3))
    d = saved(d, "mix")
    at = F.struct("source")  # a struct is never null, so nulls join too
    totals = d.groupBy(at.alias("at"), "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"before": F.coalesce(F.sum("sum").over(before), F.lit(0)), "source_size": F.sum("sum").over(Window.partitionBy("at"))})

    # One row a source from here to ``targets``.
    s = totals.groupBy("at").agg(F.first("source_size").alias("S"))
    order = Window.orderBy(F.col("at.source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ratio = Window.orderBy((F.lit(cap) * F.col("S") / F.col("w")), F.col("at.source").asc_nulls_last())
    s = s.withColumns({"left": F.sum("S").over(Window.partitionBy()) - F.coalesce(F.sum(F.lit(cap) * F.col("S")).over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "open_here": F.sum("w").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    s = s.withColumn("full", F.lit(cap) * F.col("S") * F.col("open_here").cast("double") <= F.col("left").cast("double") * F.col("w"))
    everyone = Window.partitionBy()
    s = s.withColumns({"rest": F.sum("S").over(everyone) - F.coalesce(F.sum(F.when(F.col("full"), F.lit(cap) * F.col("S"))).over(everyone), F.lit(0)), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(everyone)})
    targets = s.select("at", F.when(F.col("full"), (F.lit(cap) * F.col("S")).cast("double")).otherwise(F.col("rest").cast("double") / F.col("open").cast("double") * F.col("w").cast("double")).alias("target"))

    offsets = totals.join(targets, "at").select("at", "range", "before", "source_size", "target")
    within = Window.partitionBy("at", "range").orderBy("key", "size", *[F.xxhash64(c) for c in keep]).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", at).withColumn("here", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["at", "range"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    d = d.withColumn("whole", whole)
    last = 2.0 * (F.col("before") + F.col("here")) + F.col("size") <= 2.0 * (F.col("target") - F.col("whole") * F.col("source_size"))
    passes = F.col("whole") + F.when(last & (F.col("whole") < cap), 1).otherwise(0)
    d = d.withColumn("passes", passes.cast("long"))
    return d.select(id_col, "size", "source", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), *keep)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
n AS (SELECT source, s, ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1 AS w FROM t),
r AS (SELECT *, (SELECT sum(s) FROM t) - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_here,
             sum(w) OVER (ORDER BY 3 * s / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_here FROM n),
f AS (SELECT *, CAST(3 * s AS DOUBLE) * CAST(open_here AS DOUBLE) <= CAST(rest_here AS DOUBLE) * w AS full_up FROM r),
g AS (SELECT source, s, CASE WHEN full_up THEN CAST(3 * s AS DOUBLE) ELSE
             CAST((SELECT sum(s) FROM t) - coalesce((SELECT sum(3 * s) FROM f WHERE full_up), 0) AS DOUBLE) / CAST((SELECT sum(w) FROM f WHERE NOT full_up) AS DOUBLE) * CAST(w AS DOUBLE) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, g.s, g.target, CASE WHEN g.s > 0 THEN CAST(floor(g.target / g.s) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * (whole + CASE WHEN whole < 3 AND 2.0 * CAST(before AS DOUBLE) + size <= 2.0 * (target - whole * s) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
