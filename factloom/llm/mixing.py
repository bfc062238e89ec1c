"""Mixing sources to target weights by a time-varying curriculum.

1. A document's size is its number of words; sources get targets: weights shared
   out over ``share`` of all words, none above ``cap`` times its own size (what a
   source can't take is shared among the others by weight until none is above).
2. Each source has a weight schedule over training time 0..1, piecewise linear.
   Its integral, scaled to the target, is the source's cumulative token demand.
3. A source's documents stand in a fixed random order (md5 of the id); a document
   fills the demand from the words before it to its own end, and again in a next
   pass where the target is above the source's size; the one across the target's
   end is taken in part. Inverting the demand at its start gives the training
   position, and documents are range-sorted by position.

The running sums are in two levels, so no source is ever in one task: sums of hash
ranges of each source, accumulated over the ranges, then sums within a range.

Null text: no words, size 0, never taken. A null source is a source, after all
others. Rows that repeat an id are each mixed as documents. Null ids likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_arrow, keyed, mapped, texts, unkeyed, written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Weight schedules over time, dealt to the sources like the weights: knots (time, weight).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)), ((0.0, 1.0), (1.0, 1.0)))
#: Documents of one hash range; there are as many ranges as this asks for.
RANGE_DOCS = 4000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, source, size)"""
    rows = keyed(docs, id_col, text=text_col, source=source_col).withColumn("source", F.col("source").cast("string"))

    def each(batch):
        return {"_id": batch.column(0), "source": as_arrow(batch.column(2), batch.schema.field(2).type), "size": [len(t.split()) for t in texts(batch)]}

    return mapped(rows, each, "_id long, source string, size long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with turn, weight and target. One row a source, so windows over all do."""
    out = sources.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", _dealt("turn", [F.lit(float(w)) for w in weights])).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    # Sources in the order in which they reach their cap as the level rises: with all before it at their caps, the
    # level that remains for a source is right if it leaves the source itself below its cap; later ones are lower.
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", rest / free)
    out = out.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(whole))
    return out.select("source", "source_size", "turn", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _dealt(turn: str, values: list[Column]) -> Column:
    """The turn-th of the values, over and over."""
    return F.element_at(F.array(*values), (F.col(turn) % len(values) + 1).cast("int"))


def inverted(x: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the schedule's integral reaches the share x (0..1) of its whole."""
    areas = [0.0]
    for (t, v), (u, w) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (u - t) * (v + w) / 2)
    out = F.lit(knots[-1][0])
    for k in range(len(knots) - 2, -1, -1):
        (t, v), (u, w) = knots[k], knots[k + 1]
        rest = x * F.lit(areas[-1]) - F.lit(areas[k])
        root = F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * (w - v) / (u - t)) * rest, F.lit(0.0)))
        at = F.lit(t) + F.lit(2.0) * rest / F.greatest(F.lit(v) + root, F.lit(1e-300))
        out = at if k == len(knots) - 2 else F.when(x * F.lit(areas[-1]) < F.lit(areas[k + 1]), at).otherwise(out)
    return F.least(F.greatest(out, F.lit(knots[0][0])), F.lit(knots[-1][0]))


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """sizes (_id, source, size) with source_size, target, taken and passes: (pass, position, words) of each time the document is used."""
    n = sizes.count()
    ranges = 1 << max(0, (max(1, n) // RANGE_DOCS).bit_length())
    rows = sizes.withColumn("h", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("r", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(ranges), 32))
    sums = rows.groupBy("source", "r").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    known = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    sums = sums.withColumn("offset", offset).alias("a").join(known.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    sums = sums.select(F.col("a.source").alias("s_source"), F.col("r").alias("s_r"), "offset", "source_size", "turn", "target")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("r") == F.col("s_r"))).drop("s_source", "s_r")
    within = Window.partitionBy("source", "r").orderBy("h", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("offset") + F.sum("size").over(within) - F.col("size"))
    whole = F.floor(F.col("target") + 0.5)
    passes = []
    for k in range(int(-(-cap // 1))):
        start = F.col("source_size") * k + F.col("start")
        words = F.greatest(F.least(whole - start, F.col("size")), F.lit(0)).cast("long")
        x = start.cast("double") / F.greatest(whole, F.lit(1)).cast("double")
        at = F.when(words > 0, _dealt("turn", [inverted(x, s) for s in schedules]))
        passes.append(F.struct(F.lit(k).alias("pass"), at.alias("position"), words.alias("words")))
    used = F.filter(F.array(*passes), lambda p: p["words"] > 0)
    taken = sum((p["words"] for p in passes[1:]), passes[0]["words"])
    return rows.select("_id", "source", "size", "source_size", "target", taken.alias("taken"), used.alias("passes"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first use; position is null where none is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = plan(written(sized(docs), "mix-sizes"))
    out = out.select(unkeyed().alias("doc_id"), "size", "source_size", "target", "taken", F.get("passes", F.lit(0))["position"].alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _sql_inverted(x: str, knots) -> str:
    areas = [0.0]
    for (t, v), (u, w) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (u - t) * (v + w) / 2)
    cases = ""
    for k, ((t, v), (u, w)) in enumerate(zip(knots, knots[1:], strict=False)):
        rest = f"({x} * {areas[-1]!r}::double - {areas[k]!r}::double)"
        cases += f" WHEN {k == len(knots) - 2} OR {x} * {areas[-1]!r}::double < {areas[k + 1]!r}::double THEN {t!r}::double + 2 * {rest} / greatest({v!r}::double + sqrt(greatest({v * v!r}::double + {2 * (w - v) / (u - t)!r}::double * {rest}, 0)), 1e-300)"
    return f"least(greatest(CASE{cases} END, {knots[0][0]!r}::double), {knots[-1][0]!r}::double)"


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][turn % 3 + 1]::double AS weight, 2.0::double * source_size AS most FROM s),
v AS (SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, turn, least(most, coalesce(max(CASE WHEN level <= most / weight THEN level END) OVER () * weight, most)) AS target FROM v),
c AS (SELECT doc_id, size, source_size, target, turn, floor(target + 0.5)::bigint AS goal,
    (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::varchar, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::bigint AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(least(goal - start, size), 0) AS one, greatest(least(goal - source_size - start, size), 0) AS two FROM c),
x AS (SELECT *, (CASE WHEN one > 0 THEN start ELSE source_size + start END)::double / greatest(goal, 1)::double AS x FROM p)
SELECT doc_id, size, source_size, target, (one + two)::bigint AS taken, CASE WHEN one + two > 0 THEN
  CASE turn % 3 WHEN 0 THEN {_sql_inverted("x", SCHEDULES[0])} WHEN 1 THEN {_sql_inverted("x", SCHEDULES[1])} ELSE {_sql_inverted("x", SCHEDULES[2])} END END AS position
FROM x
"""
