"""Metrics from extracted tables, and their place behind the extractors.

tables: doc_id, table_ord, table_id, page, rows ARRAY<ARRAY<STRUCT<header, value>>>, footnotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

CONFIDENCE, EXTRACTOR = 0.85, "TableParser"
TARGETS = {"aum": "aum", "irr": "net_irr", "tvpi": "tvpi"}


def all_tables(*sources: DataFrame) -> DataFrame:
    """One bag of the sources' tables in the order of the sources, nothing removed; table_ord numbers them by document."""
    out = None
    for k, df in enumerate(sources):
        df = df.withColumn("source_ord", F.lit(k))
        out = df if out is None else out.unionByName(df)
    order = Window.partitionBy("doc_id").orderBy("source_ord", "table_ord")
    return out.withColumn("table_ord", F.row_number().over(order) - 1)


def table_metrics(tables: DataFrame) -> DataFrame:
    """(doc_id, metric, value, page, table_id, snippet, footnotes): the first row that has both a metric's label and a value."""
    rows = tables.select("doc_id", "table_ord", "table_id", "page", "footnotes", F.posexplode("rows").alias("row_ord", "row"))
    cells = F.filter(F.transform("row", lambda x: x["value"]), lambda v: v.isNotNull() & (v != ""))
    rows = rows.withColumn("t", F.array_join(cells, " "))
    tried = []
    for name, label, value, factor in P.TABLE_PATTERNS:
        raw = T.first_group(F.col("t"), value)
        hit = F.col("t").rlike(f"(?iuU){label}") & raw.isNotNull()
        tried.append(F.when(hit, F.struct(F.lit(name).alias("metric"), (raw.try_cast("double") * factor).alias("value"), T.snippet(F.col("t"), value, 30).alias("snippet"))))
    hits = rows.select("doc_id", "table_ord", "row_ord", "table_id", "page", "footnotes", F.explode(F.array_compact(F.array(*tried))).alias("h"))
    best = F.min_by(F.struct("h.value", "page", "table_id", "h.snippet", "footnotes"), F.struct("table_ord", "row_ord"))
    return hits.groupBy("doc_id", "h.metric").agg(best.alias("b")).select("doc_id", "metric", "b.*")


def with_fallback(fused: DataFrame, found: DataFrame) -> DataFrame:
    """fused metrics (doc_id, field, value, confidence, page, snippet, ...) with the tables' where a value is missing."""
    to = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    t = found.select("doc_id", to[F.col("metric")].alias("field"), F.struct("value", "page", "snippet", "table_id", "footnotes").alias("t"))
    out = fused.join(t, ["doc_id", "field"], "left")
    use = F.col("value").isNull() & F.col("t").isNotNull()
    out = out.withColumn("from_table", F.coalesce(use, F.lit(False)))
    pick = lambda c, v: F.when(F.col("from_table"), v).otherwise(F.col(c))
    noted = F.col("from_table") & (F.size("t.footnotes") > 0)
    note = F.when(noted, F.concat("field", F.lit(": table "), "t.table_id", F.lit(" has footnotes: "), F.array_join("t.footnotes", "; ")))
    out = out.withColumns({"page": pick("page", F.col("t.page")), "snippet": pick("snippet", F.col("t.snippet")), "confidence": pick("confidence", F.lit(CONFIDENCE)), "value": pick("value", F.col("t.value")), "table_note": note})
    return out.drop("t")


def with_table_candidates(candidates: DataFrame, fused: DataFrame) -> DataFrame:
    """candidates plus the tables' where they filled a metric, which then are its only winner."""
    filled = fused.where("from_table").select("doc_id", "field", F.lit(EXTRACTOR).alias("extractor"), F.lit(99).alias("extractor_ord"), "value", F.lit(CONFIDENCE).alias("confidence"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("score"), "page", "snippet", F.lit(True).alias("winner"))
    rest = candidates.join(filled.select("doc_id", "field", F.lit(True).alias("lost")), ["doc_id", "field"], "left")
    rest = rest.withColumn("winner", F.col("winner") & F.col("lost").isNull()).select(*filled.columns)
    return rest.unionByName(filled)
