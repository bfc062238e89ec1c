"""Reconciling extractors, verifying evidence, and scoring confidence.

candidates: doc_id, field, extractor, extractor_ord, value, hurdle, confidence, page, snippet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import METRICS, Trust
from ..functions import text as T
from ..functions.matching import matching_size

DISAGREEMENT, TOLERANCE = 0.85, 0.05
FUZZY, FUZZY_FACTOR, MISSING_FACTOR, NO_SNIPPET_FACTOR = 0.80, 0.75, 0.40, 0.50
NO_DATE_RECENCY = 0.50
# What notes say of evidence.
NO_SNIPPET = ": missing evidence snippet"
FUZZY_MATCH = (": evidence snippet matched page fuzzily (", "% — likely OCR/rendering noise, not verbatim)")
NOT_FOUND = ": evidence snippet not found verbatim on cited page"


def _chain(pairs, test, default: float) -> Column:
    out = None
    for key, weight in pairs:
        out = F.when(test(key), weight) if out is None else out.when(test(key), weight)
    return (F.lit(default) if out is None else out.otherwise(default)).cast("double")


def trust_weight(extractor: Column, trust: Trust = Trust()) -> Column:
    return _chain(trust.extractor_weights, lambda k: extractor == k, trust.extractor_default_weight)


def authority_weight(name: Column, trust: Trust = Trust()) -> Column:
    """The first key, in their order, that the lower-cased name contains."""
    low = F.lower(name)
    return _chain(trust.authority_weights, lambda k: low.contains(k), trust.authority_default_weight)


def agreement_of(count: Column, high: Column, low: Column, tolerance: float = TOLERANCE) -> Column:
    middle = (F.abs(high) + F.abs(low)) / 2
    spread = F.try_divide(F.abs(high - low), middle)
    return F.when((count < 2) | (middle == 0) | (spread <= tolerance), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - spread))


def agreements(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, agreement, distinct_values)"""
    out = candidates.groupBy("doc_id", "field").agg(F.count("value").alias("c"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count_distinct("value").alias("distinct_values"))
    return out.select("doc_id", "field", agreement_of(F.col("c"), F.col("hi"), F.col("lo")).alias("agreement"), "distinct_values")


def scored_candidates(candidates: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """candidates with weight, score and winner: the best score, the earliest extractor on ties; null values compete."""
    out = candidates.withColumn("weight", trust_weight(F.col("extractor"), trust)).withColumn("score", F.col("confidence") * F.col("weight"))
    best = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), "extractor_ord")
    return out.withColumn("winner", F.row_number().over(best) == 1)


def fused(candidates: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """The winners, with the agreement of all candidates."""
    best = scored_candidates(candidates, trust).where("winner").drop("winner")
    return best.join(agreements(candidates).select("doc_id", "field", "agreement"), ["doc_id", "field"])


def disagreements(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, agreement, by_extractor) where several values agree too little."""
    held = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("extractor_ord", "extractor", "value"))))
    out = candidates.groupBy("doc_id", "field").agg(F.transform(held, lambda x: F.struct(x["extractor"].alias("extractor"), x["value"].alias("value"))).alias("by_extractor"))
    bad = agreements(candidates).where((F.col("distinct_values") > 1) & (F.col("agreement") < DISAGREEMENT))
    return bad.join(out, ["doc_id", "field"]).select("doc_id", "field", "agreement", "by_extractor")


def first_details(details: DataFrame) -> DataFrame:
    """(doc_id, extractor_ord, doc_date, notes, missing_fields) of each document's first extractor.

    details: a row a document and extractor; metrics come from the best one, all else from the first, whether or not it found it."""
    of = F.min_by(F.struct("extractor_ord", "doc_date", "notes", "missing_fields"), "extractor_ord").alias("d")
    return details.groupBy("doc_id").agg(of).select("doc_id", "d.*")


def recency(date: Column) -> Column:
    """A date without a time zone has no age here, so its weight is that of a missing one."""
    zoned = F.when(date.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & date.rlike("T"), date.try_cast("timestamp"))
    days = F.datediff(F.current_timestamp(), zoned)
    return F.when(zoned.isNull(), NO_DATE_RECENCY).otherwise(F.greatest(F.lit(0.30), F.least(F.lit(1.0), 1.0 - days / 3650)))


def confidence(extraction: Column, authority: Column, agreement: Column, recent: Column) -> Column:
    return 0.35 * extraction + 0.25 * authority + 0.20 * agreement + 0.20 * recent


@F.pandas_udf(DoubleType())
def _blocks_ratio(snippet: pd.Series, page: pd.Series) -> pd.Series:
    """Share of a snippet in matching blocks with a page, as difflib finds them."""
    return pd.Series([matching_size(p, s) / len(s) for s, p in zip(snippet, page, strict=True)], dtype=float)


def match_ratios(metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """metrics with match_ratio: 1 for a verbatim snippet, the share in matching blocks else; null without value or snippet.

    Only what is left after the built-in test reaches Python, by a split of the rows: conditions don't guard a UDF."""
    said = pages.select("doc_id", F.col("page_num").alias("page"), F.coalesce("text", F.lit("")).alias("page_text"))
    rows = metrics.join(said, ["doc_id", "page"], "left")
    rows = rows.withColumns({"_s": T.normalised(F.col("snippet")), "_p": T.normalised(F.col("page_text"))}).drop("page_text")
    skip = F.col("value").isNull() | (F.col("_s") == "")
    exact = F.contains("_p", "_s")
    known = rows.where(skip | exact).withColumn("match_ratio", F.when(~skip, 1.0))
    rest = rows.where(~skip & ~exact).withColumn("match_ratio", _blocks_ratio("_s", "_p"))
    return known.unionByName(rest).drop("_s", "_p")


def verified(metrics: DataFrame, pages: DataFrame, docs: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """metrics (with agreement) with final confidence and a note; docs has doc_id, doc_name, doc_date; pages are unique."""
    return weighed(match_ratios(metrics, pages), docs, trust)


def weighed(ratios: DataFrame, docs: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """As verified(), of match_ratios()."""
    rows = ratios.join(docs.select("doc_id", authority_weight(F.col("doc_name"), trust).alias("_a"), recency(F.col("doc_date")).alias("_r")), "doc_id")
    ratio = F.col("match_ratio")
    factor = F.when(ratio.isNull(), NO_SNIPPET_FACTOR).when(ratio >= 1, 1.0).when(ratio >= FUZZY, FUZZY_FACTOR).otherwise(MISSING_FACTOR)
    note = (
        F.when(F.col("value").isNull() | (ratio >= 1), None)
        .when(ratio.isNull(), F.concat("field", F.lit(NO_SNIPPET)))
        .when(ratio >= FUZZY, F.concat("field", F.lit(FUZZY_MATCH[0]), F.format_string("%.0f", F.bround(ratio * 100)), F.lit(FUZZY_MATCH[1])))
        .otherwise(F.concat("field", F.lit(NOT_FOUND)))
    )
    final = confidence(F.col("confidence"), F.col("_a"), F.coalesce("agreement", F.lit(1.0)), F.col("_r")) * factor
    return rows.withColumn("note", note).withColumn("confidence", F.when(F.col("value").isNull(), 0.0).otherwise(final)).drop("_a", "_r")


def wide(metrics: DataFrame) -> DataFrame:
    """A row for each document: struct(value, hurdle, confidence, page, snippet) for each metric."""
    cols = [F.max(F.when(F.col("field") == m, F.struct("value", "hurdle", "confidence", "page", "snippet"))).alias(m) for m in METRICS]
    return metrics.groupBy("doc_id").agg(*cols)
