"""Extraction: metric candidates by fixed patterns, dates, IRR mentions and conventions.

pages has doc_id, doc_ord, page_num, text (and what else the caller keeps). All of it
is per page and document, in built-in expressions: no join but the grouping by document.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS
from ..functions import patterns as P
from ..functions import text as T

CONFIDENCE = 0.55
EXTRACTOR = "RegexExtractor"


def anchor(pattern: str) -> str:
    """What every match of a pattern begins with, folded; empty if it begins with no plain text."""
    plain = re.match(r"(?:[A-Za-z :-]|\\[()])*", pattern)[0]
    if re.match(r"[?*{]", pattern[len(plain) :]):  # the last character may be missing
        plain = plain[: -2 if plain.endswith(("\\(", "\\)")) else -1]
    return "" if "|" in re.sub(r"\([^()]*\)", "", pattern) else plain.replace("\\", "").lower()


def pattern_hits(pages: DataFrame, fields=P.FIELD_PATTERNS) -> DataFrame:
    """(doc_id, field, pattern_ord, page_num, raw, snippet): each pattern's first match on each page."""
    c, low = F.col("text"), F.col("_low")
    every = [(name, k, p, anchor(p)) for name, ps in fields for k, p in enumerate(ps)]
    own = pages.select("doc_id", "page_num", "text", T.folded(c).alias("_low"))
    if all(a for *_, a in every):
        some = [F.contains(low, F.lit(a)) for a in sorted({a for *_, a in every})]
        own = own.where(reduce(Column.__or__, some))
    # A pattern is tried where the text has what it begins with, and snippets are cut for matches only.
    tried = [F.struct(F.lit(n).alias("n"), (F.when(F.contains(low, F.lit(a)), T.first_group(c, p)) if a else T.first_group(c, p)).alias("raw")) for n, (_, _, p, a) in enumerate(every)]
    hits = own.select("doc_id", "page_num", "text", F.inline(F.filter(F.array(*tried), lambda x: x["raw"].isNotNull())))
    n = F.col("n")
    by = lambda value: reduce(lambda out, x: out.when(n == x[0], value(x[1])), list(enumerate(every))[1:], F.when(n == 0, value(every[0])))
    return hits.select("doc_id", "page_num", by(lambda x: F.lit(x[0])).alias("field"), by(lambda x: F.lit(x[1])).alias("pattern_ord"), "raw", by(lambda x: T.snippet(c, x[2], 50, 20)).alias("snippet"))


def first_hits(hits: DataFrame) -> DataFrame:
    """(doc_id, field, raw, page, snippet): a field's first pattern that matches on any page, then its first page."""
    best = F.min_by(F.struct("raw", F.col("page_num").alias("page"), "snippet"), F.struct("pattern_ord", "page_num")).alias("b")
    return hits.groupBy("doc_id", "field").agg(best).select("doc_id", "field", "b.*")


def all_hits(pages: DataFrame, decimal_targets: bool = False) -> DataFrame:
    """first_hits() of metrics and dates in one pass over the pages."""
    return first_hits(pattern_hits(pages, (*_fields(decimal_targets), ("doc_date", P.DATE_PATTERNS))))


def _fields(decimal_targets: bool) -> list:
    return [(f, P.TARGET_DECIMAL if decimal_targets and f == "target_irr" else p) for f, p in P.FIELD_PATTERNS]


def metric_candidates(pages: DataFrame, decimal_targets: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """A row for each document and metric: value (null if missing), hurdle (of carry), confidence, page, snippet; hits: of all_hits()."""
    fields = _fields(decimal_targets)
    found = first_hits(pattern_hits(pages, fields)) if hits is None else hits
    value = F.col("raw").try_cast("double")
    found = found.withColumn("value", F.when(F.col("field") == "aum", value * 1e9).otherwise(value))
    wide = found.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "page", "snippet"))).alias(f) for f, _ in fields])
    docs = pages.select("doc_id").distinct().join(wide, "doc_id", "left")
    none = F.lit(None)
    rows = []
    for m in METRICS:
        own, hurdle = F.col(m), F.col("hurdle") if m == "carry" else None
        rows.append(
            F.struct(
                F.lit(m).alias("field"),
                own["value"].alias("value"),
                (hurdle["value"] if hurdle is not None else none.cast("double")).alias("hurdle"),
                F.when(own["value"].isNotNull(), CONFIDENCE).otherwise(0.0).alias("confidence"),
                own["page"].alias("page"),
                F.coalesce(F.nullif(own["snippet"], F.lit("")), F.when(own.isNotNull(), hurdle["snippet"]) if hurdle is not None else F.lit(None).cast("string"), F.lit("")).alias("snippet"),
            )
        )
    return docs.select("doc_id", F.inline(F.array(*rows))).withColumn("extractor", F.lit(EXTRACTOR))


def missing_fields(metrics: DataFrame) -> DataFrame:
    """(doc_id, missing_fields) in the order of the metrics, a carry's hurdle after it."""
    names = F.array_compact(F.array(F.when(F.col("value").isNull(), F.concat("field", F.lit(".value"))), F.when((F.col("field") == "carry") & F.col("hurdle").isNull(), F.lit("carry.hurdle"))))
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("field"))
    held = F.array_sort(F.collect_list(F.struct(order.alias("o"), names.alias("n"))))
    return metrics.groupBy("doc_id").agg(F.flatten(F.transform(held, lambda x: x["n"])).alias("missing_fields"))


def doc_dates(pages: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_date): a date as it is written, null without one; hits: of all_hits()."""
    found = first_hits(pattern_hits(pages, (("doc_date", P.DATE_PATTERNS),))) if hits is None else hits.where("field = 'doc_date'")
    return pages.select("doc_id").distinct().join(found.select("doc_id", F.col("raw").alias("doc_date")), "doc_id", "left")


def _spans(pages: DataFrame, pattern: str, basis: int, value: int, order: int) -> DataFrame:
    """Every match on a page, found by marking matches and splitting at the marks, with its offset."""
    marked = F.split(F.regexp_replace(F.col("text"), f"(?iuU)({pattern})", "\u0001$1\u0002"), "[\u0001\u0002]")
    parts = pages.select("doc_id", "page_num", "text", F.posexplode(marked).alias("k", "part"))
    before = Window.partitionBy("doc_id", "page_num").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))).where("k % 2 = 1")
    group = lambda k: T.first_group(F.col("part"), pattern, k)
    low = F.greatest(F.col("start") - 30, F.lit(0))
    return parts.select(
        "doc_id", "page_num", F.lit(order).alias("pattern_ord"), "start", (F.col("start") + F.length("part")).alias("end"),
        group(value).try_cast("double").alias("value"), F.lower(group(basis)).alias("basis"),
        T.collapsed(F.substring("text", (low + 1).cast("int"), (F.col("start") + F.length("part") + 30 - low).cast("int"))).alias("snippet"),
    )


def irr_mentions(pages: DataFrame) -> DataFrame:
    """(doc_id, mention_ord, value, basis, page, snippet); a later pattern's match that overlaps an earlier one's is left out."""
    (p1, b1, v1), (p2, b2, v2) = P.MENTION_PATTERNS
    own = pages.select("doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text"))
    one, two = _spans(own, p1, b1, v1, 0), _spans(own, p2, b2, v2, 1)
    a, b = two.alias("a"), one.alias("b")
    clash = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_num") == F.col("b.page_num")) & (F.col("a.end") > F.col("b.start")) & (F.col("a.start") < F.col("b.end"))
    both = one.union(a.join(b, clash, "left_anti")).where("value is not null")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "pattern_ord", "start")) - 1
    return both.select("doc_id", order.alias("mention_ord"), "value", "basis", F.col("page_num").alias("page"), "snippet")


def irr_basis(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, basis, snippet, page, section): from the first section that states one, else from the first page."""
    rank = F.coalesce(*[F.when(F.col("canonical_type") == s, F.lit(k)) for k, s in enumerate(P.BASIS_SECTIONS)], F.lit(len(P.BASIS_SECTIONS)))
    a = sections.select("doc_id", T.basis_of(F.coalesce("text", F.lit(""))).alias("b"), F.col("page_start").alias("page"), F.col("title").alias("section"), F.lit(0).alias("tier"), rank.alias("rank"), F.col("section_ord").alias("ord"))
    b = pages.select("doc_id", T.basis_of(F.coalesce("text", F.lit(""))).alias("b"), F.col("page_num").alias("page"), F.lit(None).cast("string").alias("section"), F.lit(1).alias("tier"), F.lit(0).alias("rank"), F.lit(0).alias("ord"))
    hits = a.union(b).where("b is not null")
    best = F.min_by(F.struct("b.basis", "b.snippet", "page", "section"), F.struct("tier", "rank", "page", "ord"))
    return hits.groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.*")


def local_basis(c: Column) -> Column:
    return T.basis_of(c)["basis"]
