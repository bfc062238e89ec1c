"""Risk, recommendation and the tables of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS
from ..functions import patterns as P
from ..functions import text as T
from .rules import unreconciled

SEVERITY_WEIGHTS = (("RED", 1.0), ("YELLOW", 0.5))
OTHER_WEIGHT, SCALE = 0.3, 2.0
RECONCILED = 1.0
REPEATED = 1 << 16


def risk_score(flags: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """(key, risk_score, red, yellow) for every row of keys, 0 without flags: 1 - exp(-sum of weights / 2)."""
    w = F.when(F.col("severity") == "RED", 1.0).when(F.col("severity") == "YELLOW", 0.5).otherwise(OTHER_WEIGHT)
    s = flags.groupBy(*key).agg(F.sum(w).alias("w"), F.count_if(F.col("severity") == "RED").alias("red"), F.count_if(F.col("severity") == "YELLOW").alias("yellow"))
    out = keys.select(*key).distinct().join(s, list(key), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*key, (1 - F.exp(-F.coalesce("w", F.lit(0.0)) / SCALE)).alias("risk_score"), zero("red"), zero("yellow"))


def recommendation(scores: DataFrame) -> DataFrame:
    """scores with decision and decision_confidence; PASS means to decline."""
    case = lambda a, b, c: F.when(F.col("red") >= 2, a).when((F.col("red") >= 1) | (F.col("yellow") >= 3), b).otherwise(c)
    return scores.withColumns({"decision": case("PASS", "INVESTIGATE", "APPROVE"), "decision_confidence": case(0.88, 0.74, 0.66)})


def severity_counts(flags: DataFrame, *key: str) -> DataFrame:
    return flags.groupBy(*key, "severity").agg(F.count("*").alias("n_flags"))


def facts_table(docs: DataFrame) -> DataFrame:
    """docs: doc_name, doc_date, the metrics as structs, missing_fields, notes (arrays)."""
    v = lambda m, f: F.col(m)[f]
    return docs.select(
        "doc_name", "doc_date", v("aum", "value").alias("aum_value_usd"), v("aum", "confidence").alias("aum_conf"), v("aum", "page").alias("aum_page"), v("aum", "snippet").alias("aum_snippet"),
        v("net_irr", "value").alias("net_irr_pct"), v("net_irr", "confidence").alias("net_irr_conf"), v("tvpi", "value").alias("tvpi"), v("target_irr", "value").alias("target_irr_pct"),
        v("mgmt_fee", "value").alias("mgmt_fee_pct"), v("mgmt_fee", "confidence").alias("mgmt_fee_conf"), v("mgmt_fee", "page").alias("mgmt_fee_page"), v("mgmt_fee", "snippet").alias("mgmt_fee_snippet"),
        v("carry", "value").alias("carry_pct"), v("carry", "hurdle").alias("carry_hurdle_pct"), v("carry", "confidence").alias("carry_conf"),
        F.array_join(F.coalesce("missing_fields", F.array()), ", ").alias("missing_fields"), F.array_join(F.coalesce("notes", F.array()), " | ").alias("notes"),
    )


def data_quality(metrics: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each document; metrics are long, docs has doc_id, doc_name, missing_fields, notes."""
    per = metrics.groupBy("doc_id").agg(F.count("value").alias("fields_found"), F.avg(F.when(F.col("value").isNotNull(), F.col("confidence"))).alias("avg_confidence"))
    having = lambda s: F.size(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n.contains(s)))
    out = docs.join(per, "doc_id", "left")
    return out.select("doc_id", "doc_name", F.coalesce("fields_found", F.lit(0)).alias("fields_found"), F.lit(len(METRICS)).alias("fields_total"), "avg_confidence", having("matched page fuzzily").alias("fuzzy_matches"), having("not found verbatim").alias("not_found"), F.size(F.coalesce("missing_fields", F.array())).alias("missing_count"))


def completeness(metrics: DataFrame) -> DataFrame:
    """One row over all documents; avg_confidence is over present fields."""
    return metrics.agg(F.count("value").alias("present"), F.count("*").alias("total"), F.avg(F.when(F.col("value").isNotNull(), F.col("confidence"))).alias("avg_confidence"))


def title_average(quality: DataFrame) -> DataFrame:
    """Mean of the documents' own averages, which is not the mean over fields."""
    return quality.agg(F.avg("avg_confidence").alias("avg_of_documents"))


def evidence_average(docs: DataFrame) -> DataFrame:
    """Mean confidence of AUM, net IRR, fee and carry of each document, a missing one counting as 0."""
    four = [F.coalesce(F.col(m)["confidence"], F.lit(0.0)) for m in ("aum", "net_irr", "mgmt_fee", "carry")]
    return docs.select("doc_id", (sum(four[1:], four[0]) / 4).alias("evidence_confidence"))


def confidence_tiers(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("field", T.tier(F.when(F.col("value").isNotNull(), F.col("confidence"))).alias("tier")).agg(F.count("*").alias("n"))


def irr_figures(docs: DataFrame, mentions: DataFrame, key: str = "fund") -> DataFrame:
    """(key, doc_name, label, value, status): extracted IRRs of every document, and mentions near no document's, once for value and basis."""
    own = docs.select(key, "doc_id", "doc_ord", "doc_name", F.inline(F.array(*[F.struct(F.lit(label).alias("label"), F.col(m)["value"].alias("value")) for label, m in (("Net IRR", "net_irr"), ("Target IRR", "target_irr"))]))).where("value is not null")
    said = mentions.join(docs.select(key, "doc_id", "doc_ord", "doc_name"), "doc_id")
    rest = unreconciled(said, own.select(key, "value"), RECONCILED, [key])
    first = Window.partitionBy(key, F.bround("value", 1), "basis").orderBy("doc_ord", "mention_ord")
    rest = rest.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    label = F.coalesce(F.concat(F.initcap("basis"), F.lit(" IRR (quoted)")), F.lit("IRR (quoted)"))
    return own.select(key, "doc_name", "label", "value", F.lit("extracted").alias("status")).union(rest.select(key, "doc_name", label, "value", F.lit("conflict")))


def candidates_view(candidates: DataFrame) -> DataFrame:
    return candidates.select("doc_id", "field", "extractor", "value", "confidence", "weight", "score", "page", "snippet", F.when(F.col("winner"), "✓").otherwise("").alias("winner"))


def flag_difference_counts(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(type, severity, missing, n): how much more often one side has a type and severity; flags, or counts of them (with n)."""
    often = lambda x: F.col("n") if "n" in x.columns else F.lit(1)
    more, less = (x.select("type", "severity", (often(x) * by).cast("long").alias("by")) for x, by in ((got, 1), (expected, -1)))
    both = more.unionByName(less).groupBy("type", "severity").agg(F.sum("by").alias("by")).where("by <> 0")
    return both.select("type", "severity", (F.col("by") < 0).alias("missing"), F.abs("by").alias("n"))


def flag_difference(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Types and severities, as often as they stand, that one side has more of: (type, severity, missing).

    Rows are made of the counts in two steps, so that no array grows with them but by its 2^16th part."""
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATED}"))).alias("block")
    out = flag_difference_counts(got, expected).select("type", "severity", "missing", "n", blocks)
    return out.select("type", "severity", "missing", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATED), F.col("n") - F.col("block") * REPEATED))).alias("_")).drop("_")


def input_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """path and sha256 of each file of a binaryFile scan."""
    return files.select("path", F.sha2(F.col(content), 256).alias("sha256"))


def memo_lines(memos: DataFrame, key: str = "doc_id", text: str = "memo") -> DataFrame:
    """(key, line_ord, kind, level, text) of every line of a memo without its outer fences: heading (level 1 to 6),
    bullet, numbered, rule, blank or body; the text is without its mark, escaped, with bold and italic as tags."""
    lines = memos.select(key, F.posexplode(F.split(T.unfenced(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("line_ord", "line")).withColumn("line", T.stripped(F.col("line")))
    kind, said = F.lit(None).cast("string"), F.col("line")
    for name, p in reversed(P.MEMO_LINES):
        hit = F.col("line").rlike(f"(?dU){p}")
        kind, said = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract("line", f"(?dU){p}", 1)).otherwise(said)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^#+", 0)))
    out = lines.withColumns({"kind": F.coalesce(kind, F.lit("body")), "said": T.stripped(said)})
    return out.select(key, "line_ord", "kind", level.alias("level"), T.inline_markup(F.col("said")).alias("text"))
