"""Contradiction rules. Each gives flags: fund, rule_ord, flag_ord, severity, type, docs, detail, evidence,
why_it_matters, question_to_ask, the numbers a and b that it compared, and the documents that it is of (doc_a, doc_b: twice the same one in rules on one document).

docs: doc_id, fund, doc_ord, doc_name, the six metrics as structs (fusion.wide), basis struct. Where docs have a boolean column fresh,
only flags of fresh documents are given: fresh ones by themselves, and pairs with at least one of them.
Rules on pairs find the distinct values of a fund that are at odds by value ranges (bands.py;
all three rules on figures in one go), and join documents only to such pairs of values: no join is by fund alone, and
documents meet no others than those that they are flagged with. flag_ord orders a fund's flags of a rule;
it is made of the documents' order, so flags are never numbered in one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS, Rules
from ..functions import text as T
from . import bands
from .extract import local_basis

FLAG = ("fund", "rule_ord", "flag_ord", "severity", "type", "docs", "detail", "evidence", "why_it_matters", "question_to_ask", "a", "b", "doc_a", "doc_b")

# What the flags say.
WHY = {
    "AUM_MISMATCH": ("AUM impacts scale, fees, and benchmarking; mismatches require reconciliation.", "Which document is authoritative for AUM as-of date? Provide supporting statement/capital account details."),
    "MGMT_FEE_MISMATCH": ("Fee terms directly affect net returns and legal obligations; LPA typically governs.", "Confirm the controlling fee schedule and whether any side-letter modifies the base fee."),
    "TARGET_IRR_DRIFT": ("Different stated targets can reflect marketing vs underwriting assumptions.", "Is one target marketing and the other underwriting base-case? Which governs IC decision-making?"),
    "IRR_DEFINITION_DRIFT": ("Definition drift can mislead IC comparisons and skew underwriting decisions.", "Confirm whether IRR reported is net or gross and reconcile to a consistent definition."),
    "IRR_DEFINITION_DRIFT_INTERNAL": ("Inconsistent gross/net language within a single document is a red flag for underwriting rigor and can misstate performance.", "Confirm which convention actually governs the reported Net IRR figure."),
    "UNDER_TARGET_PERFORMANCE": ("Fund may be underperforming stated underwriting targets.", "What is driving the performance shortfall?"),
    "EXTRACTOR_DISAGREEMENT": ("Regex and LLM extraction produced materially different values for the same field within one document; fusion selected a single winner by confidence weighting, but the discarded value may have been correct.", "Manually confirm the correct {field} value from the source document {doc}."),
    "IRR_MENTION_CONFLICT": ("A document citing multiple, differently labeled IRR figures for what reads as the same underlying claim is a red flag for underwriting consistency and may indicate marketing language diverging from the governing performance figures.", "Confirm which IRR figure actually governs ({claim} vs. the extracted figures) and reconcile the discrepancy."),
}
# The details of flags and what they cite. Figures are formatted before they are put in.
DETAIL = {
    "AUM_MISMATCH": "AUM differs by {pct}%",
    "MGMT_FEE_MISMATCH": "Management fee differs: {a}% vs {b}%",
    "TARGET_IRR_DRIFT": "Target IRR differs: {a}% vs {b}%",
    "IRR_DEFINITION_DRIFT": 'Documents state different IRR return conventions: "{a}" vs "{b}".',
    "IRR_DEFINITION_DRIFT_INTERNAL": 'The reported IRR figure reads as "{local}" but this document defines its convention as "{basis}" elsewhere.',
    "UNDER_TARGET_PERFORMANCE": "Net IRR below target IRR",
    "EXTRACTOR_DISAGREEMENT": "Extractors disagree on {field}: {values} (agreement={agreement})",
    "IRR_MENTION_CONFLICT": "Document also states a {claim} elsewhere, which does not match the extracted Target IRR ({target}%) or Net IRR ({net}%).",
}
CITED = "{doc} (p.{page}): {snippet}"
CONVENTION = ' (p.{page}, {section}): "{snippet}"'
FIGURE = 'Figure (p.{page}): "{near}" | Convention'
TARGET = "Net IRR={net}% | Target IRR={target}%"
MENTION = 'p.{page}: "{snippet}"'


def _shown(c: str) -> Column:
    """A page or figure as text, None where there is none."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _number(form: str, c: Column) -> Column:
    return F.format_string(form, c)


def _flags(df: DataFrame, rule: int, severity: str, kind: str, docs: Column, detail: Column, evidence: Column, a: Column, b: Column, order: list, ask: Column | None = None) -> DataFrame:
    why, question = WHY[kind]
    of = [F.col(c) for c in ("doc_id_a", "doc_id_b")] if "doc_id_a" in df.columns else [F.col("doc_id")] * 2
    second = F.col(order[1]) if len(order) > 1 else F.lit(0)
    number = F.shiftleft(F.col(order[0]).cast("long"), 32) + second.cast("long")
    return df.select(
        "fund", F.lit(rule).alias("rule_ord"), number.alias("flag_ord"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), docs.alias("docs"), detail.alias("detail"),
        evidence.alias("evidence"), F.lit(why).alias("why_it_matters"), (ask if ask is not None else F.lit(question)).alias("question_to_ask"), a.alias("a"), b.alias("b"), of[0].alias("doc_a"), of[1].alias("doc_b"),
    )


def pct_delta(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a - b), (F.abs(a) + F.abs(b)) / 2), F.lit(0.0))


def figures_at_odds(docs: DataFrame, rules: Rules = Rules(), metrics: tuple[str, ...] = ("aum", "mgmt_fee", "target_irr")) -> DataFrame:
    """(fund, metric, v_lo, v_hi) of the figures of a fund that are too far apart; all metrics share one search."""
    v, m = F.col("v"), F.col("metric")
    most = {"mgmt_fee": rules.mgmt_fee_abs_pct, "target_irr": rules.target_irr_abs_pct}
    fresh = [c for c in docs.columns if c == "fresh"]
    values = docs.select("fund", *fresh, F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x)["value"].alias("v")) for x in metrics])).alias("m")).select("fund", *fresh, "m.*")
    limit, test = bands.beyond_share(v, rules.aum_tolerance_pct), lambda a, b: pct_delta(a, b) > rules.aum_tolerance_pct
    for name, by in most.items():
        limit = F.when(m == name, bands.beyond_difference(v, by)).otherwise(limit)
        test = (lambda a, b, by=by, name=name, rest=test: F.when(m == name, F.abs(a - b) > by).otherwise(rest(a, b)))
    return bands.apart(values, ["fund", "metric"], limit, test, *fresh)


def _own(docs: DataFrame) -> list[str]:
    return ["doc_id", "doc_ord", "doc_name", *[c for c in docs.columns if c == "fresh"]]


def _fresh(docs: DataFrame) -> DataFrame:
    return docs.where("fresh").drop("fresh") if "fresh" in docs.columns else docs


def _paired(one: DataFrame, odd: DataFrame) -> DataFrame:
    """Pairs of documents with values v_lo and v_hi, as columns *_a and *_b in the documents' order."""
    more = [c for c in one.columns if c not in ("fund", "fresh")]
    # Plain columns, not structs: what a reader of the flags leaves out is not carried through the joins either.
    low, high = (one.select("fund", F.col("v").alias(f"v_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in more], *[F.col(c) for c in one.columns if c == "fresh"]) for s in ("lo", "hi"))
    if "fresh" in one.columns:
        new, old = (x.where(c).drop("fresh") for x, c in ((low, "fresh"), (low, "not fresh")))
        first = odd.join(new, ["fund", "v_lo"]).join(high.drop("fresh"), ["fund", "v_hi"])
        both = first.unionByName(odd.join(high.where("fresh").drop("fresh"), ["fund", "v_hi"]).join(old, ["fund", "v_lo"]).select(*first.columns))
    else:
        both = odd.join(low, ["fund", "v_lo"]).join(high, ["fund", "v_hi"])
    both = both.where("lo_doc_ord <> hi_doc_ord")
    first = F.col("lo_doc_ord") < F.col("hi_doc_ord")
    return both.select("fund", *[F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{c}_{s}") for s, x, y in (("a", "lo", "hi"), ("b", "hi", "lo")) for c in more])


def _pair_count(one: DataFrame, odd: DataFrame) -> DataFrame:
    """(fund, n): how many rows _paired() has, by how many documents have a value, without making them."""
    of = one.select("fund", "v", "doc_ord")
    low, high = (of.groupBy("fund", F.col("v").alias(f"v_{s}")).agg(F.count("*").alias(f"n_{s}")) for s in ("lo", "hi"))
    met = odd.join(low, ["fund", "v_lo"]).join(high, ["fund", "v_hi"]).select("fund", (F.col("n_lo") * F.col("n_hi")).alias("n"))
    # Documents of one place in the order are no pair.
    place, value = ["fund", "doc_ord"], F.col("v_lo") < F.col("v_hi")
    same = of.withColumnRenamed("v", "v_lo").join(of.withColumnRenamed("v", "v_hi"), place).where(value).join(odd, ["fund", "v_lo", "v_hi"])
    both = met.unionByName(same.select("fund", F.lit(-1).cast("long").alias("n")))
    return both.groupBy("fund").agg(F.sum("n").alias("n")).where("n > 0")


def _versus() -> Column:
    return F.concat("doc_name_a", F.lit(" vs "), "doc_name_b")


def _cited(doc: str, page: str, snippet: str) -> Column:
    return T.filled(CITED, doc=F.col(doc), page=_shown(page), snippet=F.coalesce(F.col(snippet), F.lit("")))


def _figures(docs: DataFrame, metric: str, rules: Rules, odd: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Documents with their value of a metric, and the values of it that are at odds."""
    odd = figures_at_odds(docs, rules, (metric,)) if odd is None else odd
    one = docs.select("fund", *_own(docs), F.col(metric)["value"].alias("v"), F.col(metric)["page"].alias("page"), F.col(metric)["snippet"].alias("snippet")).where("v is not null")
    return one, odd.where(F.col("metric") == metric).drop("metric")


def _mismatch(docs: DataFrame, rule: int, severity: str, kind: str, metric: str, detail, rules: Rules, odd: DataFrame | None) -> DataFrame:
    p = _paired(*_figures(docs, metric, rules, odd))
    said = F.concat(_cited("doc_name_a", "page_a", "snippet_a"), F.lit(" | "), _cited("doc_name_b", "page_b", "snippet_b"))
    return _flags(p, rule, severity, kind, _versus(), detail(DETAIL[kind], F.col("v_a"), F.col("v_b")), said, F.col("v_a"), F.col("v_b"), ["doc_ord_a", "doc_ord_b"])


def aum_mismatch(docs: DataFrame, rules: Rules = Rules(), odd: DataFrame | None = None) -> DataFrame:
    return _mismatch(docs, 0, "RED", "AUM_MISMATCH", "aum", lambda said, a, b: T.filled(said, pct=_number("%.1f", pct_delta(a, b) * 100)), rules, odd)


def fee_mismatch(docs: DataFrame, rules: Rules = Rules(), odd: DataFrame | None = None) -> DataFrame:
    return _mismatch(docs, 1, "RED", "MGMT_FEE_MISMATCH", "mgmt_fee", lambda said, a, b: T.filled(said, a=_number("%.2f", a), b=_number("%.2f", b)), rules, odd)


def target_irr_drift(docs: DataFrame, rules: Rules = Rules(), odd: DataFrame | None = None) -> DataFrame:
    return _mismatch(docs, 2, "YELLOW", "TARGET_IRR_DRIFT", "target_irr", lambda said, a, b: T.filled(said, a=_number("%.1f", a), b=_number("%.1f", b)), rules, odd)


def _convention(s: str = "") -> Column:
    return T.filled(CONVENTION, page=_shown(f"page{s}"), section=F.coalesce(F.col(f"section{s}"), F.lit("n/a")), snippet=F.col(f"snippet{s}"))


def _conventions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their convention, and the pairs of conventions of a fund."""
    one = docs.select("fund", *_own(docs), F.col("basis")["basis"].alias("v"), F.col("basis")["page"].alias("page"), F.col("basis")["section"].alias("section"), F.col("basis")["snippet"].alias("snippet")).where("v is not null")
    # A fund has few conventions, so their pairs come of one row a fund.
    held = one.groupBy("fund").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    odd = held.select("fund", F.explode("vs").alias("v_lo"), "vs").select("fund", "v_lo", F.explode("vs").alias("v_hi")).where("v_lo < v_hi")
    return one, odd


def definition_drift(docs: DataFrame) -> DataFrame:
    p = _paired(*_conventions(docs))
    detail = T.filled(DETAIL["IRR_DEFINITION_DRIFT"], a=F.col("v_a"), b=F.col("v_b"))
    said = F.concat(F.col("doc_name_a"), _convention("_a"), F.lit(" | "), F.col("doc_name_b"), _convention("_b"))
    none = F.lit(None).cast("double")
    return _flags(p, 3, "YELLOW", "IRR_DEFINITION_DRIFT", _versus(), detail, said, none, none, ["doc_ord_a", "doc_ord_b"])


def definition_drift_internal(docs: DataFrame) -> DataFrame:
    d = _fresh(docs).select("fund", "doc_id", "doc_ord", "doc_name", F.col("net_irr")["page"].alias("at"), F.coalesce(F.col("net_irr")["snippet"], F.lit("")).alias("near"), "basis.*")
    d = d.withColumn("local", local_basis(F.col("near"))).where("local <> basis")
    detail = T.filled(DETAIL["IRR_DEFINITION_DRIFT_INTERNAL"], local=F.col("local"), basis=F.col("basis"))
    said = F.concat(T.filled(FIGURE, page=_shown("at"), near=F.col("near")), _convention())
    none = F.lit(None).cast("double")
    return _flags(d, 4, "YELLOW", "IRR_DEFINITION_DRIFT_INTERNAL", F.col("doc_name"), detail, said, none, none, ["doc_ord"])


def under_target(docs: DataFrame) -> DataFrame:
    net, target = F.col("net_irr")["value"], F.col("target_irr")["value"]
    said = T.filled(TARGET, net=net, target=target)
    return _flags(_fresh(docs).where(net < target), 5, "YELLOW", "UNDER_TARGET_PERFORMANCE", F.col("doc_name"), F.lit(DETAIL["UNDER_TARGET_PERFORMANCE"]), said, net, target, ["doc_ord"])


def extractor_disagreement(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found: fusion.disagreements()"""
    d = _fresh(docs).select("doc_id", "fund", "doc_ord", "doc_name").join(found, "doc_id")
    d = d.withColumn("_field", F.array_position(F.array(*[F.lit(m) for m in sorted(METRICS)]), F.col("field")))
    values = F.array_join(F.transform("by_extractor", lambda x: F.concat(x["extractor"], F.lit("="), x["value"].cast("string"))), ", ")
    detail = T.filled(DETAIL["EXTRACTOR_DISAGREEMENT"], field=F.col("field"), values=values, agreement=_number("%.2f", F.col("agreement")))
    ask = F.replace(F.replace(F.lit(WHY["EXTRACTOR_DISAGREEMENT"][1]), F.lit("{field}"), F.col("field")), F.lit("{doc}"), F.col("doc_name"))
    return _flags(d, 6, "YELLOW", "EXTRACTOR_DISAGREEMENT", F.col("doc_name"), detail, values, F.col("agreement"), F.lit(None).cast("double"), ["doc_ord", "_field"], ask)


def unreconciled(mentions: DataFrame, known: DataFrame, tolerance: float, key: list[str]) -> DataFrame:
    """Mentions within ``tolerance`` of no known value of their key; all of them where there is none.

    Values meet in bands of twice the tolerance, a known one in its own band and those beside it."""
    band = lambda v: F.floor(v / F.lit(2 * tolerance if tolerance > 0 else 1.0))
    k = known.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("value").alias("_known")).distinct()
    k = k.withColumn("_band", F.explode(F.sequence(band(F.col("_known")) - 1, band(F.col("_known")) + 1)))
    near = (band(F.col("value")) == F.col("_band")) & (F.abs(F.col("value") - F.col("_known")) <= tolerance)
    for c in key:
        near = (F.col(c) == F.col(f"_{c}")) & near
    return mentions.join(k, near, "left_anti")


def irr_mention_conflict(docs: DataFrame, mentions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    docs = _fresh(docs)
    known = docs.select("doc_id", F.explode(F.array_compact(F.array(F.col("target_irr")["value"], F.col("net_irr")["value"]))).alias("value"))
    rest = unreconciled(mentions, known, rules.internal_irr_mention_tolerance_pct, ["doc_id"])
    first = Window.partitionBy("doc_id", F.bround("value", 1), "basis").orderBy("mention_ord")
    rest = rest.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    d = docs.select("doc_id", "fund", "doc_ord", "doc_name", F.col("target_irr")["value"].alias("t"), F.col("net_irr")["value"].alias("n")).join(rest, "doc_id")
    claim = F.concat(F.coalesce(F.concat("basis", F.lit(" ")), F.lit("")), F.lit("IRR of "), F.col("value").cast("string"), F.lit("%"))
    detail = T.filled(DETAIL["IRR_MENTION_CONFLICT"], claim=claim, target=_shown("t"), net=_shown("n"))
    ask = F.replace(F.lit(WHY["IRR_MENTION_CONFLICT"][1]), F.lit("{claim}"), F.concat(F.coalesce(F.concat("basis", F.lit(" ")), F.lit("")), F.col("value").cast("string"), F.lit("%")))
    said = T.filled(MENTION, page=_shown("page"), snippet=F.col("snippet"))
    return _flags(d, 7, "YELLOW", "IRR_MENTION_CONFLICT", F.col("doc_name"), detail, said, F.col("value"), F.lit(None).cast("double"), ["doc_ord", "mention_ord"], ask)


@dataclass
class Case:
    """What rules read."""

    docs: DataFrame
    mentions: DataFrame
    found: DataFrame
    rules: Rules = Rules()
    known: DataFrame | None = None

    @cached_property
    def odd(self) -> DataFrame:
        """Figures at odds of all three rules on figures, in ranges that are written once; those that are known, if given."""
        return figures_at_odds(self.docs, self.rules) if self.known is None else self.known


#: name -> function of a Case that gives flags; add to it to extend what run_rules() does.
REGISTRY = {
    "aum_mismatch": lambda c: aum_mismatch(c.docs, c.rules, c.odd),
    "fee_mismatch": lambda c: fee_mismatch(c.docs, c.rules, c.odd),
    "target_irr_drift": lambda c: target_irr_drift(c.docs, c.rules, c.odd),
    "definition_drift": lambda c: definition_drift(c.docs),
    "definition_drift_internal": lambda c: definition_drift_internal(c.docs),
    "under_target": lambda c: under_target(c.docs),
    "extractor_disagreement": lambda c: extractor_disagreement(c.docs, c.found),
    "irr_mention_conflict": lambda c: irr_mention_conflict(c.docs, c.mentions, c.rules),
}


def run_rules(docs: DataFrame, mentions: DataFrame, found: DataFrame, rules: Rules = Rules(), names: Iterable[str] | None = None, odd: DataFrame | None = None) -> DataFrame:
    """Flags of all rules, or of those named; odd: of figures_at_odds(), where it is known."""
    case, out = Case(docs, mentions, found, rules, odd), None
    for name in REGISTRY if names is None else names:
        part = REGISTRY[name](case).select(*FLAG)
        out = part if out is None else out.unionByName(part)
    return out


#: What is counted without its pairs: rule -> (severity, type, documents and values at odds of a Case).
PAIRS = {
    "aum_mismatch": ("RED", "AUM_MISMATCH", lambda c: _figures(c.docs, "aum", c.rules, c.odd)),
    "fee_mismatch": ("RED", "MGMT_FEE_MISMATCH", lambda c: _figures(c.docs, "mgmt_fee", c.rules, c.odd)),
    "target_irr_drift": ("YELLOW", "TARGET_IRR_DRIFT", lambda c: _figures(c.docs, "target_irr", c.rules, c.odd)),
    "definition_drift": ("YELLOW", "IRR_DEFINITION_DRIFT", lambda c: _conventions(c.docs)),
}


def flag_counts(docs: DataFrame, mentions: DataFrame, found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(fund, severity, type, n): how many flags run_rules() gives of documents without fresh; pairs are not made for it."""
    case, out = Case(docs, mentions, found, rules), None
    for name, rule in REGISTRY.items():
        if name in PAIRS:
            severity, kind, of = PAIRS[name]
            part = _pair_count(*of(case)).select("fund", F.lit(severity).alias("severity"), F.lit(kind).alias("type"), "n")
        else:
            part = rule(case).groupBy("fund", "severity", "type").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
