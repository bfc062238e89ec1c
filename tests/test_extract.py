"""Extraction, layout and table operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import extract, layout, reports, tables

DDL = "doc_id long, doc_ord long, doc_name string, page_num int, text string"


def pages(spark, *texts):
    return spark.createDataFrame([(1, 0, "a.txt", k + 1, t) for k, t in enumerate(texts)], DDL)


def values(spark, *texts, **more):
    return {r.field: r.value for r in extract.metric_candidates(pages(spark, *texts), **more).collect()}


@pytest.mark.parametrize(
    "text, field, value",
    [
        ("Management Fee\n2.00% on committed capital", "mgmt_fee", 2.0),
        ("Management Fee " + "x" * 200 + " 9.99%", "mgmt_fee", None),
        ("Net IRR\n16.80%", "net_irr", 16.8),
        ("Net IRR: 16%", "net_irr", None),
        ("Net IRR\n16.80%\nManagement Fee: 2.00%", "net_irr", 2.0),
        ("Target IRR: 18.5%", "target_irr", 5.0),
        ("TVPI: 1.55x", "tvpi", 1.55),
        ("Assets Under Management (AUM): $1.20B", "aum", 1.2e9),
        ("Carry: 20% over an 8% preferred return", "carry", 20.0),
    ],
)
def test_fields(spark, text, field, value):
    assert values(spark, text)[field] == value


def test_decimal_target_on_request(spark):
    assert values(spark, "Target IRR: 18.5%", decimal_targets=True)["target_irr"] == 18.5


def test_first_pattern_wins_over_first_page(spark):
    assert values(spark, "TVPI 1.10x", "TVPI: 2.20x")["tvpi"] == 2.2


def test_missing_and_dates(spark):
    p = pages(spark, "Effective Date: 2026-01-15\nCarry: 20%", None)
    got = extract.missing_fields(extract.metric_candidates(p)).first().missing_fields
    assert got == ["aum.value", "net_irr.value", "tvpi.value", "target_irr.value", "mgmt_fee.value", "carry.hurdle"]
    assert extract.doc_dates(p).first().doc_date == "2026-01-15"
    assert extract.metric_candidates(pages(spark).limit(0)).count() == 0


def test_mentions(spark):
    got = extract.irr_mentions(pages(spark, "Net IRR: 16.8%\nTarget IRR: 18%\ntargeting a 20% gross IRR", "Net IRR\nand more 2.25%")).orderBy("mention_ord").collect()
    assert [(r.value, r.basis, r.page) for r in got] == [(16.8, "net", 1), (18.0, None, 1), (20.0, "gross", 1)]


def test_basis_prefers_definitions(spark):
    p = pages(spark, "Performance Summary\nNet IRR 16%\nDefinitions\nReturns are gross of fees.")
    s = layout.sections_from_text(p.select("doc_id", "text"))
    got = extract.irr_basis(p, s).first()
    assert (got.basis, got.section) == ("gross", "Definitions")


def test_sections_and_footnotes(spark):
    d = pages(spark, "intro\nTERMS\nbody one\n\nRisk Factors\nrisky\n1) a note here").select("doc_id", "text")
    got = layout.sections_from_text(d).orderBy("section_ord").collect()
    assert [(r.title, r.canonical_type, r.text) for r in got] == [("Front Matter", None, "intro"), ("TERMS", "terms", "body one"), ("Risk Factors", "risk_factors", "risky")]
    assert [(r.marker, r.text) for r in layout.text_footnotes(d).collect()] == [("1", "1) a note here")]
    assert layout.section_types(layout.sections_from_text(d)).first().section_types == ["terms", "risk_factors"]
    empty = layout.sections_from_text(pages(spark, None).select("doc_id", "text")).collect()
    assert [(r.title, r.text) for r in empty] == [("Front Matter", "")]


def test_sections_from_lines(spark):
    rows = [(1, 1, 0, "Big Heading", 14.0, False, 0.1), (1, 1, 1, "body text", 10.0, False, 0.2), (1, 1, 2, "1) small note", 8.0, False, 0.9), (1, 2, 0, "Definitions", 10.0, False, 0.1), (1, 2, 1, "more", 10.0, False, 0.2)]
    lines = spark.createDataFrame(rows, "doc_id long, page_num int, line_no int, text string, size double, bold boolean, y_frac double")
    got = layout.sections_from_lines(lines).orderBy("section_ord").collect()
    assert [(r.title, r.page_start, r.page_end, r.text) for r in got] == [("Front Matter", 1, 1, ""), ("Big Heading", 1, 2, "body text"), ("Definitions", 2, 2, "more")]
    assert layout.pdf_footnotes(lines).first().marker == "1"
    assert {(r.page_num, r.title) for r in layout.section_for_page(layout.sections_from_lines(lines), lines).collect()} == {(1, "Front Matter"), (2, "Big Heading")}


@pytest.mark.parametrize("sizes, most, chunks", [([100] * 5, 250, [0, 0, 1, 1, 2]), ([300, 10], 250, [0, 1]), ([0, 300], 250, [0, 1])])
def test_chunks(spark, sizes, most, chunks):
    got = layout.chunked(pages(spark, *["x" * n for n in sizes]), most).orderBy("page_num").collect()
    assert [r.chunk for r in got] == chunks


def test_table_metrics(spark):
    row = lambda *cells: [(f"h{k}", c) for k, c in enumerate(cells)]
    rows = [row("Net IRR", "16.80%"), row("TVPI", "1.62x"), row("MOIC", "2.10x"), row("AUM", "$1.25B"), row("Fee", None)]
    t = spark.createDataFrame([(1, 0, "t", 3, rows, ["note"])], "doc_id long, table_ord int, table_id string, page int, rows array<array<struct<header:string,value:string>>>, footnotes array<string>")
    got = {r.metric: r.value for r in tables.table_metrics(tables.all_tables(t, t)).collect()}
    assert got == {"irr": 16.8, "tvpi": 1.62, "aum": 1.25e9}


def test_redaction(spark):
    said = "a@b.com, 555-123-4567, 123-45-6789, Account No: 12345678; AUM $1.2B, 16.8%"
    got = spark.createDataFrame([(said,)], "t string").select(T.redacted(F.col("t"))).first()[0]
    assert got == "[REDACTED-EMAIL], [REDACTED-PHONE], [REDACTED-SSN], [REDACTED-ACCOUNT]; AUM $1.2B, 16.8%"


def test_formats(spark):
    df = spark.createDataFrame([(1.25e9, "a **b** & *c*", "```md\nx\n```")], "m double, s string, f string")
    got = df.select(T.money(F.col("m")), T.inline_markup(F.col("s")), T.unfenced(F.col("f")), T.tier(F.col("m") / 2e9), T.cell(F.lit(float("nan")))).first()
    assert tuple(got) == ("$1.25B", "a <b>b</b> &amp; <i>c</i>", "x", "Medium", "N/A")


def test_memos(spark):
    df = spark.createDataFrame([(1, "```md\n## **A** & b\n* one\n2. two\n----\n\nplain\n```"), (2, None), (3, "")], "doc_id long, memo string")
    got = [(r.kind, r.level, r.text) for r in reports.memo_lines(df).where("doc_id = 1").orderBy("line_ord").collect()]
    assert got == [("heading", 2, "<b>A</b> &amp; b"), ("bullet", None, "one"), ("numbered", None, "2. two"), ("rule", None, ""), ("blank", None, ""), ("body", None, "plain")]
    assert [r.kind for r in reports.memo_lines(df).where("doc_id > 1").collect()] == ["blank", "blank"]
    assert [r[0] for r in df.orderBy("doc_id").select(T.plain_memo(F.col("memo"))).collect()] == ["md\nA & b\n* one\n2. two\n\nplain", None, ""]


def test_matching_blocks_equal_difflib():
    import difflib
    import random

    from factloom.functions.matching import matching_size

    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc ", "abcdefgh é𝔸"])
        page = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        said = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        if page and rng.random() < 0.3:
            k = rng.randrange(len(page))
            said = (page[k : k + 20] + said)[:25]
        assert matching_size(page, said) == sum(b.size for b in difflib.SequenceMatcher(None, page, said, autojunk=False).get_matching_blocks())
    assert matching_size("", "a") == matching_size("a", "") == 0


def test_patterns_are_tried_wherever_they_could_match(spark):
    """Against every pattern on every page, with letters that match others only when case is ignored."""
    import random

    from factloom.functions import patterns as P
    from factloom.functions import text as T

    rng = random.Random(4)
    bits = ["AUM) $1.25B", "assetſ under management: $2.5B", "NET İRR: 12.5%", "net ırr 3.5%", "TVPI: 1.5x", "MarKet", "Management fee 1.75%", "target irr: 18%", "carrıed interest 20%", "Carry: 15%", "over an 8% preferred", "hurdle 7%", "As-of Date: 2025-01-01", "effective date: 2025-02-02", "x" * 90, "\n", "Assets Under Management Fee: 2.25% $3.50B"]
    rows = [(k, 1, None if k == 0 else " ".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    pages = spark.createDataFrame(rows, "doc_id long, page_num int, text string")
    fields = (*P.FIELD_PATTERNS, ("doc_date", P.DATE_PATTERNS), ("odd", (r"(?:a|b)(x)",)))
    got = sorted(map(tuple, extract.pattern_hits(pages, fields).collect()))
    want = []
    for name, ps in fields:
        for k, p in enumerate(ps):
            c = F.col("text")
            want += [(r.doc_id, 1, name, k, r.raw, r.snippet) for r in pages.select("doc_id", T.first_group(c, p).alias("raw"), T.snippet(c, p, 50, 20).alias("snippet")).where("raw is not null").collect()]
    assert got == sorted(want) and len(got) > 300
    assert {extract.anchor(p) for _, ps in P.FIELD_PATTERNS for p in ps} == {"aum)", "assets under management", "net irr", "tvpi", "target irr", "management fee", "carry:", "carried interest", "over an", "hurdle"}
    assert extract.anchor(r"ab?c") == "a" and extract.anchor(r"ab|c") == "" and extract.anchor(r"\s*x") == ""


def test_lines_of_blocks(spark):
    """Blocks without lines, lines without spans, blank texts, missing sizes and flags, pages without height."""
    ddl = "doc_id string, page_num int, height double, blocks array<struct<lines: array<struct<y0: double, spans: array<struct<text: string, size: double, flags: int>>>>>>"
    span = lambda *s: [{"text": t, "size": z, "flags": f} for t, z, f in s]
    blocks = [{"lines": None}, {"lines": [{"y0": 10.0, "spans": span((" Net ", 9.0, 0), ("IRR ", 11.5, 16))}, {"y0": 20.0, "spans": None}, {"y0": 30.0, "spans": span(("  ", 30.0, 16))}]}, None, {"lines": [{"y0": 50.0, "spans": span((None, None, None), ("x", None, 4))}]}]
    df = spark.createDataFrame([("a", 1, 100.0, blocks), ("a", 2, 0.0, blocks[1:2]), ("b", 1, None, None)], ddl)
    got = sorted(map(tuple, layout.block_lines(df).collect()))
    assert got == [("a", 1, 0, "Net IRR", 11.5, True, 0.1), ("a", 1, 1, "x", 0.0, False, 0.5), ("a", 2, 0, "Net IRR", 11.5, True, 10.0)]
