"""One query for each operator, over whole tables, with the DuckDB SQL that gives the same rows.

Text operators run on documents, pages and conversations; financial ones on fund
documents made from supplier rows (reports_data), nation by nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUTHORITY_WEIGHTS, METRICS
from ..functions import patterns as P
from ..functions import text as T
from ..operators import extract, fusion, layout, reports, responses, rules, tables
from ..sources import files
from . import pipeline
from .reports_data import PAGES, pages

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- text operators on real tables

_REDACTED = "text"
for _p, _to in P.REDACTIONS:
    _REDACTED = f"regexp_replace({_REDACTED}, {_quoted(_p.replace('(?i)', ''))}, {_quoted(_to)}, {_quoted('gi' if _p.startswith('(?i)') else 'g')})"


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha, length({_REDACTED}) AS n_chars FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.redacted(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("redacted_sha"), F.length(t).cast("long").alias("n_chars"))


_LINES = "SELECT doc_id, i - 1 AS line_no, trim(x, chr(32)||chr(9)||chr(13)) AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(x, chr(32)||chr(9)||chr(13)) <> ''"
_WORDS = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"
_CANON = "CASE " + " ".join(f"WHEN regexp_matches(text, {_quoted(p)}, 'i') THEN {_quoted(n)}" for n, p in P.CANONICAL_PATTERNS) + " END"
_KIND = f"CASE WHEN regexp_matches(text, {_quoted(P.FOOTNOTE)}) AND {_WORDS} <= 40 THEN 'footnote' WHEN {_CANON} IS NOT NULL OR ({_WORDS} <= 12 AND ((upper(text) = text AND lower(text) <> text) OR ends_with(text, ':'))) THEN 'heading' ELSE 'text' END"
_KINDS = f"SELECT *, {_KIND} AS kind, {_CANON} AS canon FROM ({_LINES})"
_SECTIONED = f"SELECT *, coalesce(sum((kind = 'heading')::int) OVER (PARTITION BY doc_id ORDER BY line_no), 0)::int AS section_ord FROM ({_KINDS})"
_SECTIONS = f"""SELECT d.doc_id, d.section_ord, CASE WHEN d.section_ord = 0 THEN 'Front Matter' ELSE max(CASE WHEN kind = 'heading' THEN text END) END AS title,
  max(CASE WHEN kind = 'heading' THEN canon END) AS canonical_type, trim(coalesce(string_agg(CASE WHEN kind = 'text' THEN text END, ' ' ORDER BY line_no), '')) AS text
FROM (SELECT DISTINCT doc_id, 0 AS section_ord FROM documents UNION SELECT DISTINCT doc_id, section_ord FROM ({_SECTIONED})) d LEFT JOIN ({_SECTIONED}) l USING (doc_id, section_ord) GROUP BY d.doc_id, d.section_ord"""


@query(f"SELECT doc_id, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS lines_sha FROM ({_LINES}) GROUP BY doc_id")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.text_lines(_table(spark, sf_dir, "documents"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sha2(held, 256).alias("lines_sha"))


@query(f"SELECT doc_id, section_ord, title, canonical_type, sha256(text) AS text_sha FROM ({_SECTIONS})")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.sections_from_text(_table(spark, sf_dir, "documents"))
    return s.select("doc_id", "section_ord", "title", "canonical_type", F.sha2("text", 256).alias("text_sha"))


_OF = lambda sql, source: sql.replace("FROM documents", f"FROM ({source})")
_SECOND_PAGES = f"SELECT doc_id, text FROM ({PAGES}) WHERE page_num = 2"
_NOTES = f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::int - 1 AS fn_ord, trim(regexp_extract(text, {_quoted(P.FOOTNOTE)}, 1), '().*') AS marker, text, 2 AS page_num FROM ({_OF(_KINDS, _SECOND_PAGES)}) WHERE kind = 'footnote'"


@query(_NOTES)
def text_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fund documents' second pages; the table documents has no line that reads as a footnote."""
    return layout.text_footnotes(pages(spark, sf_dir).where("page_num = 2"), page=2).select("doc_id", "fn_ord", "marker", "text", "page_num")


@query(f"SELECT doc_id, coalesce(array_to_string(list(canonical_type ORDER BY o) FILTER (WHERE canonical_type IS NOT NULL), ','), '') AS section_types FROM (SELECT doc_id, canonical_type, min(section_ord) AS o FROM ({_SECTIONS}) GROUP BY doc_id, canonical_type) GROUP BY doc_id")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.section_types(layout.sections_from_text(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.array_join("section_types", ",").alias("section_types"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r(conv_id, turn, k, chunk, len) AS (SELECT conv_id, turn, k, 0, n FROM t WHERE k = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.k, CASE WHEN r.len + t.n > 1500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.len + t.n > 1500 THEN t.n ELSE r.len + t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, turn, chunk FROM r""")
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.chunked(_table(spark, sf_dir, "conversations"), 1500, "conv_id", "turn")


_AUTHORITY = lambda name: "CASE " + " ".join(f"WHEN contains(lower({name}), {_quoted(k)}) THEN {w}" for k, w in AUTHORITY_WEIGHTS) + " ELSE 0.5 END::double"


@query(f"SELECT page_id, CASE {' '.join(f'WHEN contains(lower(url), {_quoted(k)}) THEN {w}::double' for k, w in AUTHORITY_WEIGHTS)} ELSE 0.5::double END AS weight FROM pages")
def authority_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", fusion.authority_weight(F.col("url")).alias("weight"))


@query("SELECT doc_id AS path, sha256(coalesce(text, '')) AS sha256 FROM documents")
def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return reports.input_manifest(files)


@query("SELECT event_id, json_extract_string(props, '$.k')::bigint AS k FROM events")
def json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as models give them: fenced, in prose, with single quotes and a trailing comma."""
    e = _table(spark, sf_dir, "events")
    said = F.concat(F.lit("Here it is:\n```json\n"), F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(",}")), F.lit("\n```"))
    return e.select("event_id", F.try_variant_get(T.parsed_json(said), "$.k", "bigint").alias("k"))


# ---- fund documents

_HIT = lambda f, k, p: f"SELECT doc_id, '{f}' AS field, {k} AS pattern_ord, page_num, nullif(regexp_extract(text, {_quoted(p)}, 1, 'i'), '') AS raw, regexp_extract(text, {_quoted(p)}, 0, 'i') AS hit, text FROM p"
_ALL = [(f, k, p) for f, ps in P.FIELD_PATTERNS for k, p in enumerate(ps)]
_FIRST = f"""p AS ({PAGES}), h AS ({' UNION ALL '.join(_HIT(*x) for x in _ALL)}),
f AS (SELECT doc_id, field, raw, page_num AS page, hit, text FROM h WHERE raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY pattern_ord, page_num) = 1)"""
_GRID = f"""g AS (SELECT DISTINCT doc_id, doc_ord, doc_name, fund FROM p), m0 AS (SELECT unnest({list(METRICS)!r}) AS field),
m AS (SELECT g.*, m0.field, CASE WHEN m0.field = 'aum' THEN f.raw::double * 1e9 ELSE f.raw::double END AS value, CASE WHEN m0.field = 'carry' THEN hu.raw::double END AS hurdle, f.page, CASE WHEN f.raw IS NULL THEN 0.0 ELSE 0.55 END::double AS confidence
  FROM g CROSS JOIN m0 LEFT JOIN f ON f.doc_id = g.doc_id AND f.field = m0.field LEFT JOIN f hu ON hu.doc_id = g.doc_id AND hu.field = 'hurdle')"""
_M = f"WITH {_FIRST}, {_GRID}"
_WIDE = "w AS (SELECT fund, doc_id, doc_ord, doc_name, " + ", ".join(f"max(value) FILTER (WHERE field = '{x}') AS {x}" for x in METRICS) + " FROM m GROUP BY ALL)"


@query(f"{_M} SELECT doc_id, field, value, hurdle, confidence, coalesce(page, 0) AS page FROM m")
def extract_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.metric_candidates(pages(spark, sf_dir)).select("doc_id", "field", "value", "hurdle", "confidence", F.coalesce("page", F.lit(0)).alias("page"))


@query(f"""WITH {_FIRST}, o AS (SELECT *, strpos(text, hit) AS st, length(hit) AS len FROM f WHERE field <> 'hurdle')
SELECT doc_id, field, array_to_string(string_split(trim(regexp_replace(substring(text, greatest(st - 50, 1), st + len + 49 - greatest(st - 50, 1) + 1), '\\s+', ' ', 'g')), ' ')[1:20], ' ') AS snippet FROM o""")
def extract_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.metric_candidates(pages(spark, sf_dir)).where("value is not null").select("doc_id", "field", "snippet")


@query(f"WITH {_FIRST}, {_GRID} SELECT doc_id, array_to_string(list(n ORDER BY o, s) FILTER (WHERE n IS NOT NULL), ',') AS missing FROM (SELECT doc_id, CASE WHEN value IS NULL THEN field || '.value' END AS n, list_position({list(METRICS)!r}, field) AS o, 0 AS s FROM m UNION ALL SELECT doc_id, CASE WHEN hurdle IS NULL AND field = 'carry' THEN 'carry.hurdle' END, 6, 1 FROM m) GROUP BY doc_id HAVING count(n) > 0")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.missing_fields(extract.metric_candidates(pages(spark, sf_dir)))
    return out.where("size(missing_fields) > 0").select("doc_id", F.array_join("missing_fields", ",").alias("missing"))


@query(f"""WITH p AS ({PAGES}), h AS (SELECT doc_id, page_num, 0 AS o, regexp_extract(text, {_quoted(P.DATE_PATTERNS[0])}, 1, 'i') AS d FROM p UNION ALL SELECT doc_id, page_num, 1, regexp_extract(text, {_quoted(P.DATE_PATTERNS[1])}, 1, 'i') FROM p)
SELECT doc_id, arg_min(nullif(d, ''), o * 10 + page_num) FILTER (WHERE d <> '') AS doc_date FROM h GROUP BY doc_id""")
def doc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.doc_dates(pages(spark, sf_dir))


# The documents state an IRR at most three times, each with its own words, so SQL can look for each by itself.
_NET_IRR, _TARGET_IRR, _PROSE_IRR = r"Net IRR[^%\n]{0,25}?([0-9]+(?:\.[0-9]+)?)\s*%", r"Target IRR[^%\n]{0,25}?([0-9]+(?:\.[0-9]+)?)\s*%", r"([0-9]+(?:\.[0-9]+)?)\s*%\s*gross irr\b"
_MENTIONS = f"""SELECT doc_id, page_num AS page, 0 AS o, 'net' AS basis, nullif(regexp_extract(text, {_quoted(_NET_IRR)}, 1, 'i'), '')::double AS value FROM p
UNION ALL SELECT doc_id, page_num, 1, NULL, nullif(regexp_extract(text, {_quoted(_TARGET_IRR)}, 1, 'i'), '')::double FROM p
UNION ALL SELECT doc_id, page_num, 2, 'gross', nullif(regexp_extract(text, {_quoted(_PROSE_IRR)}, 1, 'i'), '')::double FROM p"""
_MENTIONED = f"n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, o))::int - 1 AS mention_ord, value, basis, page FROM ({_MENTIONS}) WHERE value IS NOT NULL)"


@query(f"WITH p AS ({PAGES}), {_MENTIONED} SELECT * FROM n")
def irr_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.irr_mentions(pages(spark, sf_dir)).drop("snippet")


_FIRST_OF = lambda found, c: "CASE " + " ".join(f"WHEN regexp_matches({c}, {_quoted(p)}, 'i') THEN " + (_quoted(b) if found == "basis" else f"regexp_extract({c}, {_quoted(p)}, 0, 'i')") for b, ps in (("net", P.NET_PATTERNS), ("gross", P.GROSS_PATTERNS)) for p in ps) + " END"
_WHOLE = f"SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS text FROM ({PAGES}) GROUP BY doc_id"
_BASIS = f"""b AS (SELECT doc_id, basis, snippet, section FROM (
  SELECT doc_id, {_FIRST_OF("basis", "text")} AS basis, {_FIRST_OF("snippet", "text")} AS snippet, title AS section, 0 AS tier, coalesce(list_position({list(P.BASIS_SECTIONS)!r}, canonical_type), 99) AS rank, section_ord AS o FROM ({_OF(_SECTIONS, _WHOLE)})
  UNION ALL SELECT doc_id, {_FIRST_OF("basis", "text")}, {_FIRST_OF("snippet", "text")}, NULL, 1, 0, page_num FROM p)
  WHERE basis IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, rank, o) = 1)"""


@query(f"WITH p AS ({PAGES}), {_BASIS} SELECT doc_id, basis, snippet, section FROM b")
def irr_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return extract.irr_basis(p, _sections(p)).select("doc_id", "basis", "snippet", "section")


def _sections(p: DataFrame) -> DataFrame:
    whole = p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return layout.sections_from_text(whole)


def _doc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a supplier: rows of a label and a value, some without one of them, and a footnoted one."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    cell = lambda h, v: F.struct(F.lit(h).alias("header"), v.alias("value"))
    two = lambda a, b: F.array(cell("item", a), cell("amount", b))
    num = lambda a, b: F.concat(a.cast("string"), F.lit("."), F.lpad(b.cast("string"), 2, "0"))
    k = F.col("k")
    rows = F.array(
        two(F.lit("Fund size"), F.concat(F.lit("$"), num(k % 5 + 1, k % 100), F.lit("B"))),
        two(F.when(k % 2 == 0, "AUM").otherwise("Assets"), F.concat(F.lit("$"), num(k % 4 + 1, k % 100), F.lit("B"))),
        two(F.lit("Net IRR"), F.concat(num(k % 9 + 8, k % 100), F.lit("%"))),
        two(F.lit("TVPI"), F.when(k % 3 > 0, F.concat(num(k % 2 + 1, k % 100), F.lit("x")))),
    )
    return s.select(k.alias("doc_id"), F.lit(0).alias("table_ord"), F.concat(F.lit("t_"), k.cast("string")).alias("table_id"), (k % 2 + 1).cast("int").alias("page"), rows.alias("rows"), F.array().cast("array<string>").alias("footnotes"))


_TABLES = "SELECT s_suppkey::bigint AS doc_id, 'aum' AS metric, ((s_suppkey % 4 + 1)::varchar || '.' || lpad((s_suppkey % 100)::varchar, 2, '0'))::double * 1e9 AS value FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'irr', ((s_suppkey % 9 + 8)::varchar || '.' || lpad((s_suppkey % 100)::varchar, 2, '0'))::double FROM supplier UNION ALL SELECT s_suppkey, 'tvpi', ((s_suppkey % 2 + 1)::varchar || '.' || lpad((s_suppkey % 100)::varchar, 2, '0'))::double FROM supplier WHERE s_suppkey % 3 > 0"


@query(f"SELECT doc_id, metric, value, (doc_id % 2 + 1)::int AS page, 't_' || doc_id::varchar AS table_id FROM ({_TABLES})")
def table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_metrics(_doc_tables(spark, sf_dir)).select("doc_id", "metric", "value", "page", "table_id")


@query(f"{_M}, t AS ({_TABLES}) SELECT m.doc_id, m.field, coalesce(m.value, t.value) AS value, m.value IS NULL AND t.value IS NOT NULL AS from_table FROM m LEFT JOIN t ON t.doc_id = m.doc_id AND m.field = CASE t.metric WHEN 'irr' THEN 'net_irr' ELSE t.metric END")
def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fusion.fused(extract.metric_candidates(pages(spark, sf_dir)).withColumn("extractor_ord", F.lit(0)))
    return tables.with_fallback(own, tables.table_metrics(_doc_tables(spark, sf_dir))).select("doc_id", "field", "value", "from_table")


@query(f"""SELECT s_suppkey::bigint AS doc_id, (s_suppkey % 2 + 1)::int AS page, coalesce(string_agg(n.text, '|' ORDER BY n.fn_ord), '') AS footnotes
FROM supplier LEFT JOIN ({_NOTES}) n ON n.doc_id = s_suppkey AND n.page_num = s_suppkey % 2 + 1 GROUP BY s_suppkey""")
def footnote_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = pages(spark, sf_dir).where("page_num = 2")
    out = layout.linked_footnotes(_doc_tables(spark, sf_dir), layout.text_footnotes(second, page=2))
    return out.select("doc_id", "page", F.array_join("footnotes", "|").alias("footnotes"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns' candidates, and those of two other extractors that differ from them by document."""
    own = extract.metric_candidates(pages(spark, sf_dir)).withColumn("extractor_ord", F.lit(2))
    d = F.col("doc_id")
    hosted = own.withColumns({"extractor": F.lit("CohereExtractor"), "extractor_ord": F.lit(0), "value": F.when(d % 5 == 4, F.col("value") * 1.5).otherwise(F.col("value")), "confidence": 0.5 + 0.125 * (d % 4)})
    local = own.withColumns({"extractor": F.lit("OllamaExtractor"), "extractor_ord": F.lit(1), "value": F.when(d % 3 > 0, F.col("value") * (1 + 0.0625 * (d % 2))), "confidence": 0.5 + 0.25 * (d % 2)})
    return own.unionByName(hosted).unionByName(local)


_C = f"""{_M}, c AS (SELECT doc_id, field, 'RegexExtractor' AS extractor, 2 AS o, value, confidence, 0.95::double AS weight FROM m
UNION ALL SELECT doc_id, field, 'CohereExtractor', 0, CASE WHEN doc_id % 5 = 4 THEN value * 1.5::double ELSE value END, 0.5::double + 0.125::double * (doc_id % 4), 0.7::double FROM m
UNION ALL SELECT doc_id, field, 'OllamaExtractor', 1, CASE WHEN doc_id % 3 > 0 THEN value * (1::double + 0.0625::double * (doc_id % 2)) END, 0.5::double + 0.25::double * (doc_id % 2), 0.6::double FROM m),
a AS (SELECT doc_id, field, count(DISTINCT value) AS distinct_values, CASE WHEN count(value) < 2 OR abs(max(value)) + abs(min(value)) = 0 THEN 1.0::double WHEN abs(max(value) - min(value)) / ((abs(max(value)) + abs(min(value))) / 2) <= 0.05 THEN 1.0 ELSE greatest(0.0::double, 1.0::double - abs(max(value) - min(value)) / ((abs(max(value)) + abs(min(value))) / 2)) END AS agreement FROM c GROUP BY doc_id, field)"""


@query(f"{_C} SELECT doc_id, field, extractor, value, agreement FROM c JOIN a USING (doc_id, field) QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence * weight DESC, o) = 1")
def fuse_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused(_candidates(spark, sf_dir)).select("doc_id", "field", "extractor", "value", "agreement")


@query(f"{_C} SELECT doc_id, field, agreement, distinct_values FROM a")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.agreements(_candidates(spark, sf_dir))


@query(f"{_C} SELECT doc_id, field, agreement FROM a WHERE distinct_values > 1 AND agreement < 0.85")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.disagreements(_candidates(spark, sf_dir)).select("doc_id", "field", "agreement")


@query(f"{_C} SELECT doc_id, field, extractor, value, confidence * weight AS score, CASE WHEN row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence * weight DESC, o) = 1 THEN '✓' ELSE '' END AS winner FROM c")
def candidates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.candidates_view(fusion.scored_candidates(_candidates(spark, sf_dir))).select("doc_id", "field", "extractor", "value", "score", "winner")


_SCORED = f"v AS (SELECT m.*, CASE WHEN value IS NULL THEN 0.0 ELSE 0.35::double * 0.55 + 0.25::double * {_AUTHORITY('doc_name')} + 0.20::double * 1.0 + 0.20::double * 0.5 END::double AS final FROM m)"


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = pages(spark, sf_dir)
    docs = p.select("doc_id", "doc_ord", "doc_name", "fund").distinct().join(extract.doc_dates(p), "doc_id")
    return fusion.verified(fusion.fused(extract.metric_candidates(p).withColumn("extractor_ord", F.lit(0))), p, docs), docs


@query(f"{_M}, {_SCORED} SELECT doc_id, field, final AS confidence, CASE WHEN value IS NOT NULL THEN 1.0::double END AS match_ratio FROM v")
def verify_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[0].select("doc_id", "field", "confidence", "match_ratio")


#: Evidence as pages say it: a snippet that lost its first letter matches in one block less that letter, one of other signs nowhere.
_PLAIN = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_DAMAGED = f"""o AS (SELECT doc_id, field, text, strpos(text, hit) AS st, length(hit) AS len FROM f WHERE field <> 'hurdle'),
s AS (SELECT doc_id, field, text, array_to_string(string_split(trim(regexp_replace(substring(text, greatest(st - 50, 1), st + len + 49 - greatest(st - 50, 1) + 1), '\\s+', ' ', 'g')), ' ')[1:20], ' ') AS snippet FROM o),
x AS (SELECT doc_id, field, {_PLAIN('text')} AS page_text, {_PLAIN("CASE doc_id % 3 WHEN 0 THEN '#~#~#~#~#~#~#~#~#~#~' WHEN 1 THEN '#' || substring(snippet, 2) ELSE snippet END")} AS said FROM s),
r AS (SELECT doc_id, field, CASE WHEN contains(page_text, said) THEN 1.0 WHEN contains(page_text, substring(said, 2)) THEN (length(said) - 1) / length(said) ELSE 0.0 END::double AS ratio FROM x)"""


@query(f"""{_M}, {_SCORED}, {_DAMAGED}
SELECT v.doc_id, v.field, final * CASE WHEN v.value IS NULL OR ratio >= 1 THEN 1.0::double WHEN ratio >= 0.8 THEN 0.75 ELSE 0.4 END AS confidence,
  CASE WHEN v.value IS NULL OR ratio >= 1 THEN NULL WHEN ratio >= 0.8 THEN 'matched page fuzzily' ELSE 'not found verbatim' END AS note FROM v LEFT JOIN r ON r.doc_id = v.doc_id AND r.field = v.field""")
def verify_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of a third of the documents replaced by what no page says, of another third with their first letter lost in a scan."""
    p = pages(spark, sf_dir)
    docs = p.select("doc_id", "doc_ord", "doc_name", "fund").distinct().join(extract.doc_dates(p), "doc_id")
    m = fusion.fused(extract.metric_candidates(p).withColumn("extractor_ord", F.lit(0)))
    d = F.col("doc_id") % 3
    m = m.withColumn("snippet", F.when(F.col("value").isNull(), F.col("snippet")).when(d == 0, F.lit("#~#~#~#~#~#~#~#~#~#~")).when(d == 1, F.concat(F.lit("#"), F.substring("snippet", 2, 10_000))).otherwise(F.col("snippet")))
    out = fusion.verified(m, p, docs)
    note = F.when(F.col("note").contains("not found verbatim"), "not found verbatim").when(F.col("note").contains("matched page fuzzily"), "matched page fuzzily")
    return out.select("doc_id", "field", "confidence", note.alias("note"))


_LAYER = "CASE WHEN o_orderkey % 3 = 0 THEN ' few ' ELSE concat('a text layer of ', CAST(o_orderkey AS STRING), ' with enough characters') END"
_SCAN = "CASE WHEN o_orderkey % 2 = 0 THEN concat('what the scan of page ', CAST(o_orderkey AS STRING), ' says') ELSE 'x' END"


@query(f"SELECT doc_id, CASE WHEN length(trim(own)) < 20 AND length(trim(scan)) > length(trim(own)) THEN scan ELSE own END AS text FROM (SELECT o_orderkey AS doc_id, {_LAYER} AS own, {_SCAN} AS scan FROM orders)")
def ocr_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with next to no text take the scan's if it has more; the others keep theirs."""
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "1 AS page_num", f"{_LAYER} AS text", f"{_SCAN} AS ocr_text")
    return files.with_ocr(o.drop("ocr_text"), o.drop("text")).select("doc_id", "text")


@query(f"""{_M}, w AS (SELECT doc_id, doc_ord, doc_name, fund, max(value) FILTER (WHERE field = 'mgmt_fee') AS v FROM m GROUP BY ALL)
SELECT x.fund, x.doc_ord * 4294967296 + y.doc_ord AS flag_ord, x.doc_name || ' vs ' || y.doc_name AS docs, printf('Management fee differs: %.2f%% vs %.2f%%', x.v, y.v) AS detail,
  'Fee terms directly affect net returns and legal obligations; LPA typically governs.' AS why_it_matters, 'Confirm the controlling fee schedule and whether any side-letter modifies the base fee.' AS question_to_ask
FROM w x JOIN w y ON x.fund = y.fund AND x.doc_ord < y.doc_ord WHERE abs(x.v - y.v) > 0.25""")
def fee_flag_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fee_mismatch(_docs(spark, sf_dir)).select("fund", "flag_ord", "docs", "detail", "why_it_matters", "question_to_ask")


@query()
def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets with characters lost, as scans lose them: difflib decides, so there is no SQL."""
    p = pages(spark, sf_dir)
    m = extract.metric_candidates(p).where("value is not null").withColumn("snippet", F.regexp_replace("snippet", "a", "o"))
    return fusion.match_ratios(m, p).select("doc_id", "field", F.round("match_ratio", 6).alias("match_ratio"))


def _analysis(spark: SparkSession, sf_dir: str) -> pipeline.Analysis:
    return pipeline.analyse(pages(spark, sf_dir))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    m = extract.metric_candidates(p)
    basis = extract.irr_basis(p, _sections(p)).select("doc_id", F.struct("basis", "snippet", "page", "section").alias("basis"))
    return p.select("doc_id", "doc_ord", "doc_name", "fund").distinct().join(fusion.wide(m), "doc_id").join(basis, "doc_id", "left")


_PAIR = lambda v, test: f"SELECT x.fund, x.doc_name || ' vs ' || y.doc_name AS docs, x.{v} AS a, y.{v} AS b FROM w x JOIN w y ON x.fund = y.fund AND x.doc_ord < y.doc_ord WHERE {test}"
_AUM = _PAIR("aum", "abs(x.aum - y.aum) / ((abs(x.aum) + abs(y.aum)) / 2) > 0.03")
_FEE = _PAIR("mgmt_fee", "abs(x.mgmt_fee - y.mgmt_fee) > 0.25")
_DRIFT = _PAIR("target_irr", "abs(x.target_irr - y.target_irr) > 2.0")


@query(f"{_M}, {_WIDE} {_AUM}")
def aum_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.aum_mismatch(_docs(spark, sf_dir)).select("fund", "docs", "a", "b")


@query(f"{_M}, {_WIDE} {_FEE}")
def fee_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fee_mismatch(_docs(spark, sf_dir)).select("fund", "docs", "a", "b")


@query(f"{_M}, {_WIDE} {_DRIFT}")
def target_irr_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.target_irr_drift(_docs(spark, sf_dir)).select("fund", "docs", "a", "b")


_DEFS = "SELECT x.fund, x.doc_name || ' vs ' || y.doc_name AS docs, 'Documents state different IRR return conventions: \"' || x.basis || '\" vs \"' || y.basis || '\".' AS detail FROM k x JOIN k y ON x.fund = y.fund AND x.doc_ord < y.doc_ord WHERE x.basis <> y.basis"
_K = "k AS (SELECT w.*, basis FROM w JOIN b USING (doc_id))"


@query(f"{_M}, {_WIDE}, {_BASIS}, {_K} {_DEFS}")
def definition_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.definition_drift(_docs(spark, sf_dir)).select("fund", "docs", "detail")


@query(f"{_M}, {_WIDE}, {_BASIS}, {_K} SELECT fund, doc_name AS docs, 'The reported IRR figure reads as \"net\" but this document defines its convention as \"' || basis || '\" elsewhere.' AS detail FROM k WHERE basis = 'gross'")
def definition_drift_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.definition_drift_internal(_docs(spark, sf_dir)).select("fund", "docs", "detail")


@query(f"{_M}, {_WIDE} SELECT fund, doc_name AS docs, net_irr AS a, target_irr AS b FROM w WHERE net_irr < target_irr")
def under_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.under_target(_docs(spark, sf_dir)).select("fund", "docs", "a", "b")


@query(f"{_C} SELECT m.fund, m.doc_name AS docs, a.agreement AS a FROM a JOIN m USING (doc_id, field) WHERE distinct_values > 1 AND a.agreement < 0.85")
def extractor_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.extractor_disagreement(_docs(spark, sf_dir), fusion.disagreements(_candidates(spark, sf_dir))).select("fund", "docs", "a")


_CONFLICT = "SELECT w.fund, w.doc_name AS docs, n.value AS a FROM n JOIN w USING (doc_id) WHERE NOT coalesce(abs(n.value - w.target_irr) <= 1.0, false) AND NOT coalesce(abs(n.value - w.net_irr) <= 1.0, false)"


@query(f"{_M}, {_WIDE}, {_MENTIONED} {_CONFLICT}")
def irr_mention_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.irr_mention_conflict(_docs(spark, sf_dir), extract.irr_mentions(pages(spark, sf_dir))).select("fund", "docs", "a")


_FLAGS = f"""{_M}, {_WIDE}, {_BASIS}, {_K}, {_MENTIONED}, fl AS (SELECT fund, 'RED' AS severity, 'AUM_MISMATCH' AS type FROM ({_AUM}) UNION ALL SELECT fund, 'RED', 'MGMT_FEE_MISMATCH' FROM ({_FEE}) UNION ALL SELECT fund, 'YELLOW', 'TARGET_IRR_DRIFT' FROM ({_DRIFT})
UNION ALL SELECT fund, 'YELLOW', 'IRR_DEFINITION_DRIFT' FROM ({_DEFS}) UNION ALL SELECT fund, 'YELLOW', 'IRR_DEFINITION_DRIFT_INTERNAL' FROM k WHERE basis = 'gross' UNION ALL SELECT fund, 'YELLOW', 'UNDER_TARGET_PERFORMANCE' FROM w WHERE net_irr < target_irr UNION ALL SELECT fund, 'YELLOW', 'IRR_MENTION_CONFLICT' FROM ({_CONFLICT})),
s AS (SELECT w.fund, count(*) FILTER (WHERE severity = 'RED') AS red, count(*) FILTER (WHERE severity = 'YELLOW') AS yellow, 1 - exp(-coalesce(sum(CASE severity WHEN 'RED' THEN 1.0 WHEN 'YELLOW' THEN 0.5 END), 0)::double / 2) AS risk_score FROM (SELECT DISTINCT fund FROM w) w LEFT JOIN fl USING (fund) GROUP BY w.fund)"""


@query(f"{_FLAGS} SELECT fund, round(risk_score, 9) AS risk_score, red, yellow FROM s")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).scores.select("fund", F.round("risk_score", 9).alias("risk_score"), "red", "yellow")


@query(f"{_FLAGS} SELECT fund, CASE WHEN red >= 2 THEN 'PASS' WHEN red >= 1 OR yellow >= 3 THEN 'INVESTIGATE' ELSE 'APPROVE' END AS decision, CASE WHEN red >= 2 THEN 0.88 WHEN red >= 1 OR yellow >= 3 THEN 0.74 ELSE 0.66 END::double AS decision_confidence FROM s")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).scores.select("fund", "decision", "decision_confidence")


@query(f"{_FLAGS} SELECT fund, severity, count(*) AS n_flags FROM fl GROUP BY ALL")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_counts(_analysis(spark, sf_dir).flags, "fund")


@query(f"{_FLAGS} SELECT type, severity, count(*) AS n FROM fl WHERE type <> 'AUM_MISMATCH' GROUP BY ALL")
def eval_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags against an expectation that lacks all but the AUM ones: the difference is what was not expected."""
    x = pipeline.extracted(pages(spark, sf_dir))
    flags = rules.flag_counts(x.docs, x.mentions, x.disagreements)
    return reports.flag_difference_counts(flags, flags.where("type = 'AUM_MISMATCH'")).groupBy("type", "severity").agg(F.sum("n").alias("n"))


@query(f"""{_M}, {_SCORED}, x AS (SELECT doc_id, doc_name, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, max(final) FILTER (WHERE field = '{f}') AS {f}_c, max(page) FILTER (WHERE field = '{f}') AS {f}_p" for f in METRICS)}, max(hurdle) AS hurdle FROM v GROUP BY doc_id, doc_name)
SELECT doc_name, aum AS aum_value_usd, aum_c AS aum_conf, coalesce(aum_p, 0) AS aum_page, net_irr AS net_irr_pct, net_irr_c AS net_irr_conf, tvpi, target_irr AS target_irr_pct, mgmt_fee AS mgmt_fee_pct, mgmt_fee_c AS mgmt_fee_conf, carry AS carry_pct, hurdle AS carry_hurdle_pct, carry_c AS carry_conf FROM x""")
def facts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.facts_table(_analysis(spark, sf_dir).docs)
    return out.select("doc_name", "aum_value_usd", "aum_conf", F.coalesce("aum_page", F.lit(0)).alias("aum_page"), "net_irr_pct", "net_irr_conf", "tvpi", "target_irr_pct", "mgmt_fee_pct", "mgmt_fee_conf", "carry_pct", "carry_hurdle_pct", "carry_conf")


@query(f"{_M}, {_SCORED} SELECT doc_id, doc_name, count(value) AS fields_found, 6 AS fields_total, round(avg(final) FILTER (WHERE value IS NOT NULL), 9) AS avg_confidence, 0 AS fuzzy_matches, 0 AS not_found, (6 - count(value) + count(*) FILTER (WHERE field = 'carry' AND hurdle IS NULL))::int AS missing_count FROM v GROUP BY ALL")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return reports.data_quality(a.metrics, a.docs).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"{_M}, {_SCORED} SELECT count(value) AS present, count(*) AS total, round(avg(final) FILTER (WHERE value IS NOT NULL), 9) AS avg_confidence FROM v")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.completeness(_verified(spark, sf_dir)[0]).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"{_M}, {_SCORED} SELECT round(avg(q), 9) AS avg_of_documents FROM (SELECT avg(final) FILTER (WHERE value IS NOT NULL) AS q FROM v GROUP BY doc_id)")
def title_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, docs = _verified(spark, sf_dir)
    empty = F.array().cast("array<string>")
    quality = reports.data_quality(m, docs.withColumns({"notes": empty, "missing_fields": empty}))
    return reports.title_average(quality).select(F.round("avg_of_documents", 9).alias("avg_of_documents"))


@query(f"{_M}, {_SCORED} SELECT doc_id, round(sum(final) FILTER (WHERE field IN ('aum', 'net_irr', 'mgmt_fee', 'carry')) / 4, 9) AS evidence_confidence FROM v GROUP BY doc_id")
def evidence_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.evidence_average(fusion.wide(_verified(spark, sf_dir)[0])).select("doc_id", F.round("evidence_confidence", 9).alias("evidence_confidence"))


@query(f"{_M}, {_SCORED} SELECT field, CASE WHEN value IS NULL THEN 'N/A' WHEN final >= 0.75 THEN 'High' WHEN final >= 0.5 THEN 'Medium' ELSE 'Low' END AS tier, count(*) AS n FROM v GROUP BY ALL")
def confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confidence_tiers(_verified(spark, sf_dir)[0])


@query(f"""{_M}, {_WIDE}, {_MENTIONED}, own AS (SELECT fund, doc_name, 'Net IRR' AS label, net_irr AS value FROM w WHERE net_irr IS NOT NULL UNION ALL SELECT fund, doc_name, 'Target IRR', target_irr FROM w WHERE target_irr IS NOT NULL),
z AS (SELECT w.fund, w.doc_ord, w.doc_name, n.* FROM n JOIN w USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.fund = w.fund AND abs(own.value - n.value) <= 1.0) QUALIFY row_number() OVER (PARTITION BY w.fund, n.value, n.basis ORDER BY w.doc_ord, n.mention_ord) = 1)
SELECT fund, doc_name, label, value, 'extracted' AS status FROM own UNION ALL SELECT fund, doc_name, CASE basis WHEN 'gross' THEN 'Gross IRR (quoted)' WHEN 'net' THEN 'Net IRR (quoted)' ELSE 'IRR (quoted)' END, value, 'conflict' FROM z""")
def irr_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.irr_figures(_docs(spark, sf_dir), extract.irr_mentions(pages(spark, sf_dir)))


# ---- strings, layout of PDFs, tables and memos

_CITED = """sn AS (SELECT doc_id, field, page, array_to_string(string_split(trim(regexp_replace(substring(text, greatest(st - 50, 1), st + len + 49 - greatest(st - 50, 1) + 1), '\\s+', ' ', 'g')), ' ')[1:20], ' ') AS snippet
  FROM (SELECT *, strpos(text, hit) AS st, length(hit) AS len FROM f WHERE field <> 'hurdle'))"""
_AROUND = "trim(regexp_replace(substring(text, greatest(strpos(text, hit) - 30, 1), strpos(text, hit) + length(hit) + 30 - greatest(strpos(text, hit) - 30, 1)), '\\s+', ' ', 'g'))"
_SAID = f"""ms AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, o))::int - 1 AS mention_ord, {_AROUND} AS snippet
  FROM ({" UNION ALL ".join(f"SELECT doc_id, page_num, {o} AS o, text, regexp_extract(text, {_quoted(x)}, 0, 'i') AS hit FROM p" for o, x in enumerate((_NET_IRR, _TARGET_IRR, _PROSE_IRR)))}) WHERE hit <> '')"""


@query(f"WITH p AS ({PAGES}), {_SAID} SELECT * FROM ms")
def irr_mention_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.irr_mentions(pages(spark, sf_dir)).select("doc_id", "mention_ord", "snippet")


_BOTH = lambda n, x, detail: f"""SELECT x.fund, {n} AS rule_ord, x.doc_ord * 4294967296 + y.doc_ord AS flag_ord, x.doc_name || ' vs ' || y.doc_name AS docs, {detail} AS detail,
  x.doc_name || ' (p.' || x.page || '): ' || x.snippet || ' | ' || y.doc_name || ' (p.' || y.page || '): ' || y.snippet AS evidence
  FROM c x JOIN c y ON x.fund = y.fund AND x.field = y.field AND x.doc_ord < y.doc_ord WHERE x.field = '{x[0]}' AND {x[1]}"""  # noqa: E731
_DELTA = "abs(x.value - y.value) / ((abs(x.value) + abs(y.value)) / 2)"
_RULED = "' (p.1, ' || {0}.section || '): \"' || {0}.snippet || '\"'"


@query(f"""{_M}, {_WIDE}, {_BASIS}, {_MENTIONED}, {_CITED}, {_SAID}, c AS (SELECT m.*, sn.snippet FROM m JOIN sn USING (doc_id, field)), k AS (SELECT w.*, b.basis, b.section, b.snippet FROM w JOIN b USING (doc_id))
{_BOTH(0, ("aum", f"{_DELTA} > 0.03"), f"printf('AUM differs by %.1f%%', {_DELTA} * 100)")} UNION ALL {_BOTH(1, ("mgmt_fee", "abs(x.value - y.value) > 0.25"), "printf('Management fee differs: %.2f%% vs %.2f%%', x.value, y.value)")}
UNION ALL {_BOTH(2, ("target_irr", "abs(x.value - y.value) > 2.0"), "printf('Target IRR differs: %.1f%% vs %.1f%%', x.value, y.value)")}
UNION ALL SELECT x.fund, 3, x.doc_ord * 4294967296 + y.doc_ord, x.doc_name || ' vs ' || y.doc_name, 'Documents state different IRR return conventions: "' || x.basis || '" vs "' || y.basis || '".', x.doc_name || {_RULED.format("x")} || ' | ' || y.doc_name || {_RULED.format("y")} FROM k x JOIN k y ON x.fund = y.fund AND x.doc_ord < y.doc_ord WHERE x.basis <> y.basis
UNION ALL SELECT k.fund, 4, k.doc_ord * 4294967296, k.doc_name, 'The reported IRR figure reads as "net" but this document defines its convention as "gross" elsewhere.', 'Figure (p.' || c.page || '): "' || c.snippet || '" | Convention' || {_RULED.format("k")} FROM k JOIN c ON c.doc_id = k.doc_id AND c.field = 'net_irr' WHERE k.basis = 'gross'
UNION ALL SELECT fund, 5, doc_ord * 4294967296, doc_name, 'Net IRR below target IRR', 'Net IRR=' || net_irr::varchar || '% | Target IRR=' || target_irr::varchar || '%' FROM w WHERE net_irr < target_irr
UNION ALL SELECT w.fund, 7, w.doc_ord * 4294967296 + n.mention_ord, w.doc_name, 'Document also states a ' || coalesce(n.basis || ' ', '') || 'IRR of ' || n.value::varchar || '% elsewhere, which does not match the extracted Target IRR (' || coalesce(w.target_irr::varchar, 'None') || '%) or Net IRR (' || coalesce(w.net_irr::varchar, 'None') || '%).', 'p.' || n.page || ': "' || ms.snippet || '"'
  FROM n JOIN w USING (doc_id) JOIN ms USING (doc_id, mention_ord) WHERE NOT coalesce(abs(n.value - w.target_irr) <= 1.0, false) AND NOT coalesce(abs(n.value - w.net_irr) <= 1.0, false)""")
def flag_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the flags say and cite; the documents state no figure twice, so no mention repeats another."""
    p = pages(spark, sf_dir)
    nothing = fusion.disagreements(extract.metric_candidates(p).withColumn("extractor_ord", F.lit(0)))
    flags = rules.run_rules(_docs(spark, sf_dir), extract.irr_mentions(p), nothing)
    return flags.select("fund", "rule_ord", "flag_ord", "docs", "detail", "evidence")


# Spark writes 1.05E9 where DuckDB writes 1050000000.0.
_DIGITS = "rtrim(substring(replace(value::varchar, '.', ''), 2), '0')"
_NUMBER = f"CASE WHEN field = 'aum' THEN left(value::varchar, 1) || '.' || CASE WHEN {_DIGITS} = '' THEN '0' ELSE {_DIGITS} END || 'E9' ELSE value::varchar END"


@query(f"""{_C}, v AS (SELECT doc_id, field, string_agg(extractor || '=' || {_NUMBER}, ', ' ORDER BY o) FILTER (WHERE value IS NOT NULL) AS evidence FROM c GROUP BY doc_id, field)
SELECT m.fund, m.doc_name AS docs, 'Extractors disagree on ' || m.field || ': ' || evidence || ' (agreement=' || printf('%.2f', a.agreement) || ')' AS detail, evidence,
  'Manually confirm the correct ' || m.field || ' value from the source document ' || m.doc_name || '.' AS question_to_ask FROM a JOIN m USING (doc_id, field) JOIN v USING (doc_id, field) WHERE distinct_values > 1 AND a.agreement < 0.85""")
def disagreement_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.extractor_disagreement(_docs(spark, sf_dir), fusion.disagreements(_candidates(spark, sf_dir))).select("fund", "docs", "detail", "evidence", "question_to_ask")


@query(f"""{_M}, {_CITED}, d AS (SELECT doc_id, regexp_extract(text, '(As-of|Effective) Date: ([0-9-]+)', 2) AS d FROM p WHERE page_num = 1),
q AS (SELECT doc_id, array_to_string(list(n ORDER BY o, s) FILTER (WHERE n IS NOT NULL), ', ') AS missing FROM (SELECT doc_id, CASE WHEN value IS NULL THEN field || '.value' END AS n, list_position({list(METRICS)!r}, field) AS o, 0 AS s FROM m UNION ALL SELECT doc_id, CASE WHEN hurdle IS NULL AND field = 'carry' THEN 'carry.hurdle' END, 6, 1 FROM m) GROUP BY doc_id)
SELECT g.doc_name, nullif(d, '') AS doc_date, coalesce(x.snippet, '') AS aum_snippet, y.page AS mgmt_fee_page, y.snippet AS mgmt_fee_snippet, coalesce(q.missing, '') AS missing_fields, '' AS notes
FROM g JOIN d USING (doc_id) JOIN q USING (doc_id) JOIN sn y ON y.doc_id = g.doc_id AND y.field = 'mgmt_fee' LEFT JOIN sn x ON x.doc_id = g.doc_id AND x.field = 'aum'""")
def facts_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.facts_table(_analysis(spark, sf_dir).docs).select("doc_name", "doc_date", "aum_snippet", "mgmt_fee_page", "mgmt_fee_snippet", "missing_fields", "notes")


#: A document an order, with a heading, bold words, a canonical heading and a footnote; SQL that both engines run.
_PDF = """SELECT DISTINCT l_orderkey AS doc_id, CAST(floor((l_linenumber + 1) / 2) AS INT) AS page_num, l_linenumber AS line_no,
CASE l_linenumber % 4 WHEN 1 THEN concat('Part ', CAST(l_linenumber AS STRING)) WHEN 2 THEN concat('said on line ', CAST(l_linenumber AS STRING)) WHEN 3 THEN 'Risk factors, in short.' ELSE '(2) A note.' END AS text,
CAST(CASE l_linenumber % 4 WHEN 1 THEN 14 WHEN 0 THEN 8 ELSE 10 END AS DOUBLE) AS size, l_linenumber % 4 = 2 AND l_orderkey % 2 = 0 AS bold, CAST(CASE l_linenumber % 4 WHEN 0 THEN 9 ELSE 3 END AS DOUBLE) / 10 AS y_frac FROM lineitem"""
_PDF_KINDS = f"""l AS (SELECT *, median(size) OVER (PARTITION BY doc_id) AS body, {_CANON} AS canon FROM ({_PDF})),
k AS (SELECT *, CASE WHEN y_frac > 0.82::double AND size < body * 0.9::double AND regexp_matches(text, {_quoted(P.FOOTNOTE)}) THEN 'footnote' WHEN canon IS NOT NULL OR ({_WORDS} <= 12 AND (size >= body * 1.15::double OR (bold AND NOT regexp_matches(text, '[.,;]$')))) THEN 'heading' ELSE 'text' END AS kind FROM l)"""
_PDF_SECTIONS = f"""{_PDF_KINDS}, o AS (SELECT *, (sum((kind = 'heading')::int) OVER (PARTITION BY doc_id ORDER BY page_num, line_no))::int AS section_ord FROM k),
z AS (SELECT doc_id, min(page_num) AS p0, max(page_num) AS p1 FROM k GROUP BY doc_id),
e AS (SELECT doc_id, section_ord, max(text) FILTER (WHERE kind = 'heading') AS title, max(canon) FILTER (WHERE kind = 'heading') AS canon, min(page_num) AS first, trim(coalesce(string_agg(text, ' ' ORDER BY page_num, line_no) FILTER (WHERE kind = 'text'), '')) AS text FROM o GROUP BY doc_id, section_ord),
s AS (SELECT u.doc_id, u.section_ord, coalesce(e.title, 'Front Matter') AS title, e.canon AS canonical_type, CASE WHEN u.section_ord = 0 THEN z.p0 ELSE e.first END AS page_start, coalesce(e.text, '') AS text, z.p1
  FROM (SELECT DISTINCT doc_id, 0 AS section_ord FROM k UNION SELECT doc_id, section_ord FROM e) u JOIN z USING (doc_id) LEFT JOIN e USING (doc_id, section_ord)),
t AS (SELECT doc_id, section_ord, title, canonical_type, page_start, coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY section_ord), p1) AS page_end, text FROM s)"""


def _pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PDF.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))


@query("""SELECT doc_id, page_num, (row_number() OVER (PARTITION BY doc_id ORDER BY n % 2, n))::int - 1 AS line_no, text, size, bold, y_frac FROM (
  SELECT DISTINCT l_orderkey AS doc_id, 1 AS page_num, l_linenumber AS n, 'Line ' || l_linenumber::varchar || CASE WHEN l_linenumber % 3 = 0 THEN ' of ' || l_orderkey::varchar ELSE '' END AS text,
    CASE WHEN l_linenumber % 3 = 0 THEN 14.0 ELSE 10.0 END::double AS size, l_linenumber % 2 = 0 AND l_linenumber % 3 = 0 AS bold, l_linenumber * 40.0::double / CASE WHEN l_orderkey % 4 = 0 THEN 1.0 ELSE 800.0 END::double AS y_frac
  FROM lineitem WHERE l_linenumber % 5 <> 0)""")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order, with a block for odd and one for even lines, blank lines, images without lines and pages without height."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    spans = """array(named_struct('text', CASE WHEN n % 5 = 0 THEN '  ' ELSE '  Line ' END, 'size', 10.0D, 'flags', 4), named_struct('text', CASE WHEN n % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat(CAST(n AS STRING), ' ') END, 'size', 9.0D, 'flags', CAST(NULL AS INT)),
      named_struct('text', CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN concat('of ', CAST(k AS STRING), '\t') ELSE '' END, 'size', CASE WHEN n % 3 = 0 THEN 14.0D ELSE 8.0D END, 'flags', CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 20 ELSE 1 END))"""
    line = F.expr(f"named_struct('y0', n * 40.0D, 'spans', {spans})").alias("line")
    lines = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).select("k", "n", line)
    held = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("n") % 2 == odd, F.struct("n", "line")))), lambda x: x["line"])
    pages_ = lines.groupBy("k").agg(held(0).alias("even"), held(1).alias("odd"))
    blocks = F.array(F.struct(F.col("even").alias("lines")), F.struct(F.lit(None).cast(pages_.schema["even"].dataType).alias("lines")), F.struct(F.col("odd").alias("lines")))
    return layout.block_lines(pages_.select(F.col("k").alias("doc_id"), F.lit(1).alias("page_num"), F.when(F.col("k") % 4 == 0, 0.0).otherwise(800.0).alias("height"), blocks.alias("blocks")))


@query(f"WITH {_PDF_SECTIONS} SELECT * FROM t")
def pdf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sections_from_lines(_pdf_lines(spark, sf_dir))


@query(f"WITH {_PDF_KINDS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, line_no))::int - 1 AS fn_ord, '2' AS marker, text, page_num FROM k WHERE kind = 'footnote'")
def pdf_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pdf_footnotes(_pdf_lines(spark, sf_dir))


@query(f"WITH {_PDF_SECTIONS} SELECT n.doc_id, n.page_num, min(section_ord) AS section_ord, arg_min(title, section_ord) AS title FROM (SELECT DISTINCT doc_id, page_num FROM k) n JOIN t ON t.doc_id = n.doc_id AND n.page_num BETWEEN page_start AND page_end GROUP BY n.doc_id, n.page_num")
def section_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _pdf_lines(spark, sf_dir)
    return layout.section_for_page(layout.sections_from_lines(lines), lines.select("doc_id", "page_num").distinct())


@query("""SELECT doc_id, source_ord, (row_number() OVER (PARTITION BY doc_id ORDER BY source_ord, table_id))::int - 1 AS table_ord, table_id FROM (
  SELECT s_suppkey::bigint AS doc_id, 0 AS source_ord, 't_' || s_suppkey::bigint AS table_id FROM supplier UNION ALL SELECT s_suppkey::bigint, 1, 'u_' || s_suppkey::bigint FROM supplier WHERE s_suppkey % 2 = 0)""")
def table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _doc_tables(spark, sf_dir)
    two = one.where("doc_id % 2 = 0").withColumn("table_id", F.concat(F.lit("u_"), F.col("doc_id").cast("string")))
    return tables.all_tables(one, two).select("doc_id", "source_ord", "table_ord", "table_id")


@query(f"""{_M}, t AS ({_TABLES}), x AS (SELECT m.*, t.value AS other, m.value IS NULL AND t.value IS NOT NULL AS filled FROM m LEFT JOIN t ON t.doc_id = m.doc_id AND m.field = CASE t.metric WHEN 'irr' THEN 'net_irr' ELSE t.metric END)
SELECT doc_id, field, 'RegexExtractor' AS extractor, value, confidence, NOT filled AS winner FROM x UNION ALL SELECT doc_id, field, 'TableParser', other, 0.85::double, true FROM x WHERE filled""")
def table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = extract.metric_candidates(pages(spark, sf_dir)).withColumn("extractor_ord", F.lit(0))
    filled = tables.with_fallback(fusion.fused(own), tables.table_metrics(_doc_tables(spark, sf_dir)))
    return tables.with_table_candidates(fusion.scored_candidates(own), filled).select("doc_id", "field", "extractor", "value", "confidence", "winner")


_WHEN = "CASE o_orderkey % 4 WHEN 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10) WHEN 1 THEN concat(substring(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z') WHEN 2 THEN concat(CAST(2010 + o_orderkey % 15 AS STRING), substring(CAST(o_orderdate AS STRING), 5, 6), 'T12:00:00+02:00') ELSE '2999-03-01T00:00:00+01:00' END"


@query(f"""SELECT o_orderkey, CASE WHEN z IS NULL THEN 0.5 ELSE greatest(0.30::double, least(1.0::double, 1.0::double - date_diff('day', (z AT TIME ZONE 'UTC')::date, (now() AT TIME ZONE 'UTC')::date) / 3650.0::double)) END::double AS weight
FROM (SELECT o_orderkey, CASE WHEN regexp_matches(d, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') AND contains(d, 'T') THEN TRY_CAST(d AS TIMESTAMPTZ) END AS z FROM (SELECT o_orderkey, {_WHEN} AS d FROM orders))""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain days have no age; moments of the nineties are as old as counts, later ones by their days, those to come not old at all."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", fusion.recency(F.expr(_WHEN)).alias("weight"))


_MARKED_UP = lambda c: f"regexp_replace(regexp_replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\*\\*(.+?)\\*\\*', '<b>\\1</b>', 'g'), '\\*([^*]+)\\*', '<i>\\1</i>', 'g')"


@query(f"""SELECT c_custkey, CASE WHEN m IS NULL THEN 'N/A' WHEN m >= 1e9 THEN printf('$%.2fB', m / 1e9) WHEN m >= 1e6 THEN printf('$%.2fM', m / 1e6) ELSE '$' || format('{{:,}}', m::bigint) END AS money,
  CASE WHEN v IS NULL OR isnan(v) THEN 'N/A' ELSE v::varchar END AS cell, {_MARKED_UP("t")} AS markup FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN (c_custkey % 9 + 1.5) * 1e9 WHEN 2 THEN (c_custkey % 9 + 1.25) * 1e6 WHEN 3 THEN (c_custkey % 9 + 1) * 1000.0 + 500 END::double AS m,
    CASE c_custkey % 3 WHEN 0 THEN 'nan' WHEN 1 THEN '1.5' END::double AS v, '**' || c_name || '** & *is* <x>' AS t FROM customer)""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    digit = (k % 9 + 1).cast("double")
    amount = F.when(k % 4 == 1, (digit + 0.5) * 1e9).when(k % 4 == 2, (digit + 0.25) * 1e6).when(k % 4 == 3, digit * 1000 + 500)
    value = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, F.lit(1.5))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.money(amount).alias("money"), T.cell(value).alias("cell"), T.inline_markup(F.concat(F.lit("**"), "c_name", F.lit("** & *is* <x>"))).alias("markup"))


_MEMO = "concat('```markdown', chr(10), '# Memo ', CAST(CAST(s_suppkey AS BIGINT) AS STRING), chr(10), chr(10), chr(10), chr(10), '### **Terms**', chr(10), '---', chr(10), '- fee of *two* & more', chr(10), '1. first', chr(10), '-- so **said** ', CAST(CAST(s_suppkey AS BIGINT) AS STRING), chr(10), '```')"


def _memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS doc_id", f"{_MEMO} AS memo")


_LINE_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, {_quoted(p)}) THEN {_quoted(n)}" for n, p in P.MEMO_LINES) + " ELSE 'body' END"
_LINE_TEXT = "CASE " + " ".join(f"WHEN regexp_matches(line, {_quoted(p)}) THEN regexp_extract(line, {_quoted(p)}, 1)" for _, p in P.MEMO_LINES) + " ELSE line END"


@query(f"""WITH u AS (SELECT s_suppkey::bigint AS doc_id, string_split(regexp_replace(regexp_replace(trim({_MEMO}), '^```[a-z]*\\s*\\n?', ''), '\\n?```\\s*$', ''), chr(10)) AS ls FROM supplier),
l AS (SELECT doc_id, generate_subscripts(ls, 1)::int - 1 AS line_ord, trim(unnest(ls)) AS line FROM u)
SELECT doc_id, line_ord, {_LINE_KIND} AS kind, CASE WHEN {_LINE_KIND} = 'heading' THEN length(regexp_extract(line, '^#+'))::int END AS level, {_MARKED_UP(f"trim({_LINE_TEXT})")} AS text FROM l""")
def memo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.memo_lines(_memos(spark, sf_dir))


_UNMARKED = _MEMO
for _p, _to in P.MEMO_MARKS:
    _UNMARKED = f"regexp_replace({_UNMARKED}, {_quoted(_p)}, {_quoted(_to)}, 'g')"


@query(f"SELECT s_suppkey::bigint AS doc_id, regexp_replace({_UNMARKED}, '^\\s+|\\s+$', '', 'g') AS memo FROM supplier")
def memo_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memos(spark, sf_dir).select("doc_id", T.plain_memo(F.col("memo")).alias("memo"))


# ---- answers of language models, made from order lines: a document an order, a chunk a line

_ANSWER = """concat('{"mgmt_fee": {"value": ', CASE WHEN l_linenumber % 3 = 0 THEN '0.02' WHEN l_linenumber % 3 = 1 THEN '2.5' ELSE 'null' END, ', "confidence": 0.', CAST(l_linenumber AS STRING), '}, "notes": ["chunk", {"text": "line"}], "doc_date": {"value": "2025-01-0', CAST(l_linenumber AS STRING), '"}}')"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return responses.parsed(lines.selectExpr("l_orderkey AS doc_id", "l_linenumber AS chunk", f"{_ANSWER} AS response"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS chunk, CASE l_linenumber % 3 WHEN 0 THEN 0.02::double * 100 WHEN 1 THEN 2.5::double END AS value, l_linenumber % 3 = 0 AS repaired FROM lineitem")
def percent_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = responses.response_metrics(_responses(spark, sf_dir), ("mgmt_fee",))
    return m.select("doc_id", "chunk", "value", (F.size("notes") > 0).alias("repaired"))


@query("SELECT l_orderkey AS doc_id, arg_max(CASE l_linenumber % 3 WHEN 0 THEN 0.02::double * 100 ELSE 2.5::double END, l_linenumber) FILTER (WHERE l_linenumber % 3 < 2) AS value, max(l_linenumber / 10.0::double) FILTER (WHERE l_linenumber % 3 < 2) AS confidence FROM lineitem GROUP BY l_orderkey")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = responses.merged_chunks(responses.response_metrics(_responses(spark, sf_dir), ("mgmt_fee",)))
    return m.select("doc_id", "value", "confidence")


@query(f"""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk, ({_ANSWER})::JSON AS j FROM lineitem),
n AS (SELECT doc_id, chunk, unnest(json_extract(j, '$.notes[*]')) AS x, generate_subscripts(json_extract(j, '$.notes[*]'), 1) AS o FROM a),
t AS (SELECT doc_id, chunk * 100 + o AS o, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.text' ELSE x->>'$' END AS note FROM n),
d AS (SELECT doc_id, note, min(o) AS o FROM t GROUP BY doc_id, note)
SELECT doc_id, string_agg(note, '|' ORDER BY o) || '|Document processed in ' || (SELECT count(DISTINCT chunk) FROM a WHERE a.doc_id = d.doc_id)::varchar || ' chunks due to length (hosted).' AS notes FROM d GROUP BY doc_id""")
def merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _responses(spark, sf_dir)
    return responses.merged_notes(responses.response_notes(r), r, "hosted").select("doc_id", F.array_join("notes", "|").alias("notes"))

@query(f"SELECT l_orderkey AS doc_id, l_linenumber AS chunk, ({_ANSWER})::JSON->>'$.doc_date.value' AS doc_date FROM lineitem")
def answer_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.response_dates(_responses(spark, sf_dir))


_CHARTS = """CASE WHEN c_custkey % 4 = 0 THEN '{"charts": "none"}' ELSE concat('{"charts": ["no chart", {"chart_type": "bar", "title": "Sales ', CAST(c_custkey AS STRING), '", "series": [{"label": "a", "value": 1.5}, 3, {"value": null}, {"label": 7, "value": 2}]}]}') END"""


@query(f"""WITH r AS (SELECT c_custkey AS doc_id, json_extract(({_CHARTS})::JSON, '$.charts[*]') AS cs FROM customer),
c AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1)::int - 1 AS chart_ord FROM r),
k AS (SELECT doc_id, chart_ord, c->>'$.chart_type' AS chart_type, c->>'$.title' AS title, list_filter(json_extract(c, '$.series[*]'), lambda x: json_type(x) = 'OBJECT') AS points FROM c WHERE json_type(c) = 'OBJECT')
SELECT doc_id, 2 AS page, chart_ord, chart_type, title, array_to_string(list_transform(points, lambda x: coalesce(x->>'$.label', '') || ':' || coalesce((x->>'$.value')::double::varchar, 'null')), ',') AS series, 0.6::double AS confidence, title AS snippet FROM k""")
def chart_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on charts with items that are none; every fourth has no list of them."""
    c = responses.charts(responses.parsed(_table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "2 AS page", f"{_CHARTS} AS response")))
    points = F.transform("series", lambda x: F.concat(x["label"], F.lit(":"), F.coalesce(x["value"].cast("string"), F.lit("null"))))
    return c.select("doc_id", "page", "chart_ord", "chart_type", "title", F.array_join(points, ",").alias("series"), "confidence", "snippet")
