"""Scalar text functions as built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CANONICAL_PATTERNS, FOOTNOTE, GROSS_PATTERNS, MEMO_MARKS, NET_PATTERNS, REDACTIONS

#: Line breaks that end a line: LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def filled(form: str, **parts: Column) -> Column:
    """A wording with columns in its places, which are named in braces; null if one of them is."""
    out, rest = [], form
    for name, col in sorted(parts.items(), key=lambda x: form.index("{" + x[0] + "}")):
        before, rest = rest.split("{" + name + "}")
        out += [F.lit(before), col.cast("string")]
    return F.concat(*out, F.lit(rest))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalised(c: Column) -> Column:
    return F.lower(collapsed(F.coalesce(c, F.lit(""))))


def word_count(c: Column) -> Column:
    return F.when(collapsed(c) == "", 0).otherwise(F.size(F.split(collapsed(c), " ")))


def folded(c: Column) -> Column:
    """Lower case, with the four other characters that match an ASCII letter when case is ignored as that letter."""
    others = "\u017f\u0131\u0130\u212a"
    return F.lower(F.when(c.rlike(f"[{others}]"), F.translate(c, others, "siik")).otherwise(c))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match ignoring case; null without one."""
    return F.nullif(F.regexp_extract(c, f"(?iuU){pattern}", group), F.lit(""))


def snippet(c: Column, pattern: str, around: int, words: int | None = None) -> Column:
    """The first match and so many characters on either side, blanks collapsed, of so many words at most."""
    found = F.lit(f"(?iuU){pattern}")
    at, size = F.regexp_instr(c, found), F.length(F.regexp_substr(c, found))
    low = F.greatest(at - around, F.lit(1))
    out = collapsed(F.substring(c, low, at + size + (around - 1) - low + 1))
    return F.array_join(F.slice(F.split(out, " "), 1, words), " ") if words else out


def basis_of(c: Column) -> Column:
    """struct(basis, snippet) by the first pattern that matches, net ones first; null without one."""
    tried = [("net", p) for p in NET_PATTERNS] + [("gross", p) for p in GROSS_PATTERNS]
    hits = [F.when(c.rlike(f"(?iuU){p}"), F.struct(F.lit(b).alias("basis"), F.regexp_substr(c, F.lit(f"(?iuU){p}")).alias("snippet"))) for b, p in tried]
    return F.coalesce(*hits)


def canonical(c: Column) -> Column:
    out = None
    for name, p in CANONICAL_PATTERNS:
        hit = c.rlike(f"(?iuU){p}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_footnote(c: Column) -> Column:
    return c.rlike(f"(?U){FOOTNOTE}")


def footnote_marker(c: Column) -> Column:
    return F.btrim(F.regexp_extract(c, f"(?U){FOOTNOTE}", 1), F.lit("().*"))


def redacted(c: Column) -> Column:
    for p, to in REDACTIONS:
        c = F.regexp_replace(c, f"(?U){p}", to.replace("$", r"\$"))
    return c


def json_block(c: Column) -> Column:
    """From the first { to the last } once code fences are gone; null without both."""
    bare = F.trim(F.regexp_replace(c, "(?i)```json|```", ""))
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def repaired_json(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("'"), F.lit('"')), r",\s*([}\]])", "$1")


def parsed_json(c: Column) -> Column:
    """VARIANT of the text's JSON block: as it is, else repaired, else null."""
    raw = json_block(c)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(repaired_json(raw)))


def money(c: Column) -> Column:
    size = F.abs(c)
    return (
        F.when(c.isNull(), "N/A")
        .when(size >= 1e9, F.concat(F.lit("$"), F.format_string("%.2f", c / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(F.lit("$"), F.format_string("%.2f", c / 1e6), F.lit("M")))
        .otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))
    )


def cell(c: Column) -> Column:
    """A value's text, N/A for null and NaN."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("NaN")), F.lit("N/A"))


def tier(c: Column) -> Column:
    return F.when(c.isNull(), "N/A").when(c >= 0.75, "High").when(c >= 0.5, "Medium").otherwise("Low")


def inline_markup(c: Column) -> Column:
    """Escaped text with **bold** and *italic* as tags."""
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(F.regexp_replace(c, r"\*\*(.+?)\*\*", "<b>$1</b>"), r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<i>$1</i>")


def unfenced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```[a-z]*\s*\n?", ""), r"\n?```\s*$", ""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_memo(c: Column) -> Column:
    """A memo without fences, heading marks, rules and bold marks, with no more than one blank line in a row."""
    for p, to in MEMO_MARKS:
        c = F.regexp_replace(c, f"(?dU){p}", to)
    return stripped(c)


def percent_repaired(c: Column) -> Column:
    """A fraction between 0 and 1 that stands for a percent number, as that number."""
    return F.when((c > 0) & (c < 1), c * 100).otherwise(c)
