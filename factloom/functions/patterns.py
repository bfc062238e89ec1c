"""The patterns whose matches define the results, in the order in which they are tried."""

from __future__ import annotations

GAP = r"[\s\S]{0,80}?"

#: field, patterns in order; group 1 is the value.
FIELD_PATTERNS = (
    ("aum", (rf"AUM\){GAP}\$([0-9]+\.[0-9]+)B", rf"Assets Under Management{GAP}\$([0-9]+\.[0-9]+)B")),
    ("net_irr", (rf"Net IRR{GAP}:\s*([0-9]+\.[0-9]+)%", rf"Net IRR{GAP}([0-9]+\.[0-9]+)%")),
    ("tvpi", (rf"TVPI{GAP}:\s*([0-9]+\.[0-9]+)x", rf"TVPI{GAP}([0-9]+\.[0-9]+)x")),
    ("target_irr", (rf"Target IRR{GAP}:\s*([0-9]+)%", rf"Target IRR{GAP}([0-9]+)%")),
    ("mgmt_fee", (rf"Management Fee{GAP}:\s*([0-9]+\.[0-9]+)%", rf"Management Fee{GAP}([0-9]+\.[0-9]+)%")),
    ("carry", (r"Carry:\s*([0-9]+)%", rf"carried interest{GAP}([0-9]+)%")),
    ("hurdle", (r"over an\s*([0-9]+)%\s*preferred", rf"hurdle{GAP}([0-9]+)%")),
)
#: A pattern that takes decimals of a target IRR; the default one reads 5 from "18.5%".
TARGET_DECIMAL = (rf"Target IRR{GAP}:\s*([0-9]+(?:\.[0-9]+)?)%", rf"Target IRR{GAP}([0-9]+(?:\.[0-9]+)?)%")
DATE_PATTERNS = (r"As-of Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", r"Effective Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})")

#: pattern, group of the basis, group of the value.
MENTION_PATTERNS = (
    (r"(?:(gross|net)\s+)?(?:target\s+)?irr\b[^%\n]{0,25}?([0-9]+(?:\.[0-9]+)?)\s*%", 1, 2),
    (r"([0-9]+(?:\.[0-9]+)?)\s*%\s*(gross|net)?\s*irr\b", 2, 1),
)

NET_PATTERNS = (r"\bnet\s+of\s+(all\s+)?fees\b", r"\bnet\s+of\s+carried\s+interest\b", r"\bafter[\s-]fee(s)?\b", r"\bnet\s+irr\b", r"\bnet\s+returns?\b")
GROSS_PATTERNS = (r"\bgross\s+of\s+fees\b", r"\bgross\s+irr\b", r"\bbefore[\s-]fee(s)?\b", r"\bpre[\s-]fee(s)?\b", r"\bgross\s+returns?\b")
#: Section types where a convention is looked for first, in this order.
BASIS_SECTIONS = ("definitions", "terms", "performance_summary", "fees_and_expenses")

CANONICAL_PATTERNS = (
    ("performance_summary", r"performance\s+(summary|highlights|overview)"),
    ("terms", r"^\s*(key\s+|fund\s+)?terms\b|term\s+sheet"),
    ("risk_factors", r"risk\s+(factors|considerations)"),
    ("definitions", r"^\s*definitions?\b"),
    ("fees_and_expenses", r"fees?\s*(and|&)?\s*expenses|^\s*fees\b"),
)
FOOTNOTE = r"^\s*(\(?\d{1,2}\)?[\.\)]?|\*{1,3}|[†‡])\s+\S"

#: label, value and factor of a table row's metrics.
TABLE_PATTERNS = (
    ("aum", r"\baum\b|assets under management", r"\$([0-9\.]+)\s*b", 1e9),
    ("irr", r"\birr\b", r"([0-9]+\.[0-9]+)\s*%", 1.0),
    ("tvpi", r"\btvpi\b", r"([0-9]+\.[0-9]+)\s*x", 1.0),
)

#: Applied one after the other; the last ignores case.
REDACTIONS = (
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[REDACTED-EMAIL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED-PHONE]"),
    (r"(?i)\b(?:account|acct)\s*(?:no\.?|number|#)?\s*[:#]?\s*\d{6,}\b", "[REDACTED-ACCOUNT]"),
)

#: What is replaced, one after the other, to make a memo plain text.
MEMO_MARKS = ((r"```(?:markdown)?", ""), (r"(?m)^#+\s*", ""), (r"(?m)^---+$", ""), (r"\*\*", ""), (r"\n{3,}", "\n\n"))
#: Kind of a stripped memo line and its pattern, in the order in which they are tried; the last group is its text.
MEMO_LINES = (("blank", r"^()$"), ("rule", r"^-{3,}()$"), ("heading", r"^#{1,6}\s+(.*)$"), ("bullet", r"^[-*]\s+(.*)$"), ("numbered", r"^(\d+\.\s+.*)$"))
