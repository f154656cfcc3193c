"""Rule tables and word lists for the given tables, and their SQL for the oracles."""

from __future__ import annotations

from collections.abc import Sequence

PRODUCT_RULES = [
    ("sentinel", "not applicable", "^n/a$"),
    ("named", "bolts", "bolt"),
    ("named", "rings", "^(small|large) ring"),
    ("converter", "coloured goods", "^(red|blue) "),
    ("converter", "gears", "gear$"),
    ("library", "brand with version", "brand#[0-9]+ v[0-9]"),
    ("named", "economy line", "^economy "),
]
EXTRA_RULES = [("named", "anvils", "anvil"), ("converter", "old goods", "^old ")]
WRITER_RULES = [("bolt works", "bolts", "bolt"), ("ring makers", "rings", r"\bring\b"), ("brand one", "brand 1", "brand#1 "), ("old forge", "old", "old (anvil|plate)")]
SENTINELS = ["n/a", "na", "none", "unknown", "null", "-", ""]
GENERIC = ["small", "large", "old", "red", "blue", "hot", "brand"]
CONVENTION_STOP = ["small", "large", "nation", "the", "old"]
BUCKETS = ["absent", "encoder_only", "producer_and_converter", "other"]
VERSION = r"v[0-9]+\.[0-9]+"
#: What varies between two reports of one finding, in order of replacement. What names the finding stays: elements and
#: modules in angle brackets, types, and numbers that aren't places ("VR 16" and "VR 32" are two findings).
MESSAGE_STEPS = [
    (r"\((0x)?[0-9a-fA-F]{4},(0x)?[0-9a-fA-F]{4}\)", "<tag>"),
    (r"\b[0-9]+(\.[0-9]+){3,}\b", "<uid>"),
    (r"\[[0-9]+\]", "[n]"),
    (r"(?i)\b(frame|item|index|number|segment)[ \t]*#?[ \t]*[0-9]+\b", "$1 <n>"),
    (r'"[^"]*"', "<quoted>"),
    (r"'[^']*'", "<quoted>"),
    (r"(?i)\bvalue *= *(<[^>]*>|[^ \t]+)", "Value=<v>"),
    (r"[ \t]+", " "),
]
#: Further differences that a family of messages disregards.
FAMILY_STEPS = [(r"Element=<[^>]*>", "Element=<*>"), (r"<(tag|uid|quoted|hex|n|v)>", "<*>"), (r"[0-9]+", "#"), (r" +", " ")]
#: A severity, at the start of a line or between dashes in it.
SEVERITY = r"(?:^|\s-\s)(Error|Warning)\s-\s"
#: The name of a recognised type alone on a line.
BANNER = "^[A-Z][A-Za-z0-9]{3,}$"


def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case_sql(value: str, rules: Sequence[tuple[str, str, str]], which: int, otherwise: str) -> str:
    """The rules as CASE; which: 0 for categories, 1 for labels."""
    whens = " ".join(f"WHEN regexp_matches({value}, '{r[2]}') THEN '{r[which]}'" for r in rules)
    return f"CASE {whens} ELSE {otherwise} END"
