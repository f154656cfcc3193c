"""Text normalisation, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def replace_all(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def normalise_message(message: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """The template of a validator's message: the steps, (pattern, replacement) in order, take out what varies between two
    reports of one finding."""
    return F.trim(replace_all(message, steps))


def message_family(template: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """What is left when a family's further differences are taken out as well."""
    return F.lower(F.trim(replace_all(template, steps)))


def message_class_id(validator: Column, template: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", validator, template), 256), 1, 12)


def normalise_spelling(value: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z]+://", "")
    return F.regexp_replace(F.replace(v, F.lit(":"), F.lit("/")), r"\.git$", "")


def clip(value: Column, limit: int) -> Column:
    """Cut so that the cut shows."""
    return F.when(F.length(value) > limit, F.concat(F.rtrim(F.substring(value, 1, limit)), F.lit(" ..."))).otherwise(value)


def strip_markup(html: Column) -> Column:
    v = F.regexp_replace(html, r"<[^>]*>", " ")
    v = F.translate(v, "‐‑‒–—", "-----")
    v = F.regexp_replace(v, r"[ \t\r\n]+", " ")
    return F.trim(F.regexp_replace(v, r" ([:;,.])", "$1"))


def mask(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, longest first."""
    for phrase, to in sorted(phrases, key=lambda p: (-len(p[0]), p[0])):
        text = F.replace(text, F.lit(phrase), F.lit(to))
    return text


def leaks(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """The phrases that a masked text still holds, sorted."""
    return F.filter(F.array(*[F.lit(p) for p in sorted({p for p, _ in phrases})]), lambda p: F.contains(text, p))


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
