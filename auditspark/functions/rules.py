"""Ordered rule tables and other classifications, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (category, label, pattern); the first pattern that is found decides.
Rule = tuple[str, str, str]


def decision(category: Column, label: Column) -> Column:
    return F.struct(category.alias("category"), label.alias("rule"))


def first_match(value: Column, rules: Sequence[Rule], otherwise: Column) -> Column:
    """struct(category, rule) of the first rule whose pattern is found in value, else `otherwise`."""
    out = None
    for category, label, pattern in rules:
        hit, what = value.rlike(pattern), decision(F.lit(category), F.lit(label))
        out = F.when(hit, what) if out is None else out.when(hit, what)
    return otherwise if out is None else out.otherwise(otherwise)


def classify(value: Column, rules: Sequence[Rule], shown: int = 60) -> Column:
    """Null and blank are told apart, then the rules apply to the trimmed lower-case value; what none covers is
    unclassified and shows its beginning."""
    bare = F.lower(F.trim(value))
    rest = decision(F.lit("unclassified"), F.substring(F.trim(value), 1, shown))
    found = first_match(bare, rules, rest)
    return F.when(value.isNull(), decision(F.lit("absent"), F.lit("null"))).when(F.trim(value) == "", decision(F.lit("absent"), F.lit("empty string"))).otherwise(found)


def classify_extended(value: Column, rules: Sequence[Rule], extra: Sequence[Rule]) -> Column:
    """struct(category, rule, from_extra): further rules see only what the first table left unclassified."""
    base = classify(value, rules)
    more = first_match(F.lower(F.trim(value)), extra, base)
    use = base["category"] == "unclassified"
    picked = F.when(use, more).otherwise(base)
    return F.struct(picked["category"].alias("category"), picked["rule"].alias("rule"), (use & (picked["category"] != "unclassified")).alias("from_extra"))


def on_distinct(df: DataFrame, columns: Sequence[str], verdict: Column, name: str) -> DataFrame:
    """df with a verdict on a few of its columns. Long tables repeat few values: it is worked out once for each distinct
    combination and joined back (null-safe). Where values seldom repeat, work it out on the rows instead."""
    own = df.select(*columns).distinct().withColumn(name, verdict).select(*[F.col(c).alias(f"_v_{c}") for c in columns], name)
    same = [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in columns]
    return df.join(own, same, "left").select(*df.columns, name)


def classify_distinct(df: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """df with category and rule of a column, each distinct value classified once."""
    found = on_distinct(df, [column], classify(F.col(column), rules), "_v")
    return found.select(*df.columns, F.col("_v.category").alias("category"), F.col("_v.rule").alias("rule"))


def cascade(*steps: tuple[Column, str], rules: Sequence[Rule], default: str) -> Column:
    """struct(category, carrier): the first carrier, in order, whose text a rule matches, and what it says."""
    out = None
    for text, carrier in steps:
        got = first_match(F.lower(F.coalesce(text, F.lit(""))), rules, decision(F.lit(None).cast("string"), F.lit(None).cast("string")))["category"]
        what = F.struct(got.alias("category"), F.lit(carrier).alias("carrier"))
        out = F.when(got.isNotNull(), what) if out is None else out.when(got.isNotNull(), what)
    return out.otherwise(F.struct(F.lit(default).alias("category"), F.lit("none").alias("carrier")))


def matches(value: Column, rules: Sequence[Rule]) -> Column:
    """Array of the labels of all rules whose pattern is found; a complete, unambiguous table gives one each."""
    return F.array_compact(F.array(*[F.when(value.rlike(p), F.lit(label)) for _, label, p in rules]))


def expectation(expected: Column, seen: Column, unknown: str = "unknown") -> Column:
    """agree / disagree / no expectation / silent, of what a lookup expects and what was seen."""
    return F.when(expected.isNull(), "no expectation").when(seen.isNull() | (seen == unknown), "silent").when(expected == seen, "agree").otherwise("disagree")


def is_sentinel(value: Column, sentinels: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*sentinels), F.lit(False))


def three_state(value: Column) -> Column:
    return F.when(value.isNull(), "absent").when(F.trim(value) == "", "empty").otherwise("non_empty")


def sequence_state(items: Column) -> Column:
    return F.when(items.isNull(), "absent").when(F.size(items) == 0, "present_zero_items").otherwise("non_empty")


def json_state(document: Column, path: str) -> Column:
    """The three states of a member of a JSON text: a missing member, a null and an empty string differ only in a
    variant."""
    parsed = F.try_parse_json(document)
    text = F.try_variant_get(parsed, path, "string")
    known = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return F.when(known.isNull(), "absent").when((known == "VOID") | (F.trim(text) == ""), "empty").otherwise("non_empty")


def macro_state(items: Column, mandatory: Sequence[str]) -> Column:
    """struct(state, missing): of an array of items, absent / present_zero_items / present_incomplete /
    present_complete, with the mandatory members that some item lacks, sorted."""
    lacking = F.transform(items, lambda i: F.array_compact(F.array(*[F.when(F.coalesce(F.trim(i[m].cast("string")), F.lit("")) == "", F.lit(m)) for m in mandatory])))
    missing = F.array_sort(F.array_distinct(F.flatten(lacking)))
    state = F.when(items.isNull(), "absent").when(F.size(items) == 0, "present_zero_items").when(F.size(missing) > 0, "present_incomplete").otherwise("present_complete")
    return F.struct(state.alias("state"), F.coalesce(missing, F.array().cast("array<string>")).alias("missing"))


def tokens(value: Column, pattern: str = "[^A-Za-z0-9.]+") -> Column:
    return F.filter(F.split(value, pattern), lambda t: t != "")


def distinctive_tokens(value: Column, stop: Sequence[str], longer_than: int = 2) -> Column:
    """Lower-case letters-and-digits tokens, long enough and not in the stop list."""
    some = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda t: F.length(t) > longer_than)
    return F.array_except(some, F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def informative(values: Column, generic: Sequence[str], sentinels: Sequence[str]) -> Column:
    """The first, in sorted order, that has a telling token: of three characters or more, neither generic nor a
    number nor part of a web address; sentinels don't count."""

    def telling(t: Column) -> Column:
        return (F.length(t) >= 3) & ~F.lower(t).isin(*generic) & ~t.rlike("^[0-9]+$") & ~F.lower(t).rlike("http|github")

    good = F.filter(F.array_sort(F.array_distinct(F.array_compact(values))), lambda v: ~is_sentinel(v, sentinels) & F.exists(F.split(v, "[^A-Za-z0-9.]+"), telling))
    return F.get(good, F.lit(0))


def version_of(values: Column, pattern: str, excluded: Sequence[str], sentinels: Sequence[str]) -> Column:
    """struct(has_version, token, source): the first value with a version-like token that is no sentinel and
    matches none of the excluded shapes."""
    shaped = lambda v: reduce(lambda a, b: a | b, [v.rlike(p) for p in excluded], F.lit(False))
    good = F.filter(F.array_compact(values), lambda v: ~is_sentinel(v, sentinels) & ~shaped(v) & v.rlike(pattern))
    source = F.get(good, F.lit(0))
    return F.struct(source.isNotNull().alias("has_version"), F.regexp_extract(source, f"({pattern})", 1).alias("token"), source.alias("source"))


def names_producer(values: Column, rules: Sequence[Rule], category: str) -> Column:
    """The first value, in sorted order, that the rules put into the category."""
    return F.get(F.filter(F.array_sort(F.array_distinct(F.array_compact(values))), lambda v: classify(v, rules)["category"] == category), F.lit(0))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(text, n))
