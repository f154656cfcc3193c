"""Censuses: grouped counts, shares and listings over an index of one row per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.stats import percent
from auditspark.operators.ranges import numbered_within

#: What stands for a missing id in a grouping.
NULL_ID = "(null)"


def known_id(value: Column) -> Column:
    """Null, blank and the words that other tools write for a missing value all become one id."""
    return F.when(value.isNull() | F.lower(F.trim(value)).isin("", "nan", "none", "null"), NULL_ID).otherwise(value)


def census(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series, instances, volume, distinct collections and patients of each group. Sums are combined before they are
    shuffled; the distinct counts are taken from the cells of collection and patient, each by itself, so that rows aren't
    multiplied for the two."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("series"), F.sum("instances").alias("instances"), F.round(F.sum("mb") / 1000, 3).alias("gb"), F.round(F.avg("mb"), 3).alias("mean_mb"))
    cell = df.select(*keys, "collection", "patient").distinct()
    counts = [cell.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(name)) for c, name in (("collection", "collections"), ("patient", "patients"))]
    same = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]
    both = counts[0].alias("_c").join(counts[1].alias("_p"), same("_c", "_p")).select("_c.*", "patients")
    return sums.alias("_s").join(both.alias("_b"), same("_s", "_b")).select("_s.*", "collections", "patients")


def joined(values: Column, between: str = " | ") -> Column:
    """The sorted distinct values of a group as one text. The values are names out of a short list, so the group's
    array stays short however many rows it has."""
    return F.array_join(F.array_sort(F.collect_set(values)), between)


def share_within(df: DataFrame, count: str, parent: Sequence[str], name: str = "pct") -> DataFrame:
    """Each row's share of its parent's total, in percent."""
    return df.withColumn(name, percent(F.col(count), F.sum(count).over(Window.partitionBy(*parent))))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; end the order with a key so that ties are settled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "attribute", value: str = "value") -> DataFrame:
    """A row for each of the columns: (keys, attribute, value as string)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def population(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null, empty and populated rows of each attribute; the two kinds of missing are never added up. Equal values are
    counted before they are told apart."""
    v = F.col("value")
    per = melt(df, by, columns).groupBy(*by, "attribute", "value").agg(F.count("*").alias("_n"))
    full = v.isNotNull() & (F.trim(v) != "")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    rows = F.sum("_n")
    return per.groupBy(*by, "attribute").agg(rows.alias("rows"), n(v.isNull()).alias("nulls"), n(v.isNotNull() & (F.trim(v) == "")).alias("empties"), n(full).alias("populated"), F.count_if(full).alias("distinct_values"), percent(n(full), rows).alias("pct_populated"))


def totals(df: DataFrame) -> DataFrame:
    """One row for the whole index, from its cells of collection and analysis."""
    cell = df.groupBy("collection", "analysis").agg(F.count("*").alias("n"), F.sum("instances").alias("instances"), F.sum("mb").alias("mb"))
    sums = cell.agg(F.sum("n").alias("series"), F.sum("instances").alias("instances"), F.round(F.sum("mb"), 2).alias("mb"), F.coalesce(F.sum(F.when(F.col("analysis").isNull(), F.col("n"))), F.lit(0)).alias("unattributed"))
    counts = [cell.select(c).distinct().agg(F.count(c).alias(name)) for c, name in (("collection", "collections"), ("analysis", "analyses"))]
    return sums.join(counts[0]).join(counts[1])  # one row each


def spellings(df: DataFrame, value: str, rule: Column) -> DataFrame:
    """(rule, value, series, place, spellings): the values that a rule takes for one, most frequent first. rule: on `value`,
    worked out once for each distinct value."""
    per = df.groupBy(value).agg(F.count("*").alias("series")).withColumn("rule", rule)
    return numbered_within(per, ["rule"], [F.desc("series"), F.asc(value)]).select("rule", value, "series", "place", "of_group").withColumnRenamed("of_group", "spellings")


def both_ways(df: DataFrame, unit: str, flag: Column) -> DataFrame:
    """One flag weighed by objects and by units: units with none, with all, and between (exact counts, not rounded
    shares)."""
    per = df.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    mixed = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("objects"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("flagged"),
        F.count("*").alias("units"),
        F.count_if(F.col("k") == 0).alias("units_none"),
        F.count_if(F.col("k") == F.col("n")).alias("units_all"),
        F.count_if(mixed).alias("units_between"),
        F.coalesce(F.sum(F.when(mixed, F.col("n"))), F.lit(0)).alias("objects_between"),
    )


def grouping(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], *aggs: Column) -> DataFrame:
    """Several groupings in one pass; keys that a grouping leaves out show `(all)`."""
    columns = [F.col(k) for k in keys]
    made = df.groupingSets([[F.col(k) for k in s] for s in sets], *columns).agg(*aggs, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    return made.select(*[F.when(F.col(f"_g_{k}") == 1, "(all)").otherwise(F.col(k)).alias(k) for k in keys], *[c for c in made.columns if c not in keys and not c.startswith("_g_")])


def states(df: DataFrame, keys: Sequence[str], state: Column, values: Sequence[str]) -> DataFrame:
    """Counts of each state, a column each, zero where there is none."""
    return df.groupBy(*keys).agg(*[F.count_if(state == v).alias(v) for v in values])


def inherited(derived: DataFrame, acquired: DataFrame, group: Sequence[str], identity: Sequence[str], also: Sequence[str]) -> DataFrame:
    """Per group of derived rows: rows, those eligible (no part of the identity is blank), those whose identity occurs among
    the acquired rows (with the same `also` columns), and their percentage of the eligible (0 if there is none). Blanks
    are trimmed, and a blank never matches a blank."""
    bare = lambda df: df.select(*group, *also, *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in identity])
    full = F.lit(True)
    for c in identity:
        full = full & (F.col(c) != "")
    seen = bare(acquired).filter(full).select(*also, *identity).distinct().withColumn("_found", F.lit(1))
    # counts per identity meet the acquired identities, not the rows
    per = bare(derived).groupBy(*group, *also, *identity).agg(F.count("*").alias("_n")).join(seen, [*also, *identity], "left")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0))
    n = per.groupBy(*group).agg(F.sum("_n").alias("series"), total(full).alias("eligible"), total(F.col("_found").isNotNull()).alias("inherited"))
    return n.withColumn("pct_of_eligible", F.when(F.col("eligible") == 0, 0.0).otherwise(F.round(100.0 * F.col("inherited") / F.col("eligible"), 2)))


def first_carrier(labels: dict[str, Column], unknown: str, none: str) -> tuple[Column, Column]:
    """(label, carrier): the first carrier, in order, whose label is not null."""
    carrier = F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for c, v in labels.items()], F.lit(none))
    return F.coalesce(*labels.values(), F.lit(unknown)), carrier


def needle_values(records: DataFrame, key: str, attributes: dict[str, Column], needles: Sequence[str], n: int) -> DataFrame:
    """(attribute, value, objects, place): for each attribute (an array of an object's values, nested or not) the n
    commonest values that hold a needle in any case. Values are counted before they are ranked."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("values")) for a, v in attributes.items()])
    long = records.select(key, F.explode(each).alias("a")).select(key, "a.attribute", F.explode(F.array_distinct(F.filter("a.values", lambda v: v.isNotNull()))).alias("value"))
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(F.lower("value"), F.lit(needle.lower()))
    counted = long.filter(hit).groupBy("attribute", "value").agg(F.count_distinct(key).alias("objects"))
    place = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("objects"), "value"))
    return counted.withColumn("place", place).filter(F.col("place") <= n)


def search_fields(url: Column, text: Column) -> dict[str, Column]:
    """page, query (decoded from the URL, else the text's title) and hits (as stated in the text) of a saved search, "not
    captured" where a record doesn't tell."""
    shown = lambda *vs: F.coalesce(*[F.nullif(v, F.lit("")) for v in vs], F.lit("not captured"))
    asked = F.try_url_decode(F.regexp_extract(url, "[?&](q|query|term)=([^&#]*)", 2))
    return {
        "page": shown(F.regexp_extract(url, "[?&]page=([0-9]+)", 1)),
        "query": shown(asked, F.trim(F.regexp_extract(text, "<title>([^<]*)</title>", 1))),
        "hits": shown(F.replace(F.regexp_extract(text, "([0-9][0-9,]*) (results|hits|records)", 1), F.lit(","), F.lit(""))),
    }


def carrier_hierarchy(df: DataFrame, key: str, levels: Sequence[str], telling, text: str, version: str, least: int, texts: int | None = None) -> DataFrame:
    """Per key with enough rows: the smallest telling value of each level's column (level1, level2, ...; null if none tells),
    the first level that has one, its value, and the smallest version named in the key's texts. telling: column name -> its
    value if it tells, else null. texts: look at so many distinct texts only, the smallest; all, if None."""
    names = [f"level{k + 1}" for k in range(len(levels))]
    ex = [F.min(telling(c)).alias(name) for c, name in zip(levels, names, strict=True)]
    per = df.groupBy(key).agg(F.count("*").alias("series"), *ex).filter(F.col("series") >= least)
    level = F.coalesce(*[F.when(F.col(name).isNotNull(), F.lit(k + 1)) for k, name in enumerate(names)])
    looked = df.filter(F.col(text).isNotNull()).select(key, text)
    if texts is not None:
        looked = top(looked.distinct(), [key], [F.asc(text)], texts)
    named = looked.groupBy(key).agg(F.min(F.nullif(F.regexp_extract(text, version, 0), F.lit(""))).alias("version_example"))
    out = per.join(named, key, "left")
    return out.select(key, "series", *names, level.alias("level"), F.coalesce(*names).alias("example"), F.col("version_example").isNotNull().alias("version_in_text"), "version_example")


def recoverability(objects: DataFrame, values: DataFrame, by: Sequence[str], levels: Sequence[tuple[str, bool]], named: Column, version: str) -> DataFrame:
    """The first level at which any of a group's objects names a producer, and whether a version stands there.

    objects: one row each, with the columns `by`. values(by, level from 1, use "identity" or "version", value): what
    the carriers of a level hold; blank and null say nothing. levels: (name, whether it is in the object itself).
    named: a condition on `value`; version: the pattern of a version.
    -> by, objects, first_level, level_name, producer, version, version_in (the value that holds it), in_object,
    level1, level2, ...; of several values the smallest is shown. A version may also stand in the producer's value.
    """
    v = F.col("value")
    distinct = values.filter(F.trim("value") != "").select(*by, "level", "use", "value").distinct()
    identity = F.col("use") == "identity"
    dated = v.rlike(version)
    p = distinct.groupBy(*by, "level").agg(F.min(F.when(identity & named, v)).alias("producer"), F.min(F.when(~identity & dated, v)).alias("_in"))
    p = p.filter("producer IS NOT NULL").withColumn("version_in", F.coalesce("_in", F.when(F.col("producer").rlike(version), F.col("producer"))))
    yes = [F.bool_or(F.col("level") == k + 1).alias(f"level{k + 1}") for k in range(len(levels))]
    first = p.groupBy(*by).agg(F.min("level").alias("first_level"), F.min_by(F.struct("producer", "version_in"), "level").alias("_first"), *yes)
    names = F.array(*[F.lit(name) for name, _ in levels])
    inside = F.array(*[F.lit("yes" if own else "no, registry only") for _, own in levels])
    same = [F.col(f"_g.{b}").eqNullSafe(F.col(f"_f.{b}")) for b in by]
    counted = objects.groupBy(*by).agg(F.count("*").alias("objects"))
    at = F.col("first_level")
    return counted.alias("_g").join(first.alias("_f"), same, "left").select(
        *[f"_g.{b}" for b in by],
        "objects",
        "first_level",
        F.coalesce(F.get(names, at - 1), F.lit("appears at no level")).alias("level_name"),
        F.col("_first.producer").alias("producer"),
        F.regexp_extract("_first.version_in", f"({version})", 1).alias("version"),
        F.col("_first.version_in").alias("version_in"),
        F.coalesce(F.get(inside, at - 1), F.lit("appears nowhere")).alias("in_object"),
        *[F.coalesce(f"level{k + 1}", F.lit(False)).alias(f"level{k + 1}") for k in range(len(levels))],
    )


def module_table(types: DataFrame, held: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(type, module, usage, a column for each attribute): what each attribute is in each module of each type.

    held(type, module, usage, attribute, kind, order): of an attribute held twice the kind first in order counts. A
    type without modules gives one row that says so, an attribute that a module lacks says "not in module".
    """
    kinds = [F.min_by("kind", F.when(F.col("attribute") == a, F.col("order"))).alias(a) for a in attributes]
    wide = held.groupBy("type", "module", "usage").agg(*kinds)
    there = F.col("module").isNotNull()
    shown = [F.when(there, F.coalesce(a, F.lit("not in module"))).otherwise("").alias(a) for a in attributes]
    return types.join(wide, "type", "left").select("type", F.coalesce("module", F.lit("TYPE NOT FOUND")).alias("module"), F.coalesce("usage", F.lit("")).alias("usage"), *shown)
