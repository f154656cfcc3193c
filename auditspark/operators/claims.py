"""Governance of a claims table: upserts that respect earlier decisions, validation, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.session import materialise


def sticky_upsert(old: DataFrame, new: DataFrame, key: str, sticky: dict[str, str], protected: tuple[Column, Sequence[str]] | None = None) -> DataFrame:
    """Insert or replace by key. A column that holds its sticky value keeps it; where `protected`'s condition holds
    for an existing key its columns keep their old values. Equal keys in `new` must have been ruled out."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    b = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = a.join(b, key, "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.coalesce(f"_n_{c}", f"_o_{c}")
        out = F.when(o == sticky[c], o).otherwise(n) if c in sticky else n
        return F.when(protected[0] & F.col("_old"), o).otherwise(out) if protected and c in protected[1] else out

    return j.select(key, *[merged(c).alias(c) for c in columns])


def violations(rows: DataFrame, key: str, statuses: Sequence[str], required: Sequence[str], unknown: Column | None = None) -> DataFrame:
    """(key, violation) of a batch: invalid status, duplicate id, missing required field, and the names in the array
    `unknown` of fields that the table hasn't."""
    faults = F.array_compact(F.array(F.when(~F.col("status").isin(*statuses), "invalid status"), *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"missing {c}") for c in required]))
    if unknown is not None:
        faults = F.concat(faults, F.transform(unknown, lambda f: F.concat(F.lit("unknown field "), f)))
    bad = rows.select(key, F.explode(faults).alias("violation"))
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("duplicate id").alias("violation"))
    return bad.unionByName(twice)


def all_or_nothing(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The batch's rows if `bad` has none, else no row."""
    return rows.join(F.broadcast(bad.agg(F.count("*").alias("_bad"))), F.col("_bad") == 0).drop("_bad")


def proposed_rows(files: DataFrame, name: str, content: str, fields: Sequence[str]) -> DataFrame:
    """(name, place, present, unknown, each of the fields as a string) of proposal files.

    A file's content is JSON: a list of rows, an envelope with the list under `rows`, or one row. `present` holds the
    fields that a row sets, `unknown` what it sets beside them. Content that can't be read gives one row of nulls.
    """
    rows = "array<map<string,string>>"
    c = F.trim(content)
    inner = F.get_json_object(c, "$.rows")
    parsed = F.when(F.startswith(c, F.lit("[")), F.from_json(c, rows)).when(inner.isNotNull(), F.from_json(inner, rows)).otherwise(F.array(F.from_json(c, "map<string,string>")))
    row = F.col("_row")
    keys, ours = F.map_keys(row), F.array(*map(F.lit, fields))
    return files.select(name, F.posexplode_outer(parsed).alias("place", "_row")).select(
        name, "place", F.array_intersect(ours, keys).alias("present"), F.array_sort(F.array_except(keys, ours)).alias("unknown"), *[row[f].alias(f) for f in fields]
    )


def judge_proposals(rows: DataFrame, claims: DataFrame, statuses: Sequence[str], protected: Column, outcome: Sequence[str]) -> DataFrame:
    """proposed_rows with `dropped` (how many unknown keys went) and `decision`: accepted, or all that speaks against the row.

    A protected id (a condition on `id`) must be there already, keeps its claim and may only have its outcome fields
    set; a retired row is neither reworded nor made current again. claims(id, claim, status), ids distinct.
    """
    old = claims.select("id", F.col("claim").alias("_claim"), F.col("status").alias("_status"))
    there = F.col("_status").isNotNull()
    reworded = F.coalesce(there & (F.trim("claim") != "") & (F.trim("claim") != F.trim("_claim")), F.lit(False))
    retired = F.col("_status").eqNullSafe("RETIRED")
    stray = F.array_except("present", F.array(F.lit("id"), *map(F.lit, outcome)))
    reasons = [
        (F.coalesce(F.trim("id"), F.lit("")) == "", F.lit("no id")),
        (~F.col("status").isin(*statuses), F.lit("invalid status")),
        (protected & ~there, F.lit("new pre-registration")),
        (protected & reworded, F.lit("rewords a protected row")),
        (protected & there & (F.size(stray) > 0), F.concat(F.lit("sets "), F.array_join(stray, ", "))),
        (retired & (F.trim("status") != "") & (F.col("status") != "RETIRED"), F.lit("un-retires")),
        (retired & reworded, F.lit("rewords a retired row")),
    ]
    against = F.array_join(F.array_compact(F.array(*[F.when(c, what) for c, what in reasons])), "; ")
    decision = F.when(against == "", "accepted").otherwise(against)
    return rows.join(old, "id", "left").select(*rows.columns, F.size("unknown").alias("dropped"), decision.alias("decision"))


def retire(claims: DataFrame, retired: DataFrame) -> DataFrame:
    """claims with the ids of retired(id, successor) marked, and a `supersedes` link on each successor."""
    gone = retired.select("id", F.col("successor").alias("_to"), F.lit(True).alias("_gone"))
    back = retired.select(F.col("successor").alias("id"), F.col("id").alias("supersedes"))
    j = claims.join(gone, "id", "left").join(back, "id", "left")
    return j.select("id", F.when(F.col("_gone"), "RETIRED").otherwise(F.col("status")).alias("status"), F.coalesce("_to", "superseded_by").alias("superseded_by"), "supersedes")


def rates_without_floor(claims: DataFrame, text: str, floor: str) -> DataFrame:
    quotes = F.contains(text, F.lit("percent")) | F.contains(text, F.lit("%")) | F.contains(text, F.lit(" of "))
    return claims.filter((F.col("status") == "MEASURED") & quotes & (F.coalesce(F.trim(floor), F.lit("")) == ""))


def fill_rates(df: DataFrame) -> DataFrame:
    """(column_name, filled, pct) of every column, in one pass."""
    n = df.agg(F.count("*").alias("_n"), *[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in df.columns])
    long = n.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in df.columns])).alias("x"))
    return long.select("x.column_name", "x.filled", F.round(100.0 * F.col("x.filled") / F.col("_n"), 1).alias("pct"))


def null_join_guard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows a join on the keys would lose to nulls."""
    some = F.lit(False)
    for k in keys:
        some = some | F.col(k).isNull()
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys], F.count_if(some).alias("any_null")).withColumn("clean", F.col("any_null") == 0)


def tokens(df: DataFrame, key: str, column: str, pattern: str, name: str) -> DataFrame:
    """A row for each non-blank part of a delimited text."""
    return df.select(key, F.explode(F.filter(F.transform(F.split(column, pattern), lambda t: F.trim(t)), lambda t: t != "")).alias(name))


def chain_ends(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, last, hops) of links(id, next), ids distinct: where the chain from each id ends, and after how many steps.

    Each round lets a link skip as far as its target has got, so chains of any length up to 2^rounds take as many
    joins as their length has bits. A chain that runs into a cycle has no end: both are null then, and the
    rounds end once no chain can be longer than there are links.
    """
    start = links.filter("next IS NOT NULL").groupBy("id").agg(F.min("next").alias("last")).withColumn("hops", F.lit(1).cast("long"))
    ends = materialise(start, "links")
    n = ends.count()
    for k in range(rounds):
        far = ends.select(F.col("id").alias("last"), F.col("last").alias("_last"), F.col("hops").alias("_hops"))
        moved = ends.join(far, "last", "left")
        ends = materialise(moved.select("id", F.coalesce("_last", "last").alias("last"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_last").isNotNull().alias("open")), "links")
        if 2**k > n or ends.filter("open").isEmpty():
            break
    return ends.select("id", *[F.when(~F.col("open"), F.col(c)).alias(c) for c in ("last", "hops")])


def claims_join(claims: DataFrame, sources: DataFrame, references: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Per claim: whether its sources exist (yes / partial / no / none), which artefacts carry it, whether its
    references and its successor exist."""
    a = artefacts.select(F.col("artefact").alias("token"), F.col("artefact"))
    s = sources.join(a, "token", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("artefact").alias("found"), F.array_join(F.array_sort(F.collect_list("artefact")), " ").alias("names"))
    ids = claims.select(F.col("id").alias("known"))
    q = references.join(ids, F.col("ref") == F.col("known"), "left").groupBy("id").agg(F.bool_and(F.col("known").isNotNull()).alias("refs_ok"))
    j = claims.join(s, "id", "left").join(q, "id", "left").join(ids, F.col("superseded_by") == F.col("known"), "left")
    exists = F.when(F.col("n").isNull(), "none").when(F.col("found") == F.col("n"), "yes").when(F.col("found") > 0, "partial").otherwise("no")
    return j.select("id", exists.alias("source_exists"), F.nullif("names", F.lit("")).alias("carried_by"), F.coalesce("refs_ok", F.lit(True)).alias("refs_ok"), (F.col("superseded_by").isNull() | F.col("known").isNotNull()).alias("successor_ok"))


def mentions(docs: DataFrame, key: str, text: Column, ids: DataFrame) -> DataFrame:
    """Distinct (id, document) where the id occurs as a whole token. The words of each document are cut out once
    and joined on equality."""
    words = docs.select(key, F.explode_outer(F.array_distinct(F.split(text, "[^a-z0-9-]+"))).alias("id"))
    return words.join(ids, "id").select("id", key).distinct()
