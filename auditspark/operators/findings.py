"""Findings of validators: log lines, message classes per cell, overlaps of class sets, gross and net counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators.quantiles import quantiles
from auditspark.session import materialise


def log_lines(logs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return logs.select(*keys, F.posexplode_outer(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def split_findings(logs: DataFrame, keys: Sequence[str], text: str, severity: str, banner: str) -> DataFrame:
    """Lines with a severity (the first group of its pattern) anywhere, else UNCLASSIFIED; a log's first line that is nothing but a type's name is its
    BANNER. Other lines without a severity stay findings."""
    lines = log_lines(logs, keys, text).filter(F.trim("line") != "")
    said = F.regexp_extract("line", severity, 1)
    tagged = lines.withColumn("severity", F.when(said == "", "UNCLASSIFIED").otherwise(said))
    named = (F.col("severity") == "UNCLASSIFIED") & F.trim("line").rlike(banner)
    first = F.min(F.when(named, F.col("pos"))).over(Window.partitionBy(*keys))
    return tagged.withColumn("severity", F.when(F.col("pos") == first, "BANNER").otherwise(F.col("severity")))


def split_prefixed(logs: DataFrame, keys: Sequence[str], text: str, severity: str, banner: str = "^Testing:[ \t]", passed: str = "Test passed") -> DataFrame:
    """The lines of logs in which a letter (`W: `, `E: `, `I: `) stands before every line, the verdict too: (keys, pos,
    kind, severity, message). kind is banner, passed or finding; a finding's severity is the one named in it, else its
    letter's, else UNCLASSIFIED; banners and verdicts have none and are no findings."""
    line = F.trim("line")
    lines = log_lines(logs, keys, text).select(*keys, "pos", line.alias("message")).filter("message <> ''")
    letter = F.regexp_extract("message", "^([WEI]): ", 1)
    body = F.trim(F.regexp_replace("message", "^[WEI]: ", ""))
    kind = F.when(body.rlike(banner), "banner").when(F.startswith(body, F.lit(passed)), "passed").otherwise("finding")
    said = F.regexp_extract("message", severity, 1)
    found = F.when(said != "", said).when(letter == "W", "Warning").when(letter == "E", "Error").otherwise("UNCLASSIFIED")
    return lines.select(*keys, "pos", kind.alias("kind"), F.when(kind == "finding", found).alias("severity"), "message")


def split_sectioned(logs: DataFrame, keys: Sequence[str], text: str, section: str, module: str, context: str, banner: str, flush: str) -> DataFrame:
    """Findings of logs in sections: (keys, pos, banner, severity, module, context, indented, finding, message).

    Patterns find a line's kind, in this order, their first group its name: the banner (a log's last one holds for all its
    findings), a section (names the severity; without its plural s, in upper case), a module (ends the context), a context
    (a parent's line). Blank lines and rules of `=` are no lines. Of the others, those before the first section go; indented
    ones (two blanks or a tab) are findings under the context; flush ones are findings only if they begin with `flush`,
    and end the context, as they have no parent.
    """
    raw = F.regexp_replace("line", r"\s+$", "")
    lines = log_lines(logs, keys, text).select(*keys, "pos", raw.alias("raw"), F.regexp_replace(raw, r"^\s+", "").alias("finding")).filter(~F.col("finding").rlike("^=*$"))
    kind = F.lit("line")
    for name, pattern in (("context", context), ("module", module), ("section", section), ("banner", banner)):
        kind = F.when(F.col("finding").rlike(pattern), name).otherwise(kind)
    marked = lines.withColumn("kind", kind).withColumn("indented", F.col("raw").rlike("^(  |\t)"))
    of = lambda name, pattern: F.when(F.col("kind") == name, F.regexp_extract("finding", pattern, 1))
    log = Window.partitionBy(*keys)
    so_far = log.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda c: F.last(c, ignorenulls=True).over(so_far)
    known = marked.select(
        "*",
        F.last(of("banner", banner), ignorenulls=True).over(log.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("banner"),
        upto(F.upper(F.regexp_replace(of("section", section), "s$", ""))).alias("severity"),
        upto(of("module", module)).alias("module"),
    )
    is_flush = (F.col("kind") == "line") & ~F.col("indented") & F.startswith("finding", F.lit(flush)) & F.col("severity").isNotNull()
    event = F.when((F.col("kind") == "module") | is_flush, "").otherwise(of("context", context))  # an empty one ends it
    found = known.withColumn("context", F.nullif(upto(event), F.lit(""))).filter((F.col("kind") == "line") & F.col("severity").isNotNull() & (F.col("indented") | is_flush))
    message = F.format_string("Module <%s> %s %s", F.coalesce("module", F.lit("?")), F.coalesce("context", F.lit("")), "finding")
    return found.select(*keys, "pos", "banner", "severity", "module", "context", "indented", "finding", message.alias("message"))


def cell_sets(messages: DataFrame, cell: Sequence[str], group: str, id_col: str) -> DataFrame:
    """Distinct (cell, group, class): the form in which sets are compared. Sets stay rows, so their size is free."""
    return messages.select(*cell, group, id_col).distinct()


def overlap(messages: DataFrame, cell: Sequence[str], group: str, a: str, b: str, id_col: str, grid: DataFrame | None = None) -> DataFrame:
    """Per cell: sizes of the two groups' class sets, shared, union, Jaccard (1 where both are empty, flagged
    vacuous), and how they lie: equal, subset, superset, disjoint or overlapping."""
    flags = cell_sets(messages.filter(F.col(group).isin(a, b)), cell, group, id_col).groupBy(*cell, id_col).agg(F.bool_or(F.col(group) == a).alias("in_a"), F.bool_or(F.col(group) == b).alias("in_b"))
    both = F.col("in_a") & F.col("in_b")
    n = flags.groupBy(*cell).agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(both).alias("shared"), F.count("*").alias("n_union"))
    if grid is not None:
        n = grid.join(n, list(cell), "left").fillna(0, ["n_a", "n_b", "shared", "n_union"])
    lie = (
        F.when((F.col("n_a") == F.col("n_b")) & (F.col("shared") == F.col("n_a")), "equal")
        .when(F.col("shared") == F.col("n_a"), "subset")
        .when(F.col("shared") == F.col("n_b"), "superset")
        .when(F.col("shared") == 0, "disjoint")
        .otherwise("overlapping")
    )
    return n.withColumn("jaccard", F.when(F.col("n_union") == 0, 1.0).otherwise(F.round(F.col("shared") / F.col("n_union"), 4))).withColumn("vacuous", F.col("n_union") == 0).withColumn("direction", lie)


def residue(messages: DataFrame, cell: Sequence[str], group: str, a: str, b: str, id_col: str, shown: str) -> DataFrame:
    """The classes that only one of the two groups has in a cell."""
    flags = messages.filter(F.col(group).isin(a, b)).groupBy(*cell, id_col).agg(F.bool_or(F.col(group) == a).alias("in_a"), F.bool_or(F.col(group) == b).alias("in_b"), F.min(shown).alias(shown))
    return flags.filter(F.col("in_a") != F.col("in_b")).select(*cell, id_col, F.when(F.col("in_a"), a).otherwise(b).alias("only_in"), shown)


def triple(messages: DataFrame, objects: DataFrame, unit: str, keys: Sequence[str], obj: str, verdict: Column) -> DataFrame:
    """gross, floor, net and other objects per key, over all objects (unit "(all)") and for each unit, with percentages of
    the unit's objects(unit, obj): an object is net if one of its classes is NET, floor if all of its classes are like the
    floor, else other; undecided objects are counted beside. Each object is judged once."""
    per = messages.withColumn("_v", verdict).groupBy(*keys, unit, obj).agg(F.bool_or(F.col("_v") == "NET").alias("net"), F.bool_and(F.col("_v") == "FLOOR").alias("floor"), F.bool_or(F.col("_v") == "UNDECIDABLE").alias("open"))
    counts = [F.count("*").alias("gross"), F.count_if("floor").alias("floor"), F.count_if("net").alias("net"), F.count_if(~F.col("net") & ~F.col("floor")).alias("other"), F.count_if("open").alias("undecidable")]
    by_unit = per.groupBy(*keys, unit).agg(*counts)
    # an object has one unit, so all objects are the sum of the units
    summed = by_unit.groupBy(*keys).agg(F.lit("(all)").alias(unit), *[F.sum(c).alias(c) for c in ("gross", "floor", "net", "other", "undecidable")])
    n = objects.groupBy(unit).agg(F.count_distinct(obj).alias("objects"))
    n = n.unionByName(n.agg(F.lit("(all)").alias(unit), F.sum("objects").alias("objects")))
    share = lambda c: F.round(100.0 * F.col(c) / F.col("objects"), 2).alias(f"pct_{c}")
    return by_unit.unionByName(summed).join(n, unit).select("*", *[share(c) for c in ("gross", "floor", "net")])


def net_union(objects: DataFrame, id_col: str, collection: str, obj: str) -> DataFrame:
    """objects(id, collection, obj, net): objects, net objects and their share over all ("(all)") and per id, the number of
    collections and the median over collections of their shares."""
    per = objects.groupBy(id_col, collection, obj).agg(F.bool_or("net").alias("net")).groupBy(id_col, collection).agg(F.count("*").alias("n"), F.count_if("net").alias("k"))
    whole = per.groupBy(collection).agg(F.lit("(all)").alias(id_col), F.sum("n").alias("n"), F.sum("k").alias("k"))
    both = materialise(per.unionByName(whole).withColumn("share", 100.0 * F.col("k") / F.col("n")), "collections")
    median = quantiles(both, [id_col], "share", {"median": 0.5})
    out = both.groupBy(id_col).agg(F.sum("n").alias("objects"), F.sum("k").alias("net_objects"), F.count("*").alias("collections")).alias("o").join(median.alias("m"), F.col(f"o.{id_col}").eqNullSafe(F.col(f"m.{id_col}")))
    return out.select(f"o.{id_col}", "objects", "net_objects", F.round(100.0 * F.col("net_objects") / F.col("objects"), 2).alias("pct_net"), "collections", F.round("median", 4).alias("median_collection_pct"))


#: Children of a node of the hash tree, and leaves up to which they are broadcast.
FANOUT, BROADCAST_LEAVES = 4096, 500_000


def _sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """By node: the number of rows and the sums of two hashes of them, which don't depend on the order."""
    return df.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"), F.sum(F.col("_g").cast("decimal(38,0)")).alias("_t"))


def unlike_rows(first: DataFrame, second: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The rows of either table that lie in leaves of a hash tree in which the tables differ.

    Rows are dealt to FANOUT ** depth leaves by a hash; a node's sums are compared from the root down, and only below unlike
    nodes they are taken again. Sums go up from each task, so no row is shuffled. Tables with equal sums (a count and
    twice 64 bits a leaf) count as equal.
    """
    columns = first.columns
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]  # a hash passes nulls over
    hashed = [df.select(*columns, F.xxhash64(*values).alias("_h"), F.xxhash64(F.lit(1), *values).alias("_g")) for df in (first, second)]
    place = F.col("_h")
    by: list[str] = []
    for k in range(depth):
        by.append(f"_b{k}")
        hashed = [df.withColumn(by[-1], F.pmod(place, F.lit(FANOUT)).cast("int")) for df in hashed]
        place = F.shiftrightunsigned(place, 12)
        x, y = (_sums(df, by) for df in hashed)
        same = (F.col("x._n") == F.col("y._n")) & (F.col("x._s") == F.col("y._s")) & (F.col("x._t") == F.col("y._t"))
        met = x.alias("x").join(y.alias("y"), by, "full_outer")
        unlike = materialise(met.filter(~F.coalesce(same, F.lit(False))).select(*by), "unlike")
        n = unlike.limit(BROADCAST_LEAVES + 1).count()
        hashed = [df.join(F.broadcast(unlike) if n <= BROADCAST_LEAVES else unlike, by, "left_semi") for df in hashed]
    return tuple(df.select(*columns) for df in hashed)


def table_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: equal as bags, the rows that only one has (as often as it has them more often), and the smallest row that
    differs, with its side, as text. Only rows in unlike leaves of a hash tree are shuffled, once for both differences."""
    columns = first.columns
    first, second = unlike_rows(first, second)
    both = first.select("*", F.lit(1).alias("_n")).unionByName(second.select("*", F.lit(-1).alias("_n")))
    d = both.groupBy(*columns).agg(F.sum("_n").alias("_d")).filter("_d <> 0")
    least = F.min(F.struct(*columns, F.when(F.col("_d") > 0, "first").otherwise("second").alias("_side"))).alias("m")
    t = d.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_second"), least)
    shown = F.concat_ws("|", *[F.coalesce(F.col(f"m.{c}").cast("string"), F.lit("")) for c in columns])
    return t.select("only_first", "only_second", F.col("m").isNull().alias("equal"), F.when(F.col("m").isNotNull(), shown).alias("first_difference"), F.col("m._side").alias("side"))


def corroboration(states: DataFrame, messages: DataFrame, obj: str, validators: Sequence[str]) -> DataFrame:
    """states(obj, attribute, state), messages(obj, validator, template) -> for each attribute, state and validator the
    objects for which it raised a message that names the attribute, and those for which it was silent. Attributes and
    messages of one object meet, nothing else."""
    said = messages.join(states.select(obj, "attribute").distinct(), obj).filter(F.contains("template", F.col("attribute"))).select(obj, "attribute", "validator").distinct()
    each = states.select(obj, "attribute", "state").distinct().withColumn("validator", F.explode(F.array(*[F.lit(v) for v in validators])))
    hit = each.join(said.withColumn("hit", F.lit(True)), [obj, "attribute", "validator"], "left")
    return hit.groupBy("attribute", "state", "validator").agg(F.count("hit").alias("raised"), (F.count("*") - F.count("hit")).alias("silent"))
