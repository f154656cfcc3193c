"""Conversation structure repair, by Hirschberg's divide and conquer.

A conversation should read system? (user assistant)+, or be empty. Its rows are kept (cost 0), given the other role (3), or
deleted (4; blank rows and repeated ones must be), and empty rows of user or assistant are inserted anywhere (3); a row
that ends in the middle of a sentence and isn't deleted costs 3 more. What has been read so far is one of four states: nothing,
a system row, a user row last, an assistant row last.

1. Rows are put in the order of their conversations by ranges, so that a long conversation lies in many tasks, and cut into
   segments of bounded length. Each segment gives what it costs to come from each state to each other.
2. Over a conversation's segments, and then over a segment's rows, forward costs of the four states and backward ones meet
   in the middle; of the crossings with the least sum the one whose edits so far come first in ASCII order is taken, and
   either half is solved alike. Only two vectors of four are held at a time, so memory is linear.

Edits are written as their initials, a row's inserts before its own edit. As every crossing lies directly behind a row's
edit, the edits of two different crossings are never the beginning one of the other, so that a rank for each state says which of
them come first whatever follows: a vector carries (cost, rank) of each state.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.workers import drop
from auditspark.session import materialise, read_table, ship_package

#: States, and the roles that an insert or a new role gives in each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GIVEN = ["user", "user", "assistant", "user"]
INSERTED = [USER, USER, ASSISTANT, USER]
#: The initial of a role that may follow each state -> the state it leads to.
FOLLOWS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Inserts that complete a conversation which ends in each state.
AT_END = [0, 2, 1, 0]
END = tuple(INSERT * n for n in AT_END)
FAR = 10**15
#: Rows of a segment.
SEGMENT = 4096
WHITE = " \t\n\x0b\x0c\r"

# --- the costs of one conversation ------------------------------------------------------------------


@cache
def step(row: str) -> tuple:
    """row: a role's initial and a fault (b blank, d duplicate, t truncated, - none). For each two states None, or the
    cheapest (cost, edits) that lead from one to the other by this row, of equals the ASCII-least edits."""
    initial, fault = row
    best: dict = {}
    for start in range(4):
        state = start
        for inserts in range(3):
            more = CUT_SHORT if fault == "t" else 0
            to = [(DELETE, "D", state)]
            if fault not in "bd":
                to.append((REROLE + more, "R", INSERTED[state]))
                if initial in FOLLOWS[state]:
                    to.append((more, "K", FOLLOWS[state][initial]))
            for cost, edit, end in to:
                own = (INSERT * inserts + cost, "I" * inserts + edit)
                best[start, end] = min(own, best.get((start, end), own))
            state = INSERTED[state]
    return tuple(tuple(best.get((s, t)) for t in range(4)) for s in range(4))


def unit(state: int) -> tuple:
    return tuple((0 if s == state else FAR, 0) for s in range(4))


def forward(vector: tuple, by: tuple) -> tuple[tuple, int]:
    """The vector of (cost, rank) behind a step, with its least cost taken off, and that."""
    found: list = []
    for t in range(4):
        ways = [(vector[s][0] + by[s][t][0], vector[s][1], by[s][t][1]) for s in range(4) if vector[s][0] < FAR and by[s][t]]
        found.append(min(ways) if ways else None)
    order = sorted(w[1:] for w in found if w)
    low = min((w[0] for w in found if w), default=0)
    return tuple((w[0] - low, order.index(w[1:])) if w else (FAR, 0) for w in found), low


def backward(costs: tuple, by: tuple) -> tuple[tuple, int]:
    """What it costs from each state before a step to the end, with the least taken off, and that."""
    found = [min((way[0] + costs[t] for t, way in enumerate(by[s]) if way and costs[t] < FAR), default=FAR) for s in range(4)]
    low = min(found)
    return tuple(c - low if c < FAR else FAR for c in found), low


forward_row = cache(lambda vector, row: forward(vector, step(row)))  # so few vectors occur that a row costs a look-up
backward_row = cache(lambda costs, row: backward(costs, step(row)))


def along(vector: tuple, steps: list, one) -> tuple[tuple, int]:
    total = 0
    for by in steps:
        vector, low = one(vector, by)
        total += low
    return vector, total


def crossings(steps: list, start: int, end: tuple, ahead=forward_row, back=backward_row) -> list[int]:
    """The state behind each step on the way from the start to the end (a cost for each state) whose edits come first of
    the cheapest. steps: rows; or segments, with the functions for those."""
    found = [0] * len(steps)
    todo = [(0, len(steps), start, end)]
    while todo:
        lo, hi, start, end = todo.pop()
        if lo == hi:
            continue
        mid = (lo + hi + 1) // 2
        vector, _ = along(unit(start), steps[lo:mid], ahead)
        costs, _ = along(end, steps[mid:hi][::-1], back)
        cross = min(range(4), key=lambda t: (vector[t][0] + costs[t], vector[t][1]))
        found[mid - 1] = cross
        if mid - lo > 1:
            todo.append((lo, mid - 1, start, tuple(way[cross][0] if way[cross] else FAR for way in (step(steps[mid - 1]) if ahead is forward_row else steps[mid - 1]))))
        todo.append((mid, hi, cross, end))
    return found


def segment_step(rows: list[str]) -> tuple:
    """Like step(), for a segment: (cost, rank among those from the same state)."""
    found = []
    for s in range(4):
        vector, total = along(unit(s), rows, forward_row)
        found.append(tuple((total + cost, rank) if cost < FAR else None for cost, rank in vector))
    return tuple(found)


# --- rows in Spark ----------------------------------------------------------------------------------


def text_of(row_text: str) -> Column:
    return F.rtrim(F.col(row_text), F.lit(WHITE))


def in_order(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), nulls in role and text as one space, with their place: `pos` grows along a
    conversation, by turn (nulls first), then role and text. Ranges are cut inside conversations too."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = rows.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    return materialise(dealt.withColumn("pos", F.monotonically_increasing_id()), "in-order")


def with_faults(placed: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, row): each row's initial and its first fault, as step() takes them."""
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = placed.groupBy("conv_id", own.alias("own")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    last = F.right(text_of("text"), F.lit(1))
    narrow = placed.select("pos", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-").alias("fault"))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(" ")
    fault = F.when((F.col("fault") == "b") | F.col("first"), F.col("fault")).otherwise("d")
    return narrow.join(first, "pos", "left").select("pos", "conv_id", "turn", F.concat(initial, fault).alias("row"))


SEGMENTS = "seg long, conv_id long, pos array<long>, rows array<string>, costs array<long>, ranks array<int>, turns array<long>, steps long"


def segments(rows: DataFrame) -> DataFrame:
    """with_faults() -> segments of a conversation's rows. costs, ranks: segment_step(), 16 each, -1 for none; turns: the
    first and the last that isn't null; steps: how often the turn changes between them."""

    def work(batches):
        import pyarrow as pa

        drop()

        def one(conv, part):
            ways = [way or (-1, -1) for of in segment_step([r for _, _, r in part]) for way in of]
            turns = [t for _, t, _ in part if t is not None]
            return part[0][0], conv, [p for p, _, _ in part], [r for _, _, r in part], [w[0] for w in ways], [w[1] for w in ways], [turns[0], turns[-1]] if turns else [], sum(a != b for a, b in zip(turns, turns[1:], strict=False))

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()))], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        part, of, out = [], None, []
        for batch in batches:
            for pos, conv, turn, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part and (conv != of or len(part) == SEGMENT):
                    out.append(one(of, part))
                    part = []
                of = conv
                part.append((pos, turn, row))
            if len(out) > 1000:
                yield flush(out)
                out = []
        if part:
            out.append(one(of, part))
        yield flush(out)

    return rows.select("pos", "conv_id", "turn", "row").repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(work, SEGMENTS)


WAYS = "seg long, conv_id long, start int, finish int, last boolean, cost long, gaps long, illegal long"


def meet(cut: DataFrame) -> DataFrame:
    """segments -> for each the state it begins and ends in. The first of a conversation has its cost, the turns that
    are missing, and the neighbouring roles of two segments that may not follow each other; the others have nulls.
    A conversation's segments (a row for each SEGMENT of its rows, of 32 numbers) meet in one task."""

    def work(batches):
        import pyarrow as pa

        drop()

        def one(parts):
            steps = [tuple(tuple((cost, rank) if cost >= 0 else None for cost, rank in zip(p["costs"][4 * s : 4 * s + 4], p["ranks"][4 * s : 4 * s + 4], strict=True)) for s in range(4)) for p in parts]
            states = crossings(steps, NOTHING, END, forward, backward)
            starts = [NOTHING, *states[:-1]]
            cost = sum(by[s][t][0] for by, s, t in zip(steps, starts, states, strict=True)) + END[states[-1]]
            ends = [p["turns"] for p in parts if p["turns"]]
            distinct = sum(p["steps"] + 1 for p in parts if p["turns"]) - sum(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
            gaps = ends[-1][1] - ends[0][0] + 1 - distinct if ends else 0
            illegal = sum(a["last_row"][0] + b["first_row"][0] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
            for k, (p, s, t) in enumerate(zip(parts, starts, states, strict=True)):
                yield p["seg"], p["conv_id"], s, t, k == len(parts) - 1, *((cost, gaps, illegal) if not k else (None, None, None))

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in WAYS.split(", ")])

        parts, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if parts and r["conv_id"] != parts[0]["conv_id"]:
                    out += one(parts)
                    parts = []
                parts.append(r)
            if len(out) > 5000:
                yield flush(out)
                out = []
        if parts:
            out += one(parts)
        yield flush(out)

    narrow = cut.select("seg", "conv_id", "costs", "ranks", "turns", "steps", F.element_at("rows", 1).alias("first_row"), F.element_at("rows", -1).alias("last_row"))
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(work, WAYS)


def row_edits(cut: DataFrame, ways: DataFrame) -> DataFrame:
    """(pos, edits string, roles array<string>): each row's edits, inserts first, and the role that each leaves (null where it
    deletes, the row's own where it keeps: also null). The last row of a conversation has the inserts behind it too."""

    def work(batches):
        import pyarrow as pa

        drop()
        for batch in batches:
            pos, edits, roles = [], [], []
            for r in batch.to_pylist():
                end = END if r["last"] else tuple(0 if s == r["finish"] else FAR for s in range(4))
                states = crossings(r["rows"], r["start"], end)
                for p, row, s, t in zip(r["pos"], r["rows"], [r["start"], *states[:-1]], states, strict=True):
                    own = step(row)[s][t][1]
                    if r["last"] and p == r["pos"][-1]:
                        own += "I" * AT_END[t]
                    pos.append(p)
                    edits.append(own)
                    given = []
                    for edit in own:
                        given.append(GIVEN[s] if edit in "IR" else None)
                        s = INSERTED[s] if edit in "IR" else t if edit == "K" else s
                    roles.append(given)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(edits, pa.string()), pa.array(roles, pa.list_(pa.string()))], names=["pos", "edits", "roles"])

    narrow = cut.select("seg", "pos", "rows").join(ways.select("seg", "start", "finish", "last"), "seg")
    return narrow.select("pos", "rows", "start", "finish", "last").mapInArrow(work, "pos long, edits string, roles array<string>")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(conv_id, turn, role, text) -> (log, summary).

    log(conv_id, pos, slot, edit, role, text): an entry for each edit of the cheapest repair, of equals the ASCII-least,
    in the order (pos, slot): K and R with the row that they leave, I with the one inserted, D with the one that goes. The
    repaired conversations are the entries without D.
    summary(conv_id, gaps, blank, duplicate, truncated, illegal, cost longs): a row for each conversation. Of a row's faults
    the first counts; gaps are the turns missing between the smallest and the largest; illegal are neighbouring rows,
    before repair, whose roles' initials aren't su, ua or au.

    Defined results: a null role or text counts as one space; null turns come first; rows of one turn go by role and text;
    equal rows are duplicates of the first; rows with a null conv_id are a conversation; an empty table gives empty results;
    other columns are ignored.
    """
    ship_package(rows.sparkSession)
    placed = in_order(rows)
    faulty = materialise(with_faults(placed), "faults")
    cut = materialise(segments(faulty), "segments")
    ways = materialise(meet(cut), "ways")
    edits = row_edits(cut, ways)
    entries = F.transform(F.sequence(F.lit(1), F.length("edits")), lambda k: F.struct((k - 1).cast("int").alias("slot"), F.col("edits").substr(k, F.lit(1)).alias("edit"), F.get(F.col("roles"), k - 1).alias("given")))
    each = placed.join(edits, "pos").select("conv_id", "pos", "role", "text", F.explode(entries).alias("e"))
    log = each.select("conv_id", "pos", "e.slot", "e.edit", F.coalesce("e.given", "role").alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))
    inside = F.aggregate(
        F.sequence(F.lit(1), F.size("rows") - 1),
        F.lit(0).cast("long"),
        lambda n, k: n + F.when(F.concat(F.substring(F.get(F.col("rows"), k - 1), 1, 1), F.substring(F.get(F.col("rows"), k), 1, 1)).isin("su", "ua", "au"), 0).otherwise(1),
    )
    of_kind = lambda f: F.size(F.filter("rows", lambda r: F.substring(r, 2, 1) == f)).cast("long")
    faults = [of_kind("b").alias("blank"), of_kind("d").alias("duplicate"), of_kind("t").alias("truncated")]
    counts = cut.select("conv_id", *faults, F.when(F.size("rows") > 1, inside).otherwise(0).alias("illegal"))
    both = counts.select("*", F.lit(None).cast("long").alias("cost"), F.lit(None).cast("long").alias("gaps")).unionByName(ways.filter("cost IS NOT NULL").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")], "illegal", "cost", "gaps"))
    summary = both.groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max("cost").alias("cost"))
    return log, summary


def digests(log: DataFrame) -> DataFrame:
    """(conv_id, audit string, repaired_sha256 string): the edits' initials, and the hash of the repaired `role:text`,
    joined by newlines. A hash of a whole text is made in one task; it reads the conversation as a stream."""

    def work(batches):
        import pyarrow as pa

        drop()
        out, of, edits, sha, n = [], None, [], None, 0
        for batch in batches:
            for conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha is None or conv != of:
                    if sha is not None:
                        out.append((of, "".join(edits), sha.hexdigest()))
                    of, edits, sha, n = conv, [], hashlib.sha256(), 0
                edits.append(edit)
                if edit != "D":
                    sha.update(f"{'\n' if n else ''}{role}:{text}".encode())
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["conv_id", "audit", "repaired_sha256"])
            out = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array(["".join(edits)]), pa.array([sha.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "slot")
    return ordered.select("conv_id", "edit", "role", "text").mapInArrow(work, "conv_id long, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes out
    sentence ends, 3 repeats it, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(shown("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    hurt = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind <> 0")
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log, summary = repair(damage(rows))
    own, counted, told = (df.alias(n) for df, n in ((rows.select("conv_id").distinct(), "own"), (summary, "counted"), (digests(log), "told")))
    same = lambda side: F.col("own.conv_id").eqNullSafe(F.col(f"{side}.conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return own.join(counted, same("counted"), "left").join(told, same("told"), "left").select(
        "own.conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )


ORACLE_SQL = """
WITH RECURSIVE keyed AS (SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes FROM conversations),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain FROM damaged),
rows_ AS (SELECT *, role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN plain = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN plain[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
given(s, one, two) AS (VALUES (0, 2, 3), (1, 2, 3), (2, 3, 2), (3, 2, 3)),
inserted AS (SELECT s, 0 AS n, s AS m FROM given UNION ALL SELECT s, 1, one FROM given UNION ALL SELECT s, 2, two FROM given),
follows(m, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
faults(f, more) AS (VALUES ('b', 0), ('d', 0), ('t', 3), ('-', 0)),
ways AS (SELECT f, NULL::VARCHAR AS c, s, m AS t, 3 * n + 4 AS cost, repeat('I', n) || 'D' AS edits FROM inserted, faults
  UNION ALL SELECT f, NULL, i.s, g.one, 3 * n + 3 + more, repeat('I', n) || 'R' FROM inserted i JOIN given g ON g.s = i.m, faults WHERE f IN ('t', '-')
  UNION ALL SELECT f, c, s, t, 3 * n + more, repeat('I', n) || 'K' FROM inserted JOIN follows USING (m), faults WHERE f IN ('t', '-')),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, '00000000' AS v FROM counts
  UNION ALL SELECT b.conv_id, b.i + 1, w.t, min(lpad((b.v[1:8]::BIGINT + w.cost)::VARCHAR, 8, '0') || b.v[9:] || w.edits)
  FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN ways w ON w.s = b.s AND w.f = r.f AND (w.c IS NULL OR w.c = r.c) GROUP BY b.conv_id, b.i, w.t),
ended AS (SELECT conv_id, min(lpad((v[1:8]::BIGINT + 3 * more)::VARCHAR, 8, '0') || v[9:] || repeat('I', more)) AS v
  FROM best JOIN counts USING (conv_id) JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) e(s, more) USING (s) WHERE i = n GROUP BY conv_id),
solved AS (SELECT conv_id, v[1:8]::BIGINT AS cost, v[9:] AS audit FROM ended),
edits AS (SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS k, unnest(string_split(audit, '')) AS e FROM solved WHERE audit <> ''),
numbered AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS j FROM edits),
kept AS (SELECT n.conv_id, k, e, j, r.role, CASE WHEN e = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN j = 1 AND e = 'K' AND r.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS led
  FROM numbered n LEFT JOIN rows_ r ON r.conv_id = n.conv_id AND r.i = n.i WHERE e <> 'D'),
repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h FROM kept GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN solved USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""
