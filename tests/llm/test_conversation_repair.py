"""Conversation repair against trying every edit, and against keeping the best edits as whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from auditspark.llm import conversation_repair as cr

SHAPE = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """Tries all edits of a few rows: (cost, audit), the least."""
    options = []
    for initial, fault in rows:
        own = [(4, "D", "")]
        if fault not in "bd":
            more = 3 if fault == "t" else 0
            own += [(more, "K", initial), (3 + more, "R", "u"), (3 + more, "R", "a")]
        options.append(own)
    inserts = [(3 * n, "I" * n, "".join(p)) for n in range(3) for p in itertools.product("ua", repeat=n)]
    best = None
    for edits in itertools.product(*(itertools.product(inserts, own) for own in options)):
        for end in inserts:
            flat = [x for pair in edits for x in pair] + [end]
            if SHAPE.fullmatch("".join(x[2] for x in flat)):
                found = (sum(x[0] for x in flat), "".join(x[1] for x in flat))
                best = min(found, best or found)
    return best


NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def slow_repair(rows):
    """(cost, audit) by keeping for each last initial the best whole string of edits directly behind a row."""
    at = {"": (0, "")}
    for initial, fault in rows:
        to = {}
        for state, (cost, audit) in at.items():
            for n in range(3):
                ways = [(4, "D", state)]
                if fault not in "bd":
                    more = 3 if fault == "t" else 0
                    ways += [(3 + more, "R", c) for c in NEXT[state] if c != "s"] + [(more, "K", initial)] * (initial in NEXT[state])
                for c, e, t in ways:
                    own = (cost + 3 * n + c, audit + "I" * n + e)
                    to[t] = min(own, to.get(t, own))
                state = next(c for c in NEXT[state] if c != "s")
        at = to
    return min((c + 3 * n, a + "I" * n) for s, (c, a) in at.items() for n in [{"": 0, "s": 2, "u": 1, "a": 0}[s]])


def solved(rows, size):
    """What the operator does with the segments of a conversation."""
    cut = [rows[k : k + size] for k in range(0, len(rows), size)]
    steps = [cr.segment_step(p) for p in cut]
    states = cr.crossings(steps, cr.NOTHING, cr.END, cr.forward, cr.backward)
    audit, cost, start = "", 0, cr.NOTHING
    for k, (part, t) in enumerate(zip(cut, states, strict=True)):
        end = cr.END if k == len(cut) - 1 else tuple(0 if s == t else cr.FAR for s in range(4))
        for row, to in zip(part, cr.crossings(part, start, end), strict=True):
            c, e = cr.step(row)[start][to]
            cost, audit, start = cost + c, audit + e, to
    return cost + cr.END[start], audit + "I" * cr.AT_END[start]


def some_rows(rng, n):
    return [rng.choice("suua a"[: rng.choice([4, 6])]) + rng.choice("----btd") for _ in range(n)]


def test_equals_every_repair():
    rng = random.Random(4)
    for n in (0, 1, 2, 3):
        for _ in range(25 if n < 3 else 12):
            rows = some_rows(rng, n)
            assert slow_repair(rows) == every_repair(rows), rows


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_crossings_equal_whole_strings(size):
    rng = random.Random(size)
    for n in [*range(1, 12), 40, 150] * 6:
        rows = some_rows(rng, n)
        assert solved(rows, size) == slow_repair(rows), rows
        if n > 20:
            rows = [r[0] + "-" for r in rows]
            assert solved(rows, size) == slow_repair(rows), rows


def slow_query(rows):
    """The contract's result, row by row, from (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in r[:2]] + [r[2] or " ", r[3] or " "]):
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            plain = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not plain else "d" if (role, text) in seen else "t" if plain[-1] not in ".!?" else "-")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]
        turns = [t for t, *_ in own if t is not None]
        cost, audit = slow_repair([(i or " ") + f for i, f in zip(initials, faults, strict=True)])
        left, k, state = [], 0, ""
        for e in audit:
            if e in "IR":
                role = "assistant" if state == "u" else "user"
                left.append(f"{role}:{own[k][2] if e == 'R' else ''}")
                state = role[0]
            elif e == "K":
                left.append(f"{own[k][1]}:{own[k][2]}")
                state = own[k][1][0]
            k += e != "I"
        out.append(
            (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
             sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
        )
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def many(spark, n=400, seed=1):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "a b?\n", " \t", "", None, "é", "…", "end. ", "Long text. " * 30]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            rows += [(conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "assistant", "user", "system", None, "tool", "", "User"]), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.")]
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(10_000, k, "user" if k % 2 == 0 else "assistant", f"Row {k}." if k % 5 else "Row") for k in range(900)]
    return rows


def crafted_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, edits int")


def result(df):
    names = ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]
    order = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(df.columns) == sorted(names)
    return sorted(map(tuple, df.select(*order).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("segment", [4096, 3])
def test_query_equals_row_by_row(spark, tmp_path, monkeypatch, segment):
    """Nulls in every column, empty texts, repeated rows, a long conversation, rows whose turns tie."""
    rows = many(spark)
    crafted_table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(cr, "SEGMENT", segment)
    got = cr.query(spark, str(tmp_path))
    assert dict(got.dtypes) == {"conv_id": "bigint", **dict.fromkeys(cr.COUNTS, "bigint"), "audit": "string", "repaired_sha256": "string"}
    assert result(got) == slow_query(rows)


def test_a_conversation_lies_in_many_tasks(spark):
    rows = [(1, k, "user", f"Row {k}.") for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    placed = cr.in_order(crafted_table(spark, rows)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["pos"] >> 33 for r in placed}) > 1
    assert [r["turn"] for r in sorted(placed, key=lambda r: r["pos"])] == list(range(500))


def test_log_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "system", "Be nice."), (2, 0, "system", "Only."), (3, 0, "user", "")]
    log, summary = cr.repair(crafted_table(spark, rows))
    got = {}
    for r in sorted(log.collect(), key=lambda r: (r["conv_id"], r["pos"], r["slot"])):
        got.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert got == {
        1: [("K", "user", "Hi."), ("D", "user", "Hi."), ("R", "assistant", "Be nice.")],
        2: [("D", "system", "Only.")],
        3: [("D", "user", "")],
    }
    assert {r["conv_id"]: (r["cost"], r["duplicate"], r["blank"], r["illegal"]) for r in summary.collect()} == {1: (7, 1, 0, 2), 2: (4, 0, 0, 0), 3: (4, 0, 1, 0)}
    log, summary = cr.repair(crafted_table(spark, []))
    assert log.collect() == [] and summary.collect() == []


def test_no_row_after_damage(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    crafted_table(spark, [(gone, 0, "user", "x")]).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(cr.query(spark, str(tmp_path))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
