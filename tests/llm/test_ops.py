"""The ten operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditspark.llm import best_fit, chat_format, decontaminate, fingerprints, language_id, line_dedup, near_dedup, shard_lookup, sorted_table, tokens, toxicity
from auditspark.llm.components import connected_components
from auditspark.llm.tokens import Encoder, encoder
from auditspark.session import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, kept_text int, n_shingles int, lines string, length int, component_id int"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """documents with further columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in rows], DOCS)


def documents(spark, n=None):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    return rows[:n]


ODD = [(1, None), (2, ""), (3, " "), (4, "word"), (None, "no id here at all"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "x" * 200_000), (7, "\n\n"), (8, "Ünï çødé ★ 漢字 text")]


# 1 ------------------------------------------------------------------------------------------------
def shingles(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_decontaminate_equals_brute_force(spark):
    docs = documents(spark)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs += [(10_000 + k, f"{docs[k][1]} {t} {docs[k + 1][1]}") for k, (_, t) in enumerate(items[:5])]
    docs += [(10_100, " ".join(items[6][1].split()[:-3])), (10_101, None), (10_102, "")]
    sets = {i: shingles(t) for i, t in items}
    want = {(d, i) for d, t in docs for i, s in sets.items() if s and len(s & shingles(t)) >= 0.8 * len(s)}
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {d for d, _ in want} >= {10_000, 10_004}
    left = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert left.columns == table(spark, []).columns


def test_sketch_cannot_miss(spark):
    rng = random.Random(3)
    text = " ".join(f"w{k}" for k in range(40))
    words = text.split()
    docs = []
    for k in range(60):
        w = list(words)
        w[rng.randrange(40)] = "zzz"
        docs.append((k, "pre fix " * 300 + " ".join(w) + " post fix" * 300))
    item = shingles(text)
    want = {d for d, t in docs if len(item & shingles(t)) >= 0.8 * len(item)}
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == want and want


def test_decontaminate_odd(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, "two words")], "item_id long, text string")
    got = decontaminate.contaminated(table(spark, ODD), items).collect()
    assert [(r["doc_id"], r["item_id"], r["n_found"], r["containment"]) for r in got] == [(5, 3, 2, 1.0)]
    assert decontaminate.contaminated(table(spark, []), items).count() == 0
    assert decontaminate.contaminated(table(spark, ODD), items.limit(0)).count() == 0


def test_decontaminate_finds_items_shorter_than_a_shingle(spark):
    items = [(1, "capital of France"), (2, "Zebra!"), (3, "one two three four"), (4, "one two three four five six"), (5, "...")]
    docs = [(1, "the Capital, of france is"), (2, "capital france of"), (3, "a zebra"), (4, "zebras"), (5, "one two three four five"), (6, "zebra capital of france one two three four five six")]

    def own(text, n):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    size = {i: min(5, len(re.findall(r"[^\W_]+", t))) for i, t in items}
    want = set()
    for d, text in docs:
        for i, t in items:
            if size[i] and len(own(t, size[i]) & own(text, size[i])) >= 0.8 * len(own(t, size[i])):
                want.add((d, i))
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want == {(1, 1), (3, 2), (5, 3), (6, 1), (6, 2), (6, 3), (6, 4)}
    left = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), least_words=4)
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4}


# 2, 4: tokens -------------------------------------------------------------------------------------
def encoded(words, texts):
    ids, ends = words.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_encoder_equals_whole_text(spark, path, drops):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [t for _, t in documents(spark, 60)] + [
        "", " ", "  ", "a  b", "a \n b", "\n \n", " lead", "trail ", "tab\t x", "a  b", "don't we'll", "x  y", "é ́e", "ΣΑΣ ΣΑΣ", "<|endoftext|> a<|startoftext|>", "漢字 かな", "a\r\n b", "\u0085 z", "1234 5,6",
    ]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["a", "B", " ", " ", "\n", "\t", "'s", "1", ".", "é", "　", "́"]) for _ in range(30)) for _ in range(400)]
    latin = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250))]
    texts += [" ".join("".join(rng.choice(latin) for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    texts += [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    for text, got in zip(texts, encoded(Encoder(path, drops), texts), strict=True):
        assert got == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_worker_encoder_equals_plain_tokenizer(spark, path, drops):
    plain = Tokenizer.from_file(path)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", " ", "\n", "a", "Word", "\u0338", "."]
    rng = random.Random(3)
    texts = [t for _, t in documents(spark, 30)] + ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|> z"]
    texts += ["".join(rng.choice(marks) for _ in range(12)) for _ in range(300)]
    for text, got in zip(texts, encoded(encoder(path, drops), texts), strict=True):
        assert got == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
@pytest.mark.parametrize("case", ["as it is", "one hash for all", "small slices", "forgets", "grows"])
def test_encoder_in_tight_places(monkeypatch, path, drops, case):
    """Spans that share a hash, that lie on the border of two slices, and a table that is emptied or enlarged."""
    if case == "one hash for all":
        monkeypatch.setattr(tokens.SpanTable, "mix", lambda self, keys: keys[0] * 0 + 5)
    if case == "small slices":
        monkeypatch.setattr(tokens, "SLICE", 7)
        monkeypatch.setattr(tokens, "CHUNK", 5)
    if case == "forgets":
        monkeypatch.setattr(tokens, "CACHE", 50)
    rng = random.Random(case)
    marks = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x1c", "\x1f", "\x00", "\u0085", "\u00a0", "\u2003", "\u3000", "'s", "'", "a", "Bc", "'Ll", "1", "23", ".", ",", "<", "=", "\u0338", "\u0301", "é", "É", "×", "÷", "Σ", "İ", "ß", "ÿ", "漢字", "😀", "<|endoftext|>", "_", "-" * 30, "x" * 23, "y" * 24, "z" * 130]
    plain, words = Tokenizer.from_file(path), Encoder(path, drops, spells_added=False)
    for _ in range(12):
        texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(60)]
        if case == "grows":
            texts = [" ".join("".join(rng.choices("aeinrst", k=6)) for _ in range(900)) for _ in range(6)]
        for text, got in zip(texts, encoded(words, texts), strict=True):
            assert got == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert case != "grows" or words.table.n > 1 << 15


def test_encoder_takes_nulls_and_slices():
    words = encoder(BYTE, False)
    texts = pa.array(["left out", None, "", "a b", None])[1:]
    ids, ends = words.encode(texts)
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode("a b").ids and ends.tolist() == [0, 0, 2, 2]
    assert words.encode_ended(texts, 2)[0].tolist() == [2, 2, *ids.tolist(), 2, 2]
    assert [len(x) for x in words.encode(pa.array([], pa.string()))] == [0, 0]
    assert [len(x) for x in words.encode(pa.array([None], pa.string()))] == [0, 1]
    many = pa.array(["x" * 1000, None, ""] * 10_000)
    cuts = list(tokens.spread(many))
    assert len(cuts) > 1 and [c.start for c in cuts] == [0, *[c.stop for c in cuts[:-1]]] and cuts[-1].stop == len(many)


def test_packing_and_tables_keep_added_tokens(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "after")]
    path = scratch_path(spark, "t")
    got = sorted(sorted_table.read_tables(sorted_table.write_tables(table(spark, rows), path, WORD, files=1), path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["ids"][:-1]) for r in got] == [(1, 0, [320, 49407, 321]), (2, 4, Tokenizer.from_file(WORD).encode("after", add_special_tokens=False).ids)]
    packed = best_fit.pack(table(spark, rows[:1]), BYTE).collect()
    assert sum(r["length"] for r in packed) == 4 + 1


def test_sorted_table_round_trip(spark):
    rows = documents(spark) + [(-5, "negative id"), *ODD]
    plain = Tokenizer.from_file(WORD)
    path = scratch_path(spark, "t")
    manifest = sorted_table.write_tables(table(spark, rows), path, WORD, files=4)
    got = sorted_table.read_tables(manifest, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    assert sorted_table.read_tables(sorted_table.write_tables(table(spark, []), scratch_path(spark, "t"), WORD), path).count() == 0


def test_sorted_table_refuses_ids_beyond_16_bits(spark, tmp_path):
    with open(WORD, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["vocab"]["toolarge</w>"] = 70_000
    large = tmp_path / "large.json"
    large.write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(Exception, match="more than 16 bits"):
        sorted_table.write_tables(table(spark, [(1, "a")]), scratch_path(spark, "t"), str(large)).collect()


def test_sorted_table_lookup(tmp_path):
    keys = [None, *sorted(random.Random(2).sample(range(-10_000, 10_000), 3000)), 20_000, 20_000]
    with open(tmp_path / "x.sst", "wb") as out:
        writer = sorted_table.TableWriter(out, 2)
        for k in keys:
            writer.add(sorted_table.pack_key(k), ((k or 0) % 65536).to_bytes(2, "little") * 40)
        writer.close()

    class File:
        def __init__(self, f):
            self.f, self.seek, self.read = f, f.seek, f.read

        def size(self):
            return self.f.seek(0, 2)

    with open(tmp_path / "x.sst", "rb") as f:
        reader = sorted_table.TableReader(File(f))
        assert len(reader.index) > 2 and reader.n_docs == len(keys)
        for k in keys[:400]:
            assert reader.get(k) == [((k or 0) % 65536).to_bytes(2, "little") * 40]
        assert len(reader.get(20_000)) == 2
        assert not any(reader.get(k) for k in range(30_000, 31_000))
        assert [sorted_table.unpack_key(k) for k, _ in reader.scan()] == keys


# 3 ------------------------------------------------------------------------------------------------
def test_shard_table(spark):
    names = shard_lookup.names(7)
    table_ = shard_lookup.fill_table(names, 1009)
    share = Counter(table_)
    assert max(share.values()) - min(share.values()) <= 1 and len(share) == 7
    fewer = shard_lookup.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table_, fewer, strict=True) if a != 6)
    assert moved < 0.15 * 1009
    # turn by turn with whole preference lists
    lists = []
    for s in names:
        at, step = shard_lookup._hash(s, "offset", 1009), shard_lookup._hash(s, "step", 1008) + 1
        lists.append([(at + k * step) % 1009 for k in range(1009)])
    slow = {}
    while len(slow) < 1009:
        for k, order in enumerate(lists):
            free = [x for x in order if x not in slow]
            if free:
                slow[free[0]] = k
    assert [slow[k] for k in range(1009)] == table_
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError, match="prime"):
            shard_lookup.fill_table(bad, 1009)
    got = shard_lookup.place(table(spark, ODD).withColumn("slot", F.lit("mine")), names, size=1009).collect()
    assert len(got) == len(ODD) and all(r["shard"] == names[table_[r["slot"]]] for r in got)


def test_write_shards(spark):
    docs = table(spark, [(k, f"t{k % 3}") for k in range(100)])
    path = scratch_path(spark, "shards")
    shard_lookup.write_shards(docs, path, shard_lookup.names(3), key="text")
    back = spark.read.parquet(path)
    assert back.count() == 100
    assert back.select("text", "shard").distinct().count() == 3


# 4 ------------------------------------------------------------------------------------------------
def slow_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 1024])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, max(1, capacity // 5)) for _ in range(rng.choice([1, 40, 900]))]
    rows = best_fit.plan(Counter(lengths), capacity)
    used = Counter()
    for n, count in Counter(lengths).items():
        own = sorted(r for r in rows if r[0] == n)
        for rank in range(count):
            _, first, per, sequence, offset = [r for r in own if r[1] <= rank][-1]
            at = (sequence + (rank - first) // per, offset + (rank - first) % per * n)
            for k in range(at[1], at[1] + n):
                used[at[0], k] += 1
    assert max(used.values()) == 1
    full = Counter(s for s, _ in used)
    assert all({k for s, k in used if s == seq} == set(range(n)) for seq, n in list(full.items())[:40])
    assert sorted(capacity - n for n in full.values()) == slow_best_fit(lengths, capacity)


def test_pack(spark):
    rows = documents(spark, 80) + ODD
    plain = Tokenizer.from_file(BYTE)
    got = best_fit.pack(table(spark, rows), BYTE, keep_ids=True).collect()
    by_id = Counter()
    for r in got:
        by_id[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        assert r["length"] == 1024 or r["piece"] == 0
    want = Counter()
    for d, t in rows:
        want[d] += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    assert by_id == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(seqs) == len(slow_best_fit([r["length"] for r in got], 1024))
    assert best_fit.pack(table(spark, []), BYTE).count() == 0


def test_pack_over_many_tasks(spark, monkeypatch):
    rows = [(k, "a b c " * (k % 7)) for k in range(200)]
    docs = table(spark, rows).repartition(5)
    for broadcast in (2000, 0):  # sums of the tasks' counts: broadcast, joined by a shuffle
        monkeypatch.setattr(best_fit, "BROADCAST_TASKS", broadcast)
        got = best_fit.pack(docs, BYTE).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(200))
        ends = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert len(ends) == len(slow_best_fit([r["length"] for r in got], 1024))


# 5 ------------------------------------------------------------------------------------------------
def slow_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    name = {d: d for d in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    inverted = {}
    for d in ids:
        for s in sets[d]:
            inverted.setdefault(s, []).append(d)
    pairs = {(a, b) for own in inverted.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_rows(spark):
    rng = random.Random(5)
    rows = documents(spark)
    base = rows[3][1].split()
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(w)))
    rows += [(6000, rows[5][1].upper()), (6001, "a b"), (6002, "A  B"), (6003, "a"), (6004, ""), (6005, None), (6006, " \n")]
    return rows


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 1000), (5, 80, 1000), (3, 85, 40)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rows = near_rows(spark)
    got = near_dedup.near_duplicates(table(spark, rows), words, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == slow_components(rows, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_multi_index_finds_all_under_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    for chunks, symbols in near_dedup.LAYOUT.values():
        signer = near_dedup.Signer(chunks, symbols)
        for _ in range(300):
            a = rng.integers(0, 2**16, signer.n, "u2")
            b = a.copy()
            b[rng.choice(signer.n, 2 * chunks - 1, replace=False)] ^= np.uint16(1)
            one, other = signer.keys(np.stack([a, b]))
            assert set(one) & set(other)


@pytest.mark.parametrize(("percent", "chunks", "symbols"), [(p, *x) for p, x in near_dedup.LAYOUT.items()])
def test_layout_misses_one_in_a_million(percent, chunks, symbols):
    s = percent / 100
    assert (1 - s**symbols - symbols * s ** (symbols - 1) * (1 - s)) ** chunks < 1.01e-6


def test_signatures_estimate_resemblance():
    import numpy as np

    rng, signer = np.random.default_rng(2), near_dedup.Signer(13, 8)
    alike = []
    for _ in range(200):
        s = rng.integers(0, 2**64, 460, "u8", endpoint=False)
        alike.append((signer.signature(s[:400]) == signer.signature(s[60:])).mean())
    assert abs(np.mean(alike) - 340 / 460) < 0.01


def templated(rng, n, own):
    """Texts that share a template but for so many words, resemblance 0.2 to 0.4 by 3-word shingles."""
    frame = [f"t{k}" for k in range(60)]
    return [(k, " ".join([*frame, *[f"w{rng.randrange(10**9)}" for _ in range(own)]])) for k in range(n)]


def test_unlike_texts_seldom_meet(spark, monkeypatch):
    """20,000 texts that share a third of their shingles are no cluster."""
    met = []
    real = near_dedup.unconnected
    monkeypatch.setattr(near_dedup, "unconnected", lambda *a: met.append(real(*a)) or met[0])
    rows = templated(random.Random(8), 20_000, 60)
    rows += [(30_000 + k, t + " more") for k, t in rows[:50]]
    got = near_dedup.near_duplicates(table(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 30_000 for i, _ in rows}
    assert met[0].count() < 100


def test_large_group_costs_one_comparison_each(spark, monkeypatch):
    """5,000 near copies of a text and some others: only the others meet blocks, in number by the group's size."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 200)
    seen = []
    real = near_dedup.block_links
    monkeypatch.setattr(near_dedup, "block_links", lambda docs, members, *a: seen.append(near_dedup.blocks(members).count()) or real(docs, members, *a))
    rng, base = random.Random(9), [f"b{k}" for k in range(150)]
    rows = []
    for k in range(5000):
        w = list(base)
        w[rng.randrange(150)] = f"e{k}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(table(spark, rows), 3, 85).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 5000
    assert seen[0] < 5000


def test_near_dedup_odd(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, ODD)).collect()}
    assert (None, 1, None, True) in got and (1, 0, 1, True) in got and (5, 2, 5, True) in got
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    left = near_dedup.drop_near_duplicates(table(spark, [*ODD, (9, "a b c d e f")]))
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _ in ODD)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)]
    name = {x: x for e in links for x in e}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        name[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in linked}


# 6 ------------------------------------------------------------------------------------------------
def slow_lines(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    where = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < 5 or d == max(where[key(x)])]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("share", [1, 30, 1000])
def test_line_dedup_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)  # no line, some and all go the way of the common ones
    shared = "This LINE is shared by many documents, Éé, and long enough"
    rows = documents(spark) + [(7000 + k, f"own {k}\n\t{shared.upper() if k % 2 else shared} \nÉ{shared}\nend") for k in range(6)] + [(7100, None), (7101, ""), (7102, shared)]
    got = line_dedup.dedup_lines(table(spark, rows))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()} == slow_lines(rows)
    assert set(got.columns) == {*table(spark, []).columns, "n_lines", "n_dropped"}


def test_shards_keep_columns_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x", 5), (None, "b", "y", 6)], "doc_id long, _slot string, _part string, SLOT int")
    got = shard_lookup.place(docs, ["p", "q"], size=7)
    assert got.columns == ["doc_id", "_slot", "_part", "slot", "shard"] and {(r["doc_id"], r["_slot"], r["_part"]) for r in got.collect()} == {(1, "a", "x"), (None, "b", "y")}
    shard_lookup.write_shards(docs, str(tmp_path / "s"), ["p", "q"], files=2)
    assert {(r["_slot"], r["_part"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", "x"), ("b", "y")}


def test_line_dedup_odd(spark):
    line = "the same line of more than forty characters, really"
    rows = [*ODD, *[(k, line) for k in range(20, 25)], (None, line), (24, line), (21, f"x\n{line}")]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert {(20, 1, 1, ""), (24, 1, 0, line), (None, 1, 0, line), (21, 2, 1, "x"), (1, 1, 0, ""), (7, 3, 0, "\n\n")} <= got
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# 7 ------------------------------------------------------------------------------------------------
def test_fingerprints(spark):
    rows = documents(spark) + [(9000, ""), (9001, None), (9002, "one"), (9003, "one"), (9004, "one two three four five six seven")]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(table(spark, rows).repartition(5)).collect()}
    order = sorted((d, t or "") for d, t in rows)
    sketch = fingerprints.Sketcher()
    true, estimated = [], []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["fingerprint"] == sketch.pack(sketch.values(t)) and got[d]["edited_fingerprint"] == sketch.pack(sketch.values(edited))
        a, b = (set(sketch.shingles(x).tolist()) for x in (t, edited))
        if len(a) > 30:
            true.append(len(a & b) / len(a | b))
            estimated.append(got[d]["near_edited"])
    assert sum(abs(a - b) for a, b in zip(true, estimated, strict=True)) / len(true) < 0.05
    assert abs(sum(true) - sum(estimated)) / len(true) < 0.02  # the correction leaves no bias
    assert got[9002]["fingerprint"] == got[9003]["fingerprint"] and got[9002]["near_next"] == 1.0
    assert sketch.pack(sketch.unpack(got[9004]["fingerprint"])) == got[9004]["fingerprint"]


def test_fingerprints_odd(spark):
    assert fingerprints.compare_edited(table(spark, ODD)).count() == len(ODD)
    assert fingerprints.compare_edited(table(spark, [])).count() == 0
    one = fingerprints.compare_edited(table(spark, [(1, "abcdefgh")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.compare_edited(table(spark, [(None, "a"), (None, "b")])).count() == 2
    assert fingerprints.fingerprints(table(spark, ODD)).count() == len(ODD)


# 8 ------------------------------------------------------------------------------------------------
def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string")) % 4 != 0
    known = docs.join(labels.filter(~seen), "doc_id").select("doc_id", "text", F.col("toxic").alias("y"))
    got = toxicity.score(known, toxicity.train_chain(docs, labels.filter(seen)), list(toxicity.CATEGORIES))
    rows = got.join(labels, "doc_id").select("p_toxic", "toxic", "quality").collect()
    clean = [r for r in rows if not r["toxic"]]
    bad = [r for r in rows if r["toxic"] and r["quality"]]
    assert sum(r["p_toxic"] >= 0.5 for r in bad) / len(bad) > 0.9
    assert sum(r["p_toxic"] >= 0.5 for r in clean) / len(clean) < 0.01


def test_toxicity_sample_is_whole(spark):
    labels = spark.range(6500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.lit("some words").alias("text"))
    got = toxicity.sample_labelled(docs, labels, toxicity.CATEGORIES).collect()
    assert Counter(r["y"][1] for r in got) == {1: 2000, 0: 4000}


def test_toxicity_chooses_as_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    sample = toxicity.sample_labelled(docs, labels, toxicity.CATEGORIES)
    rows = sample.collect()
    per_fold = {f: (sum(r["fold"] == f for r in rows), [sum(r["y"][k] for r in rows if r["fold"] == f) for k in range(2)]) for f in range(toxicity.FOLDS)}
    sums = toxicity.feature_sums(sample, 2)
    for k in range(2):
        for model, got in toxicity.choose(sums, per_fold, k).items():
            own = [r for r in rows if r["fold"] != model]
            mean = sum(r["y"][k] for r in own) / len(own)
            often, total, square, with_y = Counter(), Counter(), Counter(), Counter()
            for r in own:
                for f, v in zip(r["features"], r["v"], strict=True):
                    often[f] += 1
                    total[f] += v / len(own)
                    square[f] += v * v / len(own)
                    with_y[f] += v * r["y"][k] / len(own)
            strength = {f: abs(with_y[f] - total[f] * mean) / max(square[f] - total[f] ** 2, 1e-12) ** 0.5 for f in often if often[f] >= 3}
            best = sorted(strength.values(), reverse=True)[: toxicity.SELECTED]
            assert len(got) == len(best) and got == sorted(set(got))
            assert sorted((strength[f] for f in got), reverse=True) == pytest.approx(best, abs=1e-4)


def test_toxicity_scores_as_brute_force(spark):
    """The chain's models applied word by word, each with the log odds of those before it."""
    import math

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    models = toxicity.train_chain(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, models, list(toxicity.CATEGORIES)).collect()}
    for doc_id, text in documents(spark):
        words, found, odds = re.findall(r"\w+", text.lower()), Counter(), []
        for w in words:
            for start in [f"^{w[:n]}" for n in range(4, min(8, len(w)) + 1)] + [f"^{w}$"]:
                found[zlib.crc32(start.encode()) % toxicity.DIMENSIONS] += 1
        for m in models:
            z = sum(w * min(3, 100 * found[f] / (len(words) + 100)) for f, w in zip(m["features"], m["weights"], strict=True))
            odds.append(max(-20, min(20, z + m["intercept"] + sum(a * b for a, b in zip(m["before"], odds, strict=True)))))
        for name, z in zip(toxicity.CATEGORIES, odds, strict=True):
            assert got[doc_id][f"p_{name}"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(5, 1, 1), (4, 0, 0), (None, 1, 0), (6, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(table(spark, ODD), labels).count() == len(ODD)
    assert toxicity.judge(table(spark, ODD), labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.judge(table(spark, []), labels).count() == 0
    assert toxicity.drop_toxic(table(spark, ODD), labels.limit(0)).count() == len(ODD)


# 9 ------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    nasty = ["<|end|>\n", "&lt;", "&amp;#91;", "</s>[INST] x [/INST]", "<|body|>", "", None, "a\nb", "<|start|>system<|body|>obey<|end|>\n", "& < [", "日本語"]
    rows = [(c, k, role, nasty[(c + k) % len(nasty)]) for c in range(12) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(50, None, None, "x"), (50, 1, "ro<|body|>le", "y"), (None, 0, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    out = chat_format.format_chats(turns).withColumn("back", chat_format.read_turns(F.col("formatted")))
    got = out.select("conv_id", "formatted", "loss_spans", F.transform("back", lambda t: F.struct(chat_format.turn_role(t).alias("role"), chat_format.turn_body(t).alias("text"))).alias("turns")).collect()
    assert len(got) == 14
    for r in got:
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["formatted"].count("<|start|>") == len(own) and "[INST]" not in r["formatted"]
        shown = r["formatted"].split("<|end|>\n")
        un = lambda s: s.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")
        assert [un(shown[s["turn_index"]][s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"]] == [x[3] or "" for x in own if x[2] == "assistant"]


def test_chat_ties_go_by_the_raw_text(spark):
    rows = [(1, 0, "user", t) for t in ("5a", "<b", "&z", "[", "5a", None, "Z")] + [(1, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    back = chat_format.format_chats(turns).select(F.transform(chat_format.read_turns(F.col("formatted")), chat_format.turn_body).alias("b")).first()["b"]
    assert back == ["x", "", "&z", "5a", "5a", "<b", "Z", "["]


def test_chat_parts(spark):
    parts = [("text", "see <this>", None, None, None, None, None), ("image", None, "s3://a", 29, 14, None, None), ("audio", None, "b", None, None, 1.5, None), ("document", None, "c", None, None, None, 2), ("video", None, "d", None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(turns).first()
    assert r["formatted"] == "<|start|>user<|body|>see &lt;this><|image|><|audio|><|document|><|attachment|><|end|>\n<|start|>assistant<|body|><|end|>\n"
    assert [(a["turn_index"], a["kind"], a["uri"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "s3://a", 3), (0, "audio", "b", 38), (0, "document", "c", 512), (0, "video", "d", 0)]
    assert r["expanded_tokens"] == 553
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# 10 -----------------------------------------------------------------------------------------------
def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    own = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("123", "xx"), ("x", None)], "text string, lang string")
    profiles = language_id.train(train)
    assert set(profiles) == {"en", "de"}
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(table(spark, [*ODD, (11, "1 2 3"), (12, "the the the")]), profiles).collect()]
    assert {(1, "und"), (2, "und"), (11, "und"), (12, "en")} <= set(got)
    signs = [(1, "²½"), (2, "①Ⅳ"), (3, "_ 12 ٣"), (4, "ª"), (5, "½ the")]
    assert [r["lang_pred"] == "und" for r in language_id.identify(table(spark, signs), profiles).orderBy("doc_id").collect()] == [True, True, True, False, False]
    assert language_id.identify(table(spark, []), profiles).count() == 0
    assert language_id.train(train.limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.identify(table(spark, ODD), {}).collect()} == {"und"}


def test_profile_equals_brute_force(spark):
    rows = [(t, "en") for _, t in documents(spark, 40)]
    count = Counter()
    for t, _ in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            m = f" {w} "
            count.update(w)
            count.update(m[k : k + 2] for k in range(len(m) - 1))
            count.update(m[k : k + 3] for k in range(len(m) - 2))
    codes = {sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g)): n for g, n in count.items()}
    want = sorted(codes, key=lambda g: (-codes[g], g))[: language_id.PROFILE]
    assert language_id.train(spark.createDataFrame(rows, "text string, lang string")) == {"en": want}


def test_prediction_equals_brute_force(spark):
    """Out-of-place distances, of equally near languages the first by name."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = language_id.train(docs)
    profiles["zz"] = profiles["en"]
    n = language_id.PROFILE
    for r, (doc_id, text) in zip(language_id.identify(table(spark, documents(spark)), profiles).orderBy("doc_id").collect(), documents(spark), strict=True):
        count = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            m = f" {w} "
            for size, of in ((1, w), (2, m), (3, m)):
                count.update(sum(ord(c) << (21 * (size - 1 - k)) for k, c in enumerate(of[i : i + size])) for i in range(len(of) - size + 1))
        own = sorted(count, key=lambda g: (-count[g], g))[:n]
        far = {lang: sum(min(abs(p.index(g) - k), n) if g in p else n for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert (r["doc_id"], r["lang_pred"]) == (doc_id, best if own else "und")
        assert r["score"] == pytest.approx(1 - far[best] / (n * len(own)) if own else 0)


def test_letters_of_a_long_text_are_found_quickly(spark):
    """Numbers that are no decimal digits are cut out of the words that hold them; words of letters take the plain pattern alone."""
    assert language_id.letters("a²b Ⅷx ½ É_i 漢字7") == " a b x é i 漢字 "
    text = (" ".join(t or "" for _, t in documents(spark)) * 5)[:1_000_000]
    took = []
    for find in (language_id.letters, lambda t: re.findall(r"[^\W\d_]+", t.lower())):
        began = time.process_time()
        find(text)
        took.append(time.process_time() - began)
    assert took[0] < 5 * took[1] + 0.05
