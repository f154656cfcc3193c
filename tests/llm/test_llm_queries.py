"""Each operator's registered query on a folder of crafted tables: the contract's columns, types and values."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import xxhash
from auditspark import llm
from pyspark.sql import functions as F
from tests.llm.test_conversation_repair import slow_query
from tests.llm.test_ops import documents, slow_best_fit, slow_components
from tests.llm.test_simhash import slow_components as slow_simhash
from tokenizers import Tokenizer

TYPES = {
    "op1_decontaminate": "doc_id bigint, item_id bigint, n_item_shingles bigint, n_found bigint, containment double",
    "op2_sorted_table": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_shard_lookup": "doc_id bigint, slot int, shard string",
    "op4_best_fit": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_toxicity": "doc_id bigint, p_low_quality double, p_toxic double, toxic boolean",
    "op9_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def crafted(spark, tmp_path_factory):
    """(folder, texts by id): some real documents, copies, odd texts; nulls in every column that is not an id."""
    rng = random.Random(6)
    own = [(i, t) for i, t in documents(spark, 50)]
    line = "A line that stands in a number of documents, more or less: İ."
    odd = [None, "", " ", "\n\n", "²½", "word", "Word  word\tword", "é" * 3000, "<|endoftext|> a <|startoftext|>", "one\u00a0two\u2003 three", own[3][1], own[3][1].upper(), own[4][1] + " and more"]
    odd += [f"  {line}  \nown line {k}\n{line.upper() if k % 2 else line}" for k in range(6)]
    rows = own + [(10_000 + 7 * k, t) for k, t in enumerate(odd)]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("crafted"))
    real = "/root/testdata/sf0.001"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{real}/documents.parquet").collect()}
    docs = spark.createDataFrame([(i, t, langs.get(i), None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{real}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(10_000, None, 1), (10_007, 0, None)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(t) for c, t in labels.dtypes])).write.parquet(f"{folder}/labels.parquet")
    items = spark.read.parquet(f"{real}/benchmark.parquet").select("item_id", "text")
    items.unionByName(spark.createDataFrame([(900, None), (901, "word"), (902, own[5][1][:120]), (903, "")], "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    turns = [(1, 0, "user", "<b"), (1, 0, "user", "5a"), (1, 0, "user", "5a"), (1, 1, "assistant", "&amp;<|end|>\n["), (1, 2, "assistant", None), (2, None, None, "x"), (3, 0, "assistant", ""), (None, 0, "user", "z")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, dict(rows)


def run(spark, name, crafted):
    df = llm.queries()[name](spark, crafted[0])
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == TYPES[name]
    return df.collect()


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_line_dedup", "op9_chat_format", "op12_ranked_search"])
def test_equals_sql(spark, crafted, name):
    got = run(spark, name, crafted)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{crafted[0]}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got[0].asDict())} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and got


def ids_of(file, text):
    return [*Tokenizer.from_file(public_tokenizers.path(file)).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_op2(spark, crafted):
    got, start, want = run(spark, "op2_sorted_table", crafted), 0, []
    for i, t in sorted(crafted[1].items()):
        ids = ids_of("word_bpe_49k.json", t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got)) == want


def test_op3(spark, crafted):
    """Slots by XXH64 of the id, shards by their turns at claiming slots in the order that each prefers."""
    got = run(spark, "op3_shard_lookup", crafted)
    size, names = 65_537, [f"shard-{k:05d}" for k in range(64)]
    number = lambda name, salt, below: int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big") % below

    def prefers(name):
        at, step = number(name, "offset", size), number(name, "step", size - 1) + 1
        return ((at + j * step) % size for j in range(size))

    order, slots = [prefers(n) for n in names], {}
    while len(slots) < size:
        for name, own in zip(names, order, strict=True):
            if len(slots) < size:
                slots[next(at for at in own if at not in slots)] = name
    hashed = {i: xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) for i in crafted[1]}
    signed = lambda h: h - 2**64 if h >> 63 else h
    assert sorted(map(tuple, got)) == sorted((i, signed(h) % size, slots[signed(h) % size]) for i, h in hashed.items())


def test_op4(spark, crafted):
    got, want = run(spark, "op4_best_fit", crafted), []
    for i, t in crafted[1].items():
        ids, k, at = ids_of("byte_bpe_50k.json", t), 0, 0
        while at < len(ids):
            n = (len(ids) - at - 1) % 1024 + 1 if not k else 1024
            want.append((i, k, at, n, crc(ids[at : at + n])))
            k, at = k + 1, at + n
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(places) == len(slow_best_fit([r["length"] for r in got], 1024))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_op5(spark, crafted):
    want = slow_components(list(crafted[1].items()), 3, 85)
    got = run(spark, "op5_near_dedup", crafted)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op7(spark, crafted):
    got, order = {r["doc_id"]: r for r in run(spark, "op7_fingerprints", crafted)}, sorted(crafted[1])
    for k, i in enumerate(order):
        text, after = crafted[1][i] or "", crafted[1][order[(k + 1) % len(order)]] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    same = [i for i in order if crafted[1][i] == crafted[1][3]] if 3 in crafted[1] else []
    assert len({got[i]["fingerprint"] for i in same}) <= 1


def test_op8(spark, crafted):
    got = run(spark, "op8_toxicity", crafted)
    assert sorted(r["doc_id"] for r in got) == sorted(crafted[1]) and all(0 <= r["p_toxic"] <= 1 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in got)


def test_op10(spark, crafted):
    got = {r["doc_id"]: r for r in run(spark, "op10_language_id", crafted)}
    assert sorted(got) == sorted(crafted[1])
    for i, t in crafted[1].items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))


def test_op11(spark, crafted):
    got = run(spark, "op11_simhash", crafted)
    assert sorted(map(tuple, got)) == [(i, f"{p:016x}", c) for i, p, c in slow_simhash(list(crafted[1].items()))]


def test_op13(spark, crafted):
    rows = [tuple(r) for r in spark.read.parquet(f"{crafted[0]}/conversations.parquet").collect()]
    got = [tuple(r) for r in run(spark, "op13_conversation_repair", crafted)]
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)) == slow_query(rows)
