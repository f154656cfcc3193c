"""The streaming merge against the batch merge: restarts, repeated batches, what a batch writes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators.records import merge_attempts
from auditspark.sources.tables import versions
from auditspark.streaming import records as S

SCHEMA = "uid long, ordinal long, status string, outcome string"


@pytest.fixture
def folder(tmp_path):
    os.mkdir(tmp_path / "log")
    return str(tmp_path)


def arrive(folder, name, rows):
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(dict(zip(("uid", "ordinal", "status", "outcome"), r, strict=True))) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/log/{name}.json")


def attempts(rng, first, n, keys):
    return [(rng.choice([*range(keys), None]), first + k, rng.choice(["OK", "FAILED"]), rng.choice(["a", "b", None])) for k in range(n)]


def run(spark, folder):
    from pyspark.sql import types as T

    S.stream_records(spark, f"{folder}/log", T._parse_datatype_string(SCHEMA), f"{folder}/state", f"{folder}/mark", "uid", "ordinal", F.col("status") == "OK", ["outcome"]).awaitTermination()


def merged(spark, folder, rows):
    got = {tuple(r) for r in S.current(spark, f"{folder}/state", "uid", "ordinal").collect()}
    want = merge_attempts(spark.createDataFrame(rows, SCHEMA), "uid", "ordinal", F.col("status") == "OK", ["outcome"])
    return got, {tuple(r) for r in want.collect()}


def written(folder, n):
    return sum(os.path.getsize(f"{folder}/state/v={n}/{f}") for f in os.listdir(f"{folder}/state/v={n}") if f.endswith(".parquet"))


def test_restart_and_folding(spark, folder):
    rng = random.Random(1)
    rows = []
    for k in range(3):
        new = attempts(rng, 1000 * k, 150, 60)
        rows += new
        arrive(folder, f"f{k}", new)
        run(spark, folder)  # a query that starts again each time
        got, want = merged(spark, folder, rows)
        assert got == want
        S.fold_versions(spark, f"{folder}/state", "uid")
        assert merged(spark, folder, rows)[0] == want
    assert versions(spark, f"{folder}/state", "base=") == [1, 2] and versions(spark, f"{folder}/state") == [2]


def test_a_batch_that_runs_again(spark, folder):
    """The commit of the last batch is lost, as if the driver had died before it: the batch runs again."""
    rng = random.Random(2)
    rows = attempts(rng, 0, 200, 40)
    arrive(folder, "a", rows[:100])
    arrive(folder, "b", rows[100:])
    run(spark, folder)
    got, want = merged(spark, folder, rows)
    assert got == want and versions(spark, f"{folder}/state") == [0, 1]
    for name in ("1", ".1.crc"):
        os.remove(f"{folder}/mark/commits/{name}")
    run(spark, folder)
    assert merged(spark, folder, rows)[0] == want and versions(spark, f"{folder}/state") == [0, 1]


def test_what_a_batch_writes_follows_the_batch(spark, folder):
    rng = random.Random(3)
    large = [(k, k, rng.choice(["OK", "FAILED"]), f"outcome {rng.random()}") for k in range(20_000)]
    small = [(5, 30_000, "OK", "x"), (7, 30_001, "FAILED", None)]
    arrive(folder, "large", large)
    run(spark, folder)
    arrive(folder, "small", small)
    run(spark, folder)
    assert spark.read.parquet(f"{folder}/state/v=1").count() == 2
    assert written(folder, 1) < written(folder, 0) / 20
    got, want = merged(spark, folder, large + small)
    assert got == want
