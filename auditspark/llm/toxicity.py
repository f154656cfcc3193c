"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions on the beginnings of words; each model but
the first also sees the log odds of the categories before it. In training these come from out-of-fold
models, so that a later model learns from predictions such as it will meet, not from fitted ones.

The models are fitted on a bounded sample of labelled documents (POSITIVES and NEGATIVES of the last category,
the smallest by a hash of the id); everything else covers all rows. Spark sums up what each feature is worth to each
model, so a worker that fits one holds the columns of the chosen features alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.workers import drop
from auditspark.session import materialise, read_table, ship_package

#: Category -> its label as an expression on the labels table, in chain order.
CATEGORIES = {"low_quality": "CAST(quality = 0 AS INT)", "toxic": "CAST(toxic = 1 AS INT)"}
POSITIVES, NEGATIVES, FOLDS = 2000, 4000, 3
#: Hashed features, those a model keeps, the strength of its penalty, and the probability that rejects.
DIMENSIONS, SELECTED, PENALTY, THRESHOLD = 1 << 20, 800, 2.0, 0.5
#: Feature values are summed up as whole numbers of this part, so that no order of the rows shows in the sums.
GRAIN = 1_000_000
#: Words whose features a worker keeps.
CACHE = 300_000


def word_list(text: str | None) -> list[str]:
    import re

    return re.findall(r"\w+", (text or "").lower())


def word_features(word: str) -> list[int]:
    """The word, and its beginnings of 4 to 8 letters, hashed."""
    starts = [f"^{word[:n]}" for n in range(4, min(8, len(word)) + 1)]
    return [zlib.crc32(s.encode()) % DIMENSIONS for s in (*starts, f"^{word}$")]


def values(counts, n_words: int):
    """What a count among so many words is worth: the rate a hundred words, damped for short texts, at most 3."""
    import numpy as np

    return np.minimum(3, 100 * np.asarray(counts, "f4") / (n_words + 100))


def fit(x, y, extra):
    """A logistic regression by Newton steps. x: a column for each chosen feature; extra: further columns.

    -> (weights, intercept, weights of extra).
    """
    import numpy as np

    mean, m = y.mean(), x.shape[1]
    if mean in (0.0, 1.0):
        return np.zeros(m), -20.0 if mean == 0 else 20.0, np.zeros(extra.shape[1])
    x = np.hstack([x, extra, np.ones((len(y), 1))], dtype="f8")
    w = np.zeros(x.shape[1])
    w[-1] = np.log(mean / (1 - mean))
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:m], float(w[-1]), w[m:-1]


def sample_labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(doc_id, fold, y array<int>, features array<int>, v array<float>): the bounded sample."""
    last = len(categories) - 1
    known = labels.select("doc_id", F.array(*[F.expr(e) for e in categories.values()]).alias("y")).filter(
        F.col("doc_id").isNotNull() & ~F.exists("y", lambda v: v.isNull())
    ).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = lambda y, n: known.filter(F.get("y", F.lit(last)) == y).orderBy(*order).limit(n)
    # bounded by POSITIVES + NEGATIVES
    chosen = materialise(some(1, POSITIVES).unionByName(some(0, NEGATIVES)), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))

    def featurise(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = word_list(text.as_py())
                found = Counter()
                for w, k in Counter(words).items():
                    for f in word_features(w):
                        found[f] += k
                out.append((list(found), values(list(found.values()), len(words)).tolist()))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(cols, (pa.list_(pa.int32()), pa.list_(pa.float32())), strict=True)]], names=["doc_id", "y", "features", "v"])

    made = texts.mapInArrow(featurise, "doc_id long, y array<int>, features array<int>, v array<float>")
    return materialise(made.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "featurised")


def feature_sums(sample: DataFrame, categories: int) -> DataFrame:
    """(feature, and for each fold f: often_f, total_f, square_f, and with_k_f for each category k): how many documents
    have the feature, and the sums of its values, their squares, and the values where the category holds."""
    each = sample.select("fold", "y", F.explode_outer(F.arrays_zip("features", "v")).alias("e")).filter("e IS NOT NULL")
    each = each.select("fold", "y", F.col("e.features").alias("feature"), F.round(F.col("e.v").cast("double") * GRAIN).cast("long").alias("q"))
    sums = []
    for f in range(FOLDS):
        of = lambda c, f=f: F.coalesce(F.sum(F.when(F.col("fold") == f, c)), F.lit(0))
        sums += [of(F.lit(1)).alias(f"often_{f}"), of(F.col("q")).alias(f"total_{f}"), of(F.col("q") * F.col("q")).alias(f"square_{f}")]
        sums += [of(F.col("q") * F.get("y", F.lit(k))).alias(f"with_{k}_{f}") for k in range(categories)]
    return materialise(each.groupBy("feature").agg(*sums), "sums")


def choose(sums: DataFrame, per_fold: dict[int, tuple[int, list[int]]], k: int) -> dict[int, list[int]]:
    """The features, in order, that correlate best with category k on the rows of each model: all folds but one, or
    all (-1). per_fold: fold -> (documents, those of each category)."""
    best = []
    for model in range(-1, FOLDS):
        folds = [f for f in range(FOLDS) if f != model]
        n = sum(per_fold.get(f, (0, []))[0] for f in folds)
        yes = sum(per_fold[f][1][k] for f in folds if f in per_fold)
        if yes in (0, n):
            continue
        mean = lambda c, folds=folds, n=n: sum((F.col(f"{c}_{f}") for f in folds), F.lit(0)).cast("double") / n
        total = mean("total") / GRAIN
        spread = F.sqrt(F.greatest(mean("square") / GRAIN / GRAIN - total * total, F.lit(1e-12)))
        strength = F.abs(mean(f"with_{k}") / GRAIN - total * (yes / n)) / spread
        often = sum((F.col(f"often_{f}") for f in folds), F.lit(0))
        own = sums.filter(often >= 3).select(F.lit(model).alias("model"), "feature", strength.alias("strength")).filter("strength > 0")
        best.append(own.orderBy(F.desc("strength"), "feature").limit(SELECTED))
    chosen: dict[int, list[int]] = {m: [] for m in range(-1, FOLDS)}
    for own in best:
        for r in own.collect():  # SELECTED rows
            chosen[r["model"]].append(r["feature"])
    return {m: sorted(fs) for m, fs in chosen.items()}


def narrow(sample: DataFrame, chosen: dict[int, list[int]]) -> DataFrame:
    """A row of sample (with odds) for each model: (model, doc_id, fold, y, odds, places binary, v binary), the
    features as places among those chosen for the model."""
    shared = sample.sparkSession.sparkContext.broadcast(chosen)  # SELECTED features for each model

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        place = {}
        for m, features in shared.value.items():
            place[m] = np.full(DIMENSIONS, -1, "i2")
            place[m][features] = np.arange(len(features))
        for batch in batches:
            features, v = batch.column(4), batch.column(5)
            found = [(features[i].values.to_numpy(), v[i].values.to_numpy()) for i in range(batch.num_rows)]
            for m, own in place.items():
                places, kept = [], []
                for c, x in found:
                    at = own[c]
                    places.append(at[at >= 0].astype("<i2").tobytes())
                    kept.append(x[at >= 0].astype("<f4").tobytes())
                model = pa.array([m] * batch.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([model, *batch.columns[:4], pa.array(places, pa.binary()), pa.array(kept, pa.binary())], names=["model", "doc_id", "fold", "y", "odds", "places", "v"])

    return sample.select("doc_id", "fold", "y", "odds", "features", "v").mapInArrow(cut, "model int, doc_id long, fold int, y array<int>, odds array<double>, places binary, v binary")


def learner(k: int, chosen: dict[int, list[int]]):
    """The function that fits the chain's model number k on a group: all folds but the one named by `model` (-1:
    none left out), and either returns the model or the log odds of the fold left out."""

    def learn(table):
        import numpy as np
        import pyarrow as pa

        drop()
        model, fold = table.column("model")[0].as_py(), table.column("fold").to_numpy()
        x = np.zeros((table.num_rows, len(chosen[model])), "f4")
        for row, places, v in zip(x, table.column("places"), table.column("v"), strict=True):
            row[np.frombuffer(places.as_py(), "<i2")] = np.frombuffer(v.as_py(), "<f4")
        y = np.array([y[k] for y in table.column("y").to_pylist()], "f8")
        extra = np.array(table.column("odds").to_pylist(), "f8").reshape(len(y), k)
        use = fold != model
        w, b, w_extra = fit(x[use], y[use], extra[use]) if use.any() else (np.zeros(x.shape[1]), -20.0, np.zeros(k))
        if model < 0:
            return pa.table({"doc_id": pa.array([None], pa.int64()), "odds": pa.array([None], pa.float64()), "model": pa.array([[*chosen[model], *w.tolist(), b, *w_extra.tolist()]], pa.list_(pa.float64()))})
        z = x[~use] @ w + b + extra[~use] @ w_extra
        return pa.table({"doc_id": table.column("doc_id").filter(pa.array(~use)), "odds": pa.array(np.clip(z, -20, 20)), "model": pa.nulls(len(z), pa.list_(pa.float64()))})

    return learn


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES) -> list[dict]:
    """The chain's models, in order: features, weights, intercept, weights of the log odds before.

    Without labelled rows every category gets probability 0. The last category's intercept is shifted from the
    sample's odds to those of all labels.
    """
    ship_package(docs.sparkSession)
    import numpy as np

    sample = sample_labelled(docs, labels, categories)
    earlier = sample.select("doc_id", F.array().cast("array<double>").alias("odds"))
    sums = feature_sums(sample, len(categories))
    of_fold = sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(len(categories))]).collect()
    per_fold = {r["fold"]: (r["n"], [r[f"y{k}"] for k in range(len(categories))]) for r in of_fold}
    models: list[dict] = []
    for k in range(len(categories)):
        chosen = choose(sums, per_fold, k)
        held = narrow(sample.join(earlier, "doc_id"), chosen)
        # each group is the bounded sample
        done = materialise(held.groupBy("model").applyInArrow(learner(k, chosen), "doc_id long, odds double, model array<double>"), "learnt")
        final = done.filter("model IS NOT NULL").select("model").first()
        flat = final["model"] if final else [-20.0, *[0.0] * k]
        m = (len(flat) - 1 - k) // 2
        models.append({"features": [int(f) for f in flat[:m]], "weights": flat[m : 2 * m], "intercept": flat[2 * m], "before": flat[2 * m + 1 :]})
        earlier = earlier.join(done.filter("model IS NULL").select("doc_id", F.col("odds").alias("own")), "doc_id").select("doc_id", F.concat("odds", F.array("own")).alias("odds"))
    label = F.expr(list(categories.values())[-1])
    n = labels.agg(F.sum(label).alias("yes"), F.sum(1 - label).alias("no")).first()
    s = sample.agg(F.sum(F.get("y", F.lit(len(categories) - 1))).alias("yes"), F.count("*").alias("n")).first()
    if n["yes"] and n["no"] and s["yes"] and s["n"] > s["yes"]:
        models[-1]["intercept"] += float(np.log(n["yes"] / n["no"]) - np.log(s["yes"] / (s["n"] - s["yes"])))
    return models


def score(docs: DataFrame, models: list[dict], names: list[str]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, p_<category> double ...): a row for each row.

    Defined results: a null text, like an empty one, has the probabilities of a text without a word; rows that
    share an id are each scored; null ids pass; an empty table gives an empty one; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # SELECTED weights for each category

    def work(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        chain_of = shared.value
        features = sorted({f for m in chain_of for f in m["features"]})
        place = {f: k for k, f in enumerate(features)}
        weights = np.zeros((len(chain_of), len(features)))
        for k, m in enumerate(chain_of):
            weights[k, [place[f] for f in m["features"]]] = m["weights"]
        known: dict[str, tuple] = {}

        def look_up(word):
            if (own := known.get(word)) is None:
                if len(known) > CACHE:
                    known.clear()
                own = known[word] = tuple(place[f] for f in word_features(word) if f in place)
            return own

        for batch in batches:
            odds = np.zeros((len(chain_of), batch.num_rows))
            for k, text in enumerate(batch.column(1)):
                words = word_list(text.as_py())
                found = np.bincount(np.fromiter(chain.from_iterable(map(look_up, words)), "i8"), minlength=len(features))
                z = weights @ values(found, len(words)) if len(features) else np.zeros(len(chain_of))
                before: list[float] = []
                for j, m in enumerate(chain_of):
                    before.append(float(np.clip(z[j] + m["intercept"] + np.dot(m["before"], before), -20, 20)))
                odds[:, k] = before
            p = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in p]], names=["doc_id", *[f"p_{n}" for n in names]])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, " + ", ".join(f"p_{n} double" for n in names))


def judge(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) and labels(doc_id and what the categories name) -> (doc_id, p_<category> ..., and a
    boolean named like the last category: its probability is at least the threshold)."""
    names = list(categories)
    scored = score(docs, train_chain(docs, labels, categories), names)
    return scored.withColumn(names[-1], F.col(f"p_{names[-1]}") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the chain rejects; rows that share an id go together."""
    bad = judge(docs, labels).filter("toxic").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
