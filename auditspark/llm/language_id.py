"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (of 1 to 3 letters, with a mark at either end of a
word) in order of rank, counted over all training documents. A document gets its own ranking; for each of
its n-grams the distance to a language is how far the two ranks are apart, and the longest possible if the
profile lacks it. The language with the least sum is predicted; the score is the share of the longest sum
that the distance leaves.
"""

from __future__ import annotations

import re
import sys
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.workers import drop, spread
from auditspark.session import materialise, read_table, ship_package

#: N-grams of a profile, and of a document's ranking.
PROFILE, LONGEST = 400, 3
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 500_000
UNKNOWN = "und"


#: Runs of what \w takes, but decimal digits and the underscore: letters and other numbers (a superscript two, one half).
RUNS = re.compile(r"[^\W\d_]+").findall


@cache
def numbers_out():
    """Splits a run at its numbers. Slow, as it names them all: for runs that hold one."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    return re.compile(rf"[^{''.join(found)}]+").findall


def letters(text: str) -> str:
    """Lower case, everything but letters (Unicode category L) as a single space, a space at either end."""
    found = RUNS(text.lower())
    if not "".join(found).isalpha():
        found = [w for run in found for w in ((run,) if run.isalpha() else numbers_out()(run))]
    return " " + " ".join(found) + " "


def grams(text: str):
    """(code, count) of the n-grams of a text made by letters(), an n-gram packed into 63 bits. A space stands
    for a word's end and occurs inside no n-gram but there."""
    import numpy as np

    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
    space = c == 32
    shift = np.uint64(21)
    parts = [c[~space]]
    two = (c[:-1] << shift) | c[1:]
    parts.append(two)
    if len(c) > 2:
        three = (two[:-1] << shift) | c[2:]
        parts.append(three[~space[1:-1]])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes, counts, n: int = PROFILE):
    """The n most frequent codes, most frequent first, ties by code."""
    import numpy as np

    return codes[np.lexsort((codes, -counts))[:n]]


def train(docs: DataFrame, n: int = PROFILE) -> dict[str, list[int]]:
    """docs(text, lang) -> for each language its n most frequent n-grams, in order.

    Rows without a language, or whose text is null or has no letter, teach nothing. What comes to the driver
    is n numbers for each language.
    """
    ship_package(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        drop()
        held: dict[tuple[str, int], int] = {}

        def flush():
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])
            held.clear()
            return batch

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(letters(text.as_py()))
            for lang, texts in by_lang.items():
                for k in range(0, len(texts), 200):
                    together = "".join(texts[k : k + 200])
                    if together.strip():
                        codes, counts = grams(together)
                        for code, m in zip(codes.tolist(), counts.tolist(), strict=True):
                            held[lang, code] = held.get((lang, code), 0) + m
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    known = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    two_spaces = 32 << 21 | 32  # between texts that were put together
    counted = materialise(known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("gram") != two_spaces), "grams")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    found: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").select("lang", "gram").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], n: int = PROFILE):
        import numpy as np

        self.n, self.langs = n, sorted(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), "u8")
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, "i8")
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, np.array(profiles[lang], "u8"))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        plain = letters(text or "")
        if not plain.strip() or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(*grams(plain), self.n)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != own] = len(self.codes)  # the last column: in no profile
        theirs = self.ranks[:, at]
        away = np.where(theirs < 0, self.n, np.minimum(np.abs(theirs - np.arange(len(own))), self.n)).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.n * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred string, score double).

    Defined results: a null text, or one without a letter, is `und` with score 0, as is any text if there
    is no profile; of equally near languages the first by name; rows that share an id are each judged; null
    ids pass; an empty table gives an empty one; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers for each language

    def work(batches):
        import pyarrow as pa

        drop()
        ranker = Ranker(shared.value)
        for batch in batches:
            found = [ranker.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that are not learnt from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    profiles = train(docs.filter(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
