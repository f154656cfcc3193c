"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the top bits of the hash name its bin, the rest is its rank there, and a
bin keeps the least. An empty bin takes the value of a bin that has one, chosen by a hash of its own number
and attempt (optimal densification), so that equal bins keep their meaning for small sets. Of each bin the
low bits are stored, packed, in hexadecimal; likeness corrects for bits that agree by chance.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.workers import drop
from auditspark.session import read_table, ship_package

#: 256 bins of 4 bits: 128 bytes a document, and a standard error of about 0.03.
BINS, BITS, WORDS = 256, 4, 5


class Sketcher:
    def __init__(self, bins: int = BINS, bits: int = BITS, words: int = WORDS):
        import numpy as np

        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins is a power of two, bits one of 1, 2, 4, 8")
        self.bins, self.bits, self.words = bins, bits, words
        # where an empty bin looks, attempt after attempt: fixed for all documents
        self.tries = np.random.default_rng(7).integers(0, bins, (bins, 8 * bins), "u2")

    def shingles(self, text: str):
        """A hash for each run of so many white-space words (of the whole if there are fewer); none for no word."""
        import numpy as np
        import xxhash

        found = text.split()
        if not found:
            return np.empty(0, "u8")
        if len(found) < self.words:
            return np.array([xxhash.xxh64_intdigest(" ".join(found))], "u8")
        one = xxhash.xxh64_intdigest
        h = np.array([one(w) for w in found], "u8")
        n = len(h) - self.words + 1
        mixed = np.zeros(n, "u8")
        for k in range(self.words):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0xD6E8FEB86659FD93)

    def values(self, text: str):
        """The stored bits of each bin, or None for a text without a word."""
        import numpy as np

        h = self.shingles(text)
        if not len(h):
            return None
        shift = np.uint64(64 - (self.bins.bit_length() - 1))
        none = np.uint64(2**64 - 1)
        least = np.full(self.bins, none, "u8")
        np.minimum.at(least, (h >> shift).astype("i8"), h)
        full = least != none
        empty = np.flatnonzero(~full)
        for at in range(0, self.tries.shape[1], 16):
            if not len(empty):
                break
            tried = self.tries[empty, at : at + 16]
            good = full[tried]
            hit = good.any(axis=1)
            least[empty[hit]] = least[tried[hit, good[hit].argmax(axis=1)]]
            empty = empty[~hit]
        least[empty] = least[full][:1]
        least = (least ^ (least >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (least >> np.uint64(64 - self.bits)).astype("u1")

    def pack(self, values) -> str:
        """Hexadecimal; the empty string for a text without a word."""
        import numpy as np

        if values is None:
            return ""
        grouped = values.reshape(-1, 8 // self.bits)
        out = np.zeros(len(grouped), "u1")
        for k in range(grouped.shape[1]):
            out |= grouped[:, k] << np.uint8(self.bits * k)
        return out.tobytes().hex()

    def unpack(self, fingerprint: str):
        import numpy as np

        if not fingerprint:
            return None
        raw = np.frombuffer(bytes.fromhex(fingerprint), "u1")
        return np.stack([raw >> np.uint8(self.bits * k) & np.uint8(2**self.bits - 1) for k in range(8 // self.bits)], axis=1).ravel()

    def likeness(self, a, b) -> float:
        """Estimated resemblance, 0 to 1: (share of equal bins - chance) / (1 - chance). Two texts without a
        word are alike, one without and one with a word are not."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 2.0**-self.bits
        return float(max(0.0, ((a == b).mean() - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint string).

    Defined results: a null text counts as empty; a text without a word has the empty fingerprint; rows that
    share an id are each fingerprinted; null ids pass; an empty table gives an empty one; other columns are
    ignored.
    """
    ship_package(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        drop()
        sketch = Sketcher()
        for batch in batches:
            found = [sketch.pack(sketch.values(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string")


def edited_text(text: str, after: str) -> str:
    """The text with its last quarter (rounded down, in code points) replaced by the first as many of another."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, text): the rows dealt to ranges of ids, and to each range, as guests, the rows
    with the first id of the next range (to the last range, those with the first id of all).

    The bounds are quantiles of the ids: ids that occur, so no range is empty. Only they pass through the
    driver, as many as parts. A range's rows and guests hold every row's successor, so that the texts are
    shuffled once and no window runs over the whole table.
    """
    ship_package(docs.sparkSession)
    ids = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000).alias("cuts")).first()
    least = ids["least"]
    cuts = sorted({c for c in ids["cuts"] or [] if c > least})
    known = F.coalesce("doc_id", F.lit(least), F.lit(0))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c <= known))
    first_of_all = F.col("doc_id").isNull() | (F.col("doc_id") == F.lit(least))
    guest = F.when(first_of_all, F.lit(len(cuts))).when(F.array_contains(bounds, F.col("doc_id")), part - 1)
    seats = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(0).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("part"), F.lit(1).alias("guest")))))
    return docs.select(F.explode_outer(seats).alias("s"), "doc_id", "text").select("s.part", "s.guest", "doc_id", "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string,
    near_edited, near_next double): each text against its edited form and against the next document.

    The order is by doc_id (null first), then by text; after the last row comes the first. A single row is
    its own successor. Else as fingerprints().
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def work(batches):
        import pyarrow as pa

        drop()
        sketch = Sketcher()
        out: list[tuple] = []
        before = None  # (part, doc_id, text, values) of the row that waits for its successor

        def pair(row, after_text, after_values):
            _, doc_id, text, values = row
            edited = edited_text(text, after_text)
            new = values if edited == text else sketch.values(edited)
            digest = hashlib.sha256(edited.encode()).hexdigest()
            out.append((doc_id, len(text), digest, sketch.pack(values), sketch.pack(new), sketch.likeness(values, new), sketch.likeness(values, after_values)))

        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for part, guest, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if guest and not (before and before[0] == part):
                    continue  # the first guest alone is a successor
                text = text.as_py()
                values = sketch.values(text)
                if before:
                    pair(before, text, values)
                before = None if guest else (part, doc_id, text, values)
            if out:
                yield flush()

    dealt = in_order(docs, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")
    return dealt.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read_table(spark, sf_dir, "documents"))
