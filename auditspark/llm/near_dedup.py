"""MinHash near-deduplication with a multi-index Hamming join.

1. Every text gets the set of its word shingles and a signature of 16-bit MinHash symbols. Equal sets become
   one representative, by grouping.
2. A signature is split into chunks. Of two signatures that differ in at most 2 * chunks - 1 symbols one chunk
   at least has no more than one wrong symbol (pigeonhole). The allowed error is enumerated: a chunk gives one
   key for each symbol left out, so that such a pair shares a key. All pairs under that distance are found; the
   layout is set so that pairs at the wanted similarity share a key but for about one in a million, and that
   unlike texts seldom do.
3. Representatives that share a key hang on the key's smallest one: a star, not all pairs. Each representative
   is compared with the nearest of its centres, on the full sets. That costs one comparison a representative, and
   connects a large group of near copies, if not always all of it.
4. A key is open if what hangs on it isn't connected yet. In open keys signatures are compared; what is less alike than
   any pair at the wanted similarity could seem (UNLIKE) is left apart, so unlike texts that share a key make no cluster.
   Clusters are what the rest connects; no link can leave one. They are confirmed on the full sets.
   Groups of either kind are dealt to blocks of bounded size, and every two blocks meet in a task of their own, which
   returns what connects their members, not their pairs. Two blocks of one connected group don't meet.
5. Components of the confirmed links; the smallest doc_id names each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.components import connected_components
from auditspark.llm.skew import join_unique
from auditspark.llm.workers import arrow_rows, drop, spread
from auditspark.session import materialise, read_table, ship_package

#: Least similarity in percent -> (chunks, symbols of a chunk): pairs at 0.85 share no key in 1 of 1.1 million cases,
#: pairs at 0.8 in 1 of 2.2 million; pairs at 0.3 share one in 2 (9) of 100, pairs at 0.2 in 0.1 (0.8) of 100.
LAYOUT = {85: (13, 8), 80: (17, 7)}
#: Share of equal symbols under which a pair counts as unlike, by the least similarity. At that similarity so few are equal
#: in less than one of 10 ** 9 cases.
UNLIKE = {85: 0.58, 80: 0.55}
#: Members and shingles of a block; seats (40 bytes each) that are broadcast; rows of an Arrow batch.
BLOCK_ROWS, BLOCK_SHINGLES, BROADCAST_SEATS, BATCH_ROWS = 1000, 500_000, 500_000, 1000
SEED = 20_240_229


def shingle_set(text: str | None, words: int):
    """The distinct 64-bit hashes of the text's runs of so many words, sorted; A-Z count as lower case, white
    space is [\\x20\\x09-\\x0D]; fewer words make one run; none for no word."""
    import numpy as np
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return np.empty(0, "u8")
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], "u8")
    one = xxhash.xxh64_intdigest
    h = np.array([one(w) for w in found], "u8")
    n = len(h) - words + 1
    mixed = np.zeros(n, "u8")
    for k in range(words):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class Signer:
    """Signatures of sets, and the keys of their chunks."""

    def __init__(self, chunks: int, symbols: int):
        import numpy as np

        rng = np.random.default_rng(SEED)
        draw = lambda bits, *shape: rng.integers(0, 2**bits, shape, f"u{bits // 8}", endpoint=False)
        self.chunks, self.symbols, self.n = chunks, symbols, chunks * symbols
        self.by, self.plus = draw(32, self.n, 1) | np.uint32(1), draw(32, self.n, 1)
        self.weights, self.marks = draw(64, chunks, symbols) | np.uint64(1), draw(64, chunks, symbols)

    def signature(self, shingles):
        """n 16-bit symbols, each from the least of the set under a hash of its own."""
        import numpy as np

        short = (shingles >> np.uint64(32)).astype("u4")
        least = np.full(self.n, 2**32 - 1, "u4")
        for k in range(0, len(short), 1024):
            least = np.minimum(least, (short[None, k : k + 1024] * self.by + self.plus).min(axis=1))
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        least = (least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39)
        return (least >> np.uint32(16)).astype("<u2")

    def keys(self, signatures):
        """rows x (chunks * symbols) keys: of every chunk, one for each symbol left out."""
        import numpy as np

        parts = (signatures.astype("u8").reshape(-1, self.chunks, self.symbols) + np.uint64(1)) * self.weights
        parts ^= parts >> np.uint64(32)
        parts *= np.uint64(0xBF58476D1CE4E5B9)
        mixed = parts.sum(axis=2, keepdims=True) - parts + self.marks
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0x94D049BB133111EB)
        return (mixed ^ (mixed >> np.uint64(31))).view("i8").reshape(-1, self.n)


def sign(docs: DataFrame, words: int, chunks: int, symbols: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b long, signature binary); set_a and set_b are a 128-bit hash of the set."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        drop()
        signer = Signer(chunks, symbols)
        for batch in batches:
            sizes, ids, signatures = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                ids.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))
                signatures.append(signer.signature(s).tobytes() if len(s) else None)
            both = np.array(ids, "i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def hang(reps: DataFrame, chunks: int, symbols: int) -> DataFrame:
    """reps(rep, signature) -> (key, rep, first): the keys that more than one has, each with its smallest one."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        signer = Signer(chunks, symbols)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                keys = signer.keys(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, signer.n))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), signer.n))], names=["key", "rep"])

    keyed = materialise(reps.select("rep", "signature").mapInArrow(work, "key long, rep long"), "keyed")
    first = materialise(keyed.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    return materialise(join_unique(keyed, first, ["key"]), "hung")


def alike_pairs(hung: DataFrame, reps: DataFrame, unlike: float) -> DataFrame:
    """(rep, first, alike): representatives and the centres they hang on, if the share of equal symbols is enough."""
    pairs = materialise(hung.filter("rep <> first").select("rep", "first").distinct(), "pairs")
    own = reps.select("rep", F.col("signature").alias("s"))
    centres = materialise(pairs.groupBy("first").agg(F.count("*").alias("n")).join(own.select(F.col("rep").alias("first"), F.col("s").alias("t")), "first"), "centres")
    both = join_unique(pairs, centres, ["first"]).join(own, "rep").select("rep", "first", "s", "t")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((s == t).mean(axis=1))], names=["rep", "first", "alike"])

    return materialise(both.mapInArrow(work, "rep long, first long, alike double").filter(F.col("alike") >= unlike), "alike")


def nearest_centres(alike: DataFrame) -> DataFrame:
    """(rep, centre): the centre that is most like each representative; of equals the smallest."""
    return alike.groupBy("rep").agg(F.max(F.struct("alike", (-F.col("first")).alias("first"))).alias("m")).select("rep", (-F.col("m.first")).alias("centre"))


def with_sets(docs: DataFrame, seats: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text), seats(doc_id, seat array<struct>) -> (seat, doc_id, shingles array<long>) for each seat: a
    document's set is made once, whatever the number of its seats. Only seated documents' texts are read into Python."""
    seats = materialise(seats, "seats")
    # a member of a large cluster has many seats
    small = (seats.agg(F.sum(F.size("seat") + 1)).first()[0] or 0) <= BROADCAST_SEATS
    texts = docs.select("doc_id", "text").join(F.broadcast(seats.select("doc_id")) if small else seats.select("doc_id"), "doc_id")

    def work(batches):
        import pyarrow as pa

        drop()
        for batch in batches:
            found = [shingle_set(t.as_py(), words).view("i8") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    sets = texts.select("doc_id", "text").mapInArrow(work, "doc_id long, shingles array<long>")
    return sets.join(F.broadcast(seats) if small else seats, "doc_id").select(F.explode_outer("seat").alias("seat"), "doc_id", "shingles")


def star_links(docs: DataFrame, centred: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the links between representatives and their centres. What hangs on a centre is dealt to parts of
    bounded size, and the centre goes to each."""
    counted = centred.groupBy(F.col("centre").alias("c")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    members = centred.join(counted, F.col("centre") == F.col("c")).select(F.col("rep").alias("doc_id"), F.struct("centre", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part")).alias("s"))
    centres = counted.select(F.col("c").alias("doc_id"), F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.col("c").alias("centre"), k.alias("part")))).alias("s"))
    seats = members.unionByName(centres).groupBy("doc_id").agg(F.collect_list("s").alias("seat"))

    def confirm(table):
        import numpy as np
        import pyarrow as pa

        drop()
        ids, centre = table.column("doc_id").to_numpy(), table.column("centre")[0].as_py()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        middle = next((s for i, s in zip(ids, sets, strict=True) if i == centre), np.empty(0, "i8"))
        shared = np.array([np.intersect1d(s, middle, assume_unique=True).size for s in sets])
        sizes = np.array([len(s) for s in sets])
        found = ids[(100 * shared >= percent * (sizes + len(middle) - shared)) & (ids != centre)]
        return pa.table({"a": pa.array(found), "b": pa.array(np.full(len(found), centre))})

    seated = with_sets(docs, seats, words).select(F.col("seat.centre").alias("centre"), F.col("seat.part").alias("part"), "doc_id", "shingles")
    return seated.groupBy("centre", "part").applyInArrow(confirm, "a long, b long")


def blocks(members: DataFrame) -> DataFrame:
    """members(component, rep, label, n_shingles) -> (component, lo, hi, own, rep): each member in the pairs of blocks
    that it takes part in. Members with one label are connected already."""
    groups = members.groupBy("component", "label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n"), F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    # a connected group of more than a block has blocks of its own; the others share blocks, which come first
    large = F.col("n") > 1
    shared = groups.groupBy("component").agg(
        F.greatest(F.ceil(F.sum(F.when(~large, F.col("rows"))) / BLOCK_ROWS), F.ceil(F.sum(F.when(~large, F.col("shingles"))) / BLOCK_SHINGLES), F.lit(0)).cast("int").alias("shared"),
        F.array_sort(F.collect_list(F.when(large, F.struct("label", "n")))).alias("large"),
    )
    before = F.aggregate(F.filter("large", lambda g: g.label < F.col("label")), F.col("shared"), lambda n, g: n + g.n)
    total = F.aggregate("large", F.col("shared"), lambda n, g: n + g.n)
    own_n = F.aggregate(F.filter("large", lambda g: g.label == F.col("label")), F.lit(0), lambda n, g: n + g.n)
    placed = members.join(shared, "component").select("component", "rep", "shared", before.alias("base"), own_n.alias("own_n"), total.alias("total"))
    placed = placed.withColumn("own", F.when(F.col("own_n") > 0, F.col("base") + F.pmod(F.xxhash64("rep"), "own_n")).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("shared", F.lit(1)))).cast("int"))
    met = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda k: (F.col("own_n") == 0) | (k < F.col("base")) | (k >= F.col("base") + F.col("own_n")))
    return placed.select("component", "rep", "own", F.explode(met).alias("k")).select("component", F.least("own", "k").alias("lo"), F.greatest("own", "k").alias("hi"), "own", "rep")


def bucket_links(members: DataFrame, reps: DataFrame, unlike: float) -> DataFrame:
    """(a, b): what connects the members of each group, members(component, rep, label, n_shingles), whose signatures
    are alike, where that are members with different labels."""
    own = reps.select("rep", "signature")
    seated = blocks(members).join(members.select("component", "rep", "label"), ["component", "rep"]).join(own, "rep")
    rows = seated.select("component", "lo", "hi", "own", "rep", "label", "signature")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def connect(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        def found(ids, side, labels, s):
            of = connected_by(lambda k: (s[k, None] == s[None, :, :]).mean(axis=2) >= unlike, len(ids), side)
            for part in np.unique(of):
                at = np.flatnonzero(of == part)
                if len(at) > 1 and (labels[at] != labels[at[0]]).any():
                    yield from ((i, ids[at[0]]) for i in ids[at[1:]].tolist())

        left = None
        for batch in (*batches, None):
            table = left if batch is None else pa.table(batch) if left is None else pa.concat_tables([left, pa.table(batch)])
            if table is None or not table.num_rows:
                continue
            group = np.stack([table.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            done = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last group may go on in the next batch
            left = table.slice(cuts[done]).combine_chunks()
            if not done:
                continue
            side, ids, labels = (table.column(k).to_numpy() for k in (3, 4, 5))
            s = np.frombuffer(b"".join(table.column(6).slice(0, cuts[done]).to_pylist()), "<u2").reshape(cuts[done], -1).astype("u1")
            out = [x for a, b in zip(cuts[:done], cuts[1:], strict=False) for x in found(ids[a:b], side[a:b] if group[1, a] != group[2, a] else None, labels[a:b], s[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    keys = ["component", "lo", "hi"]
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(connect, "a long, b long")


def unconnected(hung: DataFrame, joined: DataFrame, alike: DataFrame, reps: DataFrame, unlike: float) -> DataFrame:
    """(component, rep, label, n_shingles): clusters of representatives that may have links which aren't known yet.
    joined(node, component): what is connected already."""
    labels = joined.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    label = F.coalesce("label", "rep").alias("label")
    labelled = hung.join(labels, "rep", "left").select("key", "rep", label)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n")).filter("l < m AND n > 2").select("key")
    members = materialise(labelled.join(open_keys, "key").select(F.col("key").alias("component"), "rep", "label", F.lit(0).cast("long").alias("n_shingles")).distinct(), "open")
    # a key of two is the pair of its star
    pairs = alike.join(labels, "rep", "left").select("first", "rep", label).join(labels.select(F.col("rep").alias("first"), F.col("label").alias("other")), "first", "left").filter(F.col("label") != F.coalesce("other", "first"))
    links = materialise(bucket_links(members, reps, unlike).unionByName(pairs.select(F.col("rep").alias("a"), F.col("first").alias("b"))).distinct(), "candidates")
    found = connected_components(links).select(F.col("node").alias("rep"), "component")
    sizes = reps.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"))
    return materialise(found.join(labels, "rep", "left").join(sizes, "rep").select("component", "rep", label, "n_shingles"), "members")


def block_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect, in each cluster, whatever pairs with so large a similarity connect."""
    seat = F.struct("component", "lo", "hi", "own")
    seats = blocks(members).groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(seat).alias("seat"))

    def confirm(table):
        import numpy as np
        import pyarrow as pa

        drop()
        ids, side = table.column("doc_id").to_numpy(), table.column("own").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        joined = components_of(sets, percent, side if table.column("lo")[0].as_py() != table.column("hi")[0].as_py() else None)
        root = np.full(len(ids), np.iinfo("i8").max)
        np.minimum.at(root, joined, ids)
        to = root[joined]
        keep = to != ids
        return pa.table({"a": ids[keep], "b": to[keep]})

    seated = with_sets(docs, seats, words).select(*[F.col(f"seat.{c}").alias(c) for c in ("component", "lo", "hi", "own")], "doc_id", "shingles")
    return seated.groupBy("component", "lo", "hi").applyInArrow(confirm, "a long, b long")


def components_of(sets: list, percent: int, side=None):
    """A number for each set, equal for those connected by pairs of which 100 * shared >= percent * union.
    side: if given, only pairs of different sides count."""
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets], "i8")
    tokens, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    used = np.cumsum(often > 1) - 1
    row = np.repeat(np.arange(n), sizes)
    keep = often[column] > 1
    row, column = row[keep], used[column[keep]]
    shared = np.zeros((n, n), "f4")
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(64, 4_000_000 // n)
    for at in range(0, int((often > 1).sum()), step):
        lo, hi = np.searchsorted(column, (at, at + step))
        some, place = np.unique(row[lo:hi], return_inverse=True)
        dense = np.zeros((len(some), step), "f4")
        dense[place, column[lo:hi] - at] = 1
        shared[np.ix_(some, some)] += dense @ dense.T
    shared = shared.astype("i8")
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    return connected_by(lambda k: linked[k], n, side)


def connected_by(linked, n: int, side=None):
    """A number for each of n things. linked: for the numbers of some, a row each of what they are linked with.
    side: if given, only links between different sides count."""
    import numpy as np

    label = np.full(n, -1)
    for k in range(n):
        if label[k] < 0:
            label[k] = k
            edge = np.array([k])
            while len(edge) and (label < 0).any():
                reached = np.zeros(n, bool)
                for at in range(0, len(edge), 64):
                    own = edge[at : at + 64]
                    rows = linked(own)
                    reached |= (rows if side is None else rows & (side[own, None] != side[None, :])).any(axis=0)
                edge = np.flatnonzero(reached & (label < 0))
                label[edge] = k
    return label


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles long, component_id long, kept boolean), a row for each row.

    Two documents are linked if 100 * shared shingles >= percent * those of either; component_id is the
    smallest doc_id that links lead to, itself included, and kept says that it is the row's own.

    Defined results: null and empty texts and those without a word have no shingle and are linked with
    nothing; texts of fewer words than a shingle have one, the whole; rows with a null doc_id have a null
    component_id and are kept; rows that share an id are judged each by its text (equal rows agree); an empty
    table gives an empty one; other columns are ignored.
    """
    if percent < min(LAYOUT):
        raise ValueError("signatures are laid out for similarities of 80 percent or more")
    least = max(p for p in LAYOUT if p <= percent)
    (chunks, symbols), unlike = LAYOUT[least], UNLIKE[least]
    docs = docs.select("doc_id", "text")
    ship_package(docs.sparkSession)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        signed = materialise(sign(docs, words, chunks, symbols), "signed")
        proper = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        one = F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r")
        reps = materialise(proper.groupBy("set_a", "set_b").agg(one).select(F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.signature"), "reps")
        hung = hang(reps, chunks, symbols)
        alike = alike_pairs(hung, reps, unlike)
        links = materialise(star_links(docs, nearest_centres(alike), words, percent), "star-links")
        joined = connected_components(links)
        members = unconnected(hung, joined, alike, reps, unlike)
        more = materialise(block_links(docs, members, words, percent), "block-links")
        if not more.isEmpty():
            joined = connected_components(links.unionByName(more))
    same = proper.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    named = materialise(same.join(joined, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component_id")), "named")
    columns = ["doc_id", "n_shingles", "component_id"]
    found = join_unique(proper.drop("signature"), named, ["set_a", "set_b"]).select(columns)
    rest = signed.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(rest.select(columns)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of every group but those of its smallest doc_id; rows that share an id and have
    texts of different groups go or stay by the id."""
    gone = near_duplicates(docs, words, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(read_table(spark, sf_dir, "documents")), words=3, percent=85)
