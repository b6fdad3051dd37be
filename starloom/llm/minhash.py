"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and components.

Each shingle draws a random permutation of the slots and a rank for each step; slot values are the
smallest (step, rank), so one permutation correlates a shingle's ranks over the slots. Steps run in
ascending order for all shingles of a document and end as soon as every slot is filled.

Documents with equal sets become one representative. Representatives that share a band's values
meet in a bucket. First each is compared with the smallest of the leaders of its buckets: one pair
a document, which joins most copies. Buckets that still hold several components are then settled
inside tasks: the members of a bucket, or of a block of a bucket beyond BLOCK, come with their
signatures and texts; two of them that are not yet in one component are confirmed on their full
sets if their signatures agree often enough and no earlier band has them meet. A task returns the
links that join components, at most one a member, and never a row for a pair. What is left of
buckets with several blocks are the members outside their largest component: blocks of them meet
each other and the blocks of that component.

Shingles are compared by their 64-bit hashes, and sets are found equal by 128 bits of them. A pair
at the threshold is missed by all bands, or by its signatures' agreement, once in 50,000 times.

Defined results: a document without words has the empty set and is linked with nothing; with fewer
words than a shingle the whole sequence is its one shingle; a null id is linked with nothing and
kept; repeated rows are exact copies; rows that share an id are one document; ties go to the
smallest id; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import discard, id_text, materialise
from starloom.llm.graph import components

WORDS, PERCENT = 5, 80
#: Bands, and rows a band. A pair at 0.8 is missed once in 50,000 times.
BANDS, ROWS = 36, 6
#: Documents hashed at once, and words whose hashes a process keeps.
SLICE, KEPT_WORDS = 200, 200_000
#: Members of a bucket that one task compares at once; two blocks meet at most.
BLOCK = 512
#: Standard deviations that the agreement of two signatures may fall below the threshold.
SPREAD = 4.5

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
LOW = U((1 << 56) - 1)


def steps(k: int) -> np.uint64:
    return U(int(STEP) * k & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


class Hashes(dict):
    """Number of each word seen; ``values`` holds the hashes by number."""

    def __init__(self):
        self.values: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.values)
        self.values.append(xxhash.xxh64_intdigest(word))
        return n


class Shingler:
    def __init__(self, words: int):
        self.words, self.seen = words, Hashes()
        self.table = np.zeros(0, U)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        if len(self.seen) > KEPT_WORDS:
            self.seen = Hashes()
            self.table = np.zeros(0, U)
        look = self.seen.__getitem__
        numbers = [list(map(look, t.encode().lower().split())) for t in texts]
        if len(self.table) < len(self.seen.values):
            self.table = np.concatenate([self.table, np.array(self.seen.values[len(self.table) :], U)])
        out, k = [], self.words
        for own in numbers:
            h = self.table[np.array(own, np.int64)] if own else np.zeros(0, U)
            n = len(h)
            width = min(n, k)
            total = np.zeros(max(0, n - width + 1) if n else 0, U)
            if n:
                for i in range(width):
                    total = mix(total + h[i : n - width + 1 + i] + steps(i + 1))
                total = mix(total ^ U(width)) if width < k else total
                total = np.sort(total)
                total = total[np.concatenate([[True], total[1:] != total[:-1]])]
            out.append(total)
        return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` values for each set; an empty set's row is all ones."""
    signature = np.full((len(sets), slots), np.iinfo(np.uint64).max, U)
    flat = signature.reshape(-1)
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for step in range(slots):
        if not len(items):
            break
        draw = mix(items + steps(step + 1))
        pick = step + ((draw >> U(40)) * U(slots - step) >> U(24)).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            rows = np.arange(len(items))
            slot = order[rows, pick]
            order[rows, pick] = order[:, step]
            order[:, step] = slot
        np.minimum.at(flat, owner * slots + slot, draw & LOW | U(step) << U(56))
        open_ = (signature == np.iinfo(np.uint64).max).any(axis=1)
        stay = open_[owner]
        items, owner = items[stay], owner[stay]
        if step == 0:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
            rows, pick = np.arange(len(items)), pick[stay]
            order[rows, pick] = 0
            order[:, 0] = pick
        else:
            order = order[stay]
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signature.reshape(len(signature), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1).astype(U) * STEP), (len(signature), 1))
    for i in range(rows):
        key = mix(key + cut[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, set_hash array<long>, bands array<long>, slots binary (a byte of each slot); the last three null for an empty set."""
    if bands * rows > 255:
        raise ValueError("bands * rows must be 255 at most")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingler.sets(part.column(2).to_pylist())
                signature = super_minhash(sets, bands * rows)
                keys, slots = band_keys(signature, bands, rows), (signature & U(255)).astype(np.uint8)
                hashes = [[int(np.bitwise_xor.reduce(mix(s ^ STEP)).view(np.int64)), int(np.add.reduce(mix(s)).view(np.int64))] if len(s) else None for s in sets]
                longs = pa.list_(pa.int64())
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, longs), pa.array([k if len(s) else None for k, s in zip(keys, sets)], longs), pa.array([x.tobytes() if len(s) else None for x, s in zip(slots, sets)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "key", "n_shingles", "set_hash", "bands", "slots"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, key long, n_shingles long, set_hash array<long>, bands array<long>, slots binary")


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")


def compare(pairs: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """a, b, both, either: sizes of intersection and union of the full shingle sets. ``docs``: a row for each doc_id."""
    a, b = (docs.select(F.col("doc_id").alias(f"{x}_id"), F.col("text").alias(f"{x}_text")) for x in "ab")
    joined = pairs.join(b, F.col("b") == F.col("b_id")).select("a", "b", "b_text").join(a, F.col("a") == F.col("a_id")).select("a", "a_text", "b", "b_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, mine = Shingler(words), None, np.zeros(0, U)
        for batch in batches:
            both, either = [], []
            for a_id, a_text, b_text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3)):
                if a_id != last:
                    last, mine = a_id, shingler.sets([a_text.as_py()])[0]
                other = shingler.sets([b_text.as_py()])[0]
                both.append(len(np.intersect1d(mine, other, assume_unique=True)))
                either.append(len(mine) + len(other) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    return joined.mapInArrow(run, "a long, b long, both long, either long")


class Forest:
    """Union of numbered members; a root is the smallest number of its tree."""

    def __init__(self, groups: np.ndarray):
        first = np.unique(groups, return_index=True, return_inverse=True)
        self.root = first[1][first[2]]

    def unite(self, x: int, y: int) -> None:
        lo, hi = sorted((self.root[x], self.root[y]))
        self.root[self.root == hi] = lo


def new_links(band: int, ids: list[int], component: np.ndarray, bands: np.ndarray, slots: np.ndarray, texts: list[str], shingler: Shingler, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join components of the members of one group; each confirmed on the full sets."""
    limit = percent / 100
    need = (limit - SPREAD * np.sqrt(limit * (1 - limit) / slots.shape[1])) * slots.shape[1]
    forest, sets = Forest(component), {}

    def full(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingler.sets([texts[x]])[0]
        return sets[x]

    for x in range(len(ids) - 1):
        later = np.flatnonzero(forest.root[x + 1 :] != forest.root[x]) + x + 1
        later = later[(slots[later] == slots[x]).sum(axis=1) >= need]
        later = later[~(bands[later, :band] == bands[x, :band]).any(axis=1)]
        for y in later.tolist():
            if forest.root[x] != forest.root[y]:
                both = len(np.intersect1d(full(x), full(y), assume_unique=True))
                if 100 * both >= percent * (len(full(x)) + len(full(y)) - both):
                    forest.unite(x, y)
                    yield ids[x], ids[y]


def settle(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: the links that join components of a group.

    ``members`` (bucket, p, q, band, doc_id, component): a group is what shares the first three;
    ``docs`` (doc_id, bands, slots, text) has a row for each doc_id.
    """
    group = ["bucket", "p", "q"]
    full = members.join(docs.select(F.col("doc_id").alias("d_id"), "bands", "slots", "text"), F.col("doc_id") == F.col("d_id")).select(*group, "band", "doc_id", "component", "bands", "slots", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)

        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).sort_by("doc_id") if parts else None
            found = []
            if t is not None and t.num_rows > 1:
                stack = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, -1)
                bands = np.array(t.column("bands").to_pylist(), np.int64)
                found = list(new_links(t.column("band")[0].as_py(), t.column("doc_id").to_pylist(), t.column("component").to_numpy(), bands, stack("slots", np.uint8), t.column("text").to_pylist(), shingler, percent))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if keys[i] != last:
                        yield links(held)
                        held, last = [], keys[i]
                    held.append(batch.slice(i, j - i))
        yield links(held)

    return full.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = materialise(signatures(docs, words, bands, rows, id_col, text_col), "signatures")
    one = F.min_by(F.struct("doc_id", "key", "n_shingles", "bands", "slots"), "doc_id")
    reps = materialise(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(one.alias("r")).select(F.col("set_hash").alias("r_hash"), "r.*"), "reps")
    classed = signed.join(reps.select("r_hash", F.col("doc_id").alias("rep")), F.col("set_hash") == F.col("r_hash"), "left")
    classed = materialise(classed.select("doc_id", "n_shingles", "rep"), "classed")
    discard(signed)
    found = bucket_components(reps, keyed_text(docs, id_col, text_col), words, percent, block)
    discard(reps)
    joined = classed.join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def bucket_components(reps: DataFrame, text: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """node, component of the representatives that any link within a bucket joins."""
    spread = reps.select("doc_id", "key", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy(F.col("bucket").alias("s_bucket")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "n_shingles")).alias("first")).where("n > 1")
    members = materialise(spread.join(shared, F.col("bucket") == F.col("s_bucket")).select("doc_id", "key", "n_shingles", "band", "bucket", "first"), "members")
    ids = members.select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key")).distinct()
    texts = text.join(ids, (F.col("doc_id") == F.col("m_id")) & (F.col("key") == F.col("m_key")), "left_semi").select(F.col("doc_id").alias("t_id"), F.col("key").alias("t_key"), "text")
    clustered = reps.join(texts, (F.col("doc_id") == F.col("t_id")) & (F.col("key") == F.col("t_key"))).select("doc_id", "bands", "slots", "text")
    clustered = materialise(clustered.dropDuplicates(["doc_id"]), "clustered")

    # Each document meets the smallest of the leaders of its buckets.
    fits = 100 * F.least("n_shingles", "first.n_shingles") >= percent * F.greatest("n_shingles", "first.n_shingles")
    pairs = members.where(fits & (F.col("doc_id") != F.col("first.doc_id"))).groupBy(F.col("doc_id").alias("b")).agg(F.min("first.doc_id").alias("a"))
    pairs = materialise(pairs.select("a", "b"), "pairs")
    found = components(compare(pairs, clustered, words).where(100 * F.col("both") >= percent * F.col("either")).select("a", "b"))

    # Blocks of the buckets that hold several components.
    placed = materialise(several(members.select("bucket", "band", "doc_id"), found), "members")
    discard(members, pairs)
    own = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.ceil(F.col("n") / block)).cast("int")
    links = settle(placed.withColumn("p", own).withColumn("q", F.lit(0)), clustered, words, percent)
    found = join_components(found, links)

    # Of larger buckets, what is outside the largest component meets everything.
    wide = materialise(several(placed.where(F.col("n") > block).select("bucket", "band", "doc_id"), found), "members")
    discard(placed)
    if not wide.isEmpty():
        found = join_components(found, settle(outside_blocks(wide, block), clustered, words, percent))
    discard(wide, clustered)
    return found


def several(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, band, doc_id, component, n (members of the bucket) of buckets with more than one component."""
    placed = members.join(found, F.col("doc_id") == F.col("node"), "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    left = placed.groupBy(F.col("bucket").alias("s_bucket")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("s_bucket", "n")
    return placed.join(left, F.col("bucket") == F.col("s_bucket")).select("bucket", "band", "doc_id", "component", "n")


def outside_blocks(wide: DataFrame, block: int) -> DataFrame:
    """bucket, p, q, band, doc_id, component: pairs of blocks, of which one at least lies outside the bucket's largest component."""
    sizes = wide.groupBy(F.col("bucket").alias("s_bucket"), "component").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    largest = sizes.groupBy("s_bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.max("n").alias("n"))
    blocks = lambda c: F.ceil(c / block).cast("int")
    largest = largest.select("s_bucket", F.col("top.component").alias("main"), blocks(F.col("top.size")).alias("inner"), blocks(F.col("n") - F.col("top.size")).alias("outer"))
    d = wide.drop("n").join(largest, F.col("bucket") == F.col("s_bucket"))
    inside = F.col("component") == F.col("main")
    d = d.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit("pair")), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # Outer blocks are numbered from 0, inner ones from -1 down.
    to_outer = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct(F.least("own", j).alias("p"), F.greatest("own", j).alias("q")))
    to_inner = F.transform(F.sequence(F.lit(1), F.col("inner")), lambda j: F.struct((-j).alias("p"), F.col("own").alias("q")))
    of_inner = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct((-1 - F.col("own")).alias("p"), j.alias("q")))
    met = F.when(inside, of_inner).otherwise(F.concat(to_outer, to_inner))
    return d.select("bucket", "band", "doc_id", "component", F.explode(met).alias("m")).select("bucket", "m.p", "m.q", "band", "doc_id", "component")


def join_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` after more links."""
    new = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))
    discard(found)
    return new
