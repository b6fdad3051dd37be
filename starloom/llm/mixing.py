"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in the order of a seeded hash, one after the other,
cut into blocks of ``block_words``. A source gives its target: whole passes over the stream, and of
one more pass so many of its permuted blocks as its quota says, the last one cut at the word that
meets the target. So quotas are exact, blocks are disjoint, and no document is taken more often than
its source has passes.

The drawn blocks go to output shards of equal size. A tree over the shards splits the sources' quotas:
at each node the left half's blocks are a multivariate hypergeometric draw from the node's, seeded by
the node alone, so any task walks from the root to its own shards and meets the same numbers. A shard
then owns a run of each source's permuted blocks, and its pieces are shuffled by a seeded hash.

Positions in a stream are running sums over three levels: documents in buckets of about
``BUCKET_ROWS``, buckets in groups, and groups, so that a source with a third of all rows is many
small windows.

Defined results: a null text has no word; documents without words aren't drawn; a null source is a
source of its own, the last; rows with a null id are drawn like others; repeated rows are documents
each; an empty table gives no rows; columns other than those named are ignored. Beyond MOST_SOURCES
distinct sources there is an error, as their quotas go to every task.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import materialise

#: Fixed values of the query's mix: weights of the sources in turn, share of all words, passes at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, SEED = 256, 1024, 20
BUCKET_ROWS, GROUP_BUCKETS = 1000, 1000
MOST_SOURCES = 1_000_000
#: The draws' window around the mode, in standard deviations.
REACH = 12


class Source(NamedTuple):
    """What a source gives: its words, target, whole passes, blocks of its stream, whole blocks and words of one more block in the last pass, all blocks drawn, and its permutation."""

    rank: int
    source: str | None
    rows: int
    source_size: int
    target: float
    passes: int
    blocks: int
    whole: int
    cut: int
    quota: int
    stride: int
    shift: int


def targets(sizes: list[int], weights: Iterable[float], share: float = SHARE, passes: int = PASSES) -> list[float]:
    """Words of each source: ``share`` of all by weight, at most ``passes`` times its own; what is above goes to the others by weight."""
    weights, total = list(weights), share * sum(sizes)
    full = [False] * len(sizes)
    while True:
        left = total - sum(passes * s for s, f in zip(sizes, full) if f)
        open_weight = sum(w for w, f in zip(weights, full) if not f)
        now = [passes * s if f else left * w / open_weight for s, w, f in zip(sizes, weights, full)]
        above = [not f and t > passes * s for t, s, f in zip(now, sizes, full)]
        if not any(above):
            return [float(t) for t in now]
        full = [f or a for f, a in zip(full, above)]


def quotas(rows: list[tuple[str | None, int, int]], block_words: int, seed: int, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> list[Source]:
    """The sources (name, rows, words) in order of code points, null last, with what each gives."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[2] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, passes)
    out = []
    for rank, ((name, n, size), target) in enumerate(zip(rows, wanted)):
        words = round(target)
        full, rest = divmod(words, size) if size else (0, 0)
        blocks = -(-size // block_words)
        # The last block may be short; it is drawn last, so that all before it are whole.
        whole = min(rest // block_words, max(blocks - 1, 0))
        cut = rest - whole * block_words
        r, turn = random.Random(f"{seed} {rank}"), max(blocks - 1, 1)
        stride = next(x for x in iter(lambda: r.randrange(1 << 27, 1 << 28), 0) if math.gcd(x, turn) == 1)
        out.append(Source(rank, name, n, size, target, full, blocks, whole, cut, full * blocks + whole + (cut > 0), stride, r.randrange(turn)))
    return out


def uniform(*key: int) -> float:
    return int.from_bytes(blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2**64


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without putting back are good, by inversion around the mode: ``u`` is uniform on [0, 1)."""
    low, high, total = max(0, draws - bad), min(good, draws), good + bad
    if low == high:
        return low
    mode = (good + 1) * (draws + 1) // (total + 2)
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(total - 1, 1))
    reach = math.ceil(REACH * spread) + 30
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    ratio = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return int(min(first + np.searchsorted(sums, u * sums[-1], side="right"), last))


def split(held: np.ndarray, draws: int, *key: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``draws`` from the counts ``held``, one source after the other."""
    out, rest = np.zeros_like(held), int(held.sum())
    for s, n in enumerate(held.tolist()):
        rest -= n
        out[s] = hypergeometric(uniform(*key, s), n, rest, draws)
        draws -= int(out[s])
    return out


def shard_runs(quota: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, begin and end of its run of each source's blocks) for shards ``first`` up to ``last``; all shards hold alike many blocks, give or take one."""
    total = int(quota.sum())
    ends = lambda k: total * k // shards

    def walk(low: int, high: int, held: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if low >= last or high <= first:
            return
        if high - low == 1:
            yield low, begin, begin + held
            return
        middle = (low + high) // 2
        left = split(held, ends(middle) - ends(low), seed, low, high)
        yield from walk(low, middle, left, begin)
        yield from walk(middle, high, held - left, begin + left)

    yield from walk(0, shards, quota, np.zeros_like(quota))


def plan_blocks(spark, sources: list[Source], shards: int, seed: int) -> DataFrame:
    """rank, drawn, shard: the shard of each drawn block, by its number among its source's."""
    sent = spark.sparkContext.broadcast(np.array([s.quota for s in sources], np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, begin, end in shard_runs(sent.value, shards, int(ids[0]), int(ids[-1]) + 1, seed):
                held = np.flatnonzero(end > begin)
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(begin[held]), pa.array(end[held]), pa.array(np.full(len(held), shard))], ["rank", "begins", "ends", "shard"])

    runs = spark.range(shards).mapInArrow(run, "rank int, begins long, ends long, shard long")
    return runs.select("rank", F.explode(F.sequence("begins", F.col("ends") - 1)).alias("drawn"), "shard")


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row, doc_id, source, size, u (place in the source's order) of every document; written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column(2)]
            size = [len(t.split()) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in raw], pa.int64())], ["doc_id", "source", "size", "key"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = d.mapInArrow(run, "doc_id long, source string, size long, key long")
    return materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 1).alias("u")), "sized")


def with_begin(d: DataFrame) -> DataFrame:
    """Adds begin: words of the source before each document of (rank, rows, u, doc_id, row, size)."""
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    d = d.withColumn("bucket", F.least(F.floor(F.col("u") / F.lit(2.0**63) * buckets), buckets - 1)).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    before = lambda keys, order: F.coalesce(F.sum("size").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of_buckets = d.groupBy("rank", "group", "bucket").agg(F.sum("size").alias("size"))
    of_groups = of_buckets.groupBy("rank", "group").agg(F.sum("size").alias("size"))
    of_groups = of_groups.select(F.col("rank").alias("g_rank"), F.col("group").alias("g_group"), before(["rank"], ["group"]).alias("g_begin"))
    of_buckets = of_buckets.withColumn("b_begin", before(["rank", "group"], ["bucket"]))
    of_buckets = of_buckets.join(of_groups, (F.col("rank") == F.col("g_rank")) & (F.col("group") == F.col("g_group")))
    of_buckets = of_buckets.select(F.col("rank").alias("b_rank"), F.col("bucket").alias("b_bucket"), (F.col("g_begin") + F.col("b_begin")).alias("before"))
    own = d.withColumn("begin", before(["rank", "bucket"], ["u", "doc_id", "row"]))
    joined = own.join(of_buckets, (F.col("rank") == F.col("b_rank")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.withColumn("begin", F.col("begin") + F.col("before")).drop("b_rank", "b_bucket", "before", "bucket", "group")


def drawn_pieces(d: DataFrame, block_words: int) -> DataFrame:
    """row, doc_id, rank, drawn (number of the block among those the source gives), start, length: the words of each document in each drawn block."""
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    d = d.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("begin"), F.col("block") * block_words)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
    turn = F.greatest(F.col("blocks") - 1, F.lit(1))
    place = F.when(F.col("block") == F.col("blocks") - 1, F.col("block")).otherwise(F.pmod(F.col("block") * F.col("stride") + F.col("shift"), turn))
    d = d.withColumns({"start": low - F.col("begin"), "length": high - low, "inside": low - F.col("block") * block_words, "place": place})
    d = d.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    # In the last pass, which isn't whole, a block may be drawn in part or not at all.
    of_last = F.when(F.col("place") < F.col("whole"), F.col("length")).when(F.col("place") == F.col("whole"), F.least(F.col("length"), F.col("cut") - F.col("inside"))).otherwise(0)
    d = d.withColumn("length", F.when(F.col("pass") < F.col("passes"), F.col("length")).otherwise(of_last)).where("length > 0")
    return d.select("row", "doc_id", "rank", (F.col("pass") * F.col("blocks") + F.col("place")).alias("drawn"), "start", "length")


class Mix(NamedTuple):
    """documents: row, doc_id, source, size, source_size, target of every row. pieces: row, doc_id, rank, drawn, start, length, shard, position of what each shard holds, in shuffled order."""

    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    spark = docs.sparkSession
    rows = sized(docs, seed, id_col, text_col, source_col)
    of_sources = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(of_sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = quotas([(r["source"], r["n"], r["size"]) for r in of_sources], block_words, seed)
    names = "rank int, s_source string, rows long, source_size long, target double, passes long, blocks long, whole long, cut long, quota long, stride long, shift long"
    known = spark.createDataFrame([tuple(s) for s in sources], names)
    documents = rows.join(known, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "quota")
    total = sum(s.quota for s in sources)
    shards = max(1, -(-total // shard_blocks))
    pieces = drawn_pieces(with_begin(documents.where("size > 0")), block_words)
    # The plan grows with the input, which Spark's guess of its size doesn't know. A block's number is drawn once, so rows of one source spread over all tasks.
    plan = plan_blocks(spark, sources, shards, seed).withColumnsRenamed({"rank": "p_rank", "drawn": "p_drawn"}).hint("merge")
    placed = pieces.join(plan, (F.col("rank") == F.col("p_rank")) & (F.col("drawn") == F.col("p_drawn"))).drop("p_rank", "p_drawn")
    order = [F.xxhash64(F.lit(seed + 1), "doc_id", "rank", "drawn", "start"), "rank", "drawn", "start", "row"]
    position = F.row_number().over(W.partitionBy("shard").orderBy(*order)) - 1
    return Mix(documents.select("row", "doc_id", "source", "size", "source_size", "target"), placed.withColumn("position", position))


def taken_words(found: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: words of its pieces in all shards."""
    taken = found.pieces.groupBy(F.col("row").alias("t_row")).agg(F.sum("length").alias("taken"))
    joined = found.documents.join(taken, F.col("row") == F.col("t_row"), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

