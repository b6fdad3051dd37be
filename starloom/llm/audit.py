"""Interaction audit of filters by a subset-zeta transform.

Every document gets a mask of the filters that it fails. Masks are counted by part, and the transform
turns a part's 32 counts into the number of survivors of every subset of filters: f(T) is the sum of
the counts of all masks within T, and what survives the filters S has a mask within the others. Each
step of each order then is a difference between two neighbouring subsets, for all documents and for
those that are labelled good or toxic; Shapley sums weigh the same differences by how many orders
have them.

Copies are found by 128 bits of a hash of their text. No document is joined to its group of copies:
the smallest id of each text is an aggregate, and a document is joined by text and id together.

Defined results: a null text counts as empty, so null and empty texts are copies of each other; a null
part counts as the empty string; a row with a null id fails no filter for copies and makes no other
row fail it; rows of one id are no copies of each other; several labels of an id count if any says so;
an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import materialise

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Mask of the filter for copies, which isn't judged by the text alone.
COPY = SUBSETS >> 1
UPPER, SYMBOLS = bytes(range(65, 91)), set(b"#$%&*|")


def mask_of(text: str) -> tuple[int, bytes]:
    """Filters A to D that a text fails, and the hash of the text."""
    raw = text.encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    mask = len(words) < 50
    mask |= (100 * len(set(words)) < 65 * len(words)) << 1
    mask |= (100 * upper > 5 * len(text)) << 2
    mask |= (not SYMBOLS.isdisjoint(raw)) << 3
    return int(mask), blake2b(raw, digest_size=16).digest()


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of A to D), digest of every row of (doc_id, part, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mask_of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m for m, _ in found], pa.int32()), pa.array([h for _, h in found], pa.binary())], ["doc_id", "part", "mask", "digest"])

    return docs.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    of_label = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(of_label("quality"), of_label("toxic"))
    rows = text_masks(d).join(said, F.col("doc_id") == F.col("l_id"), "left")
    # Rows that nothing tells apart are one row with a count from here on.
    rows = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    rows = materialise(rows, "masks")
    first = rows.groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("f_id"))
    joined = rows.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("doc_id") == F.col("f_id")), "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("f_id").isNull(), COPY).otherwise(0)
    return joined.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def zeta(counts: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Arrays of counts by mask become arrays of sums over all masks within a mask, one filter after the other."""
    def with_below(c: str, bit: int) -> Column:
        return F.transform(F.col(c), lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + F.get(F.col(c), i - bit)).otherwise(x))

    for bit in (1 << k for k in range(len(FILTERS))):
        counts = counts.withColumns({c: with_below(c, bit) for c in columns})
    return counts


def shapley(survivors: Column) -> Column:
    """For each filter, what it removes summed over all orders."""
    orders = F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))])
    after = lambda s: F.get(survivors, SUBSETS - 1 - s)

    def of(bit: Column) -> Column:
        step = lambda total, s: total + F.when(s.bitwiseAND(bit) == 0, F.get(orders, F.bit_count(s)) * (after(s) - after(s + bit))).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0).cast("long"), step)

    return F.transform(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), of)


def audit(counts: DataFrame) -> DataFrame:
    """Every step of every order of the filters for each part of ``counts`` (part, mask, n, good, toxic).

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    # 32 rows a part at most.
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("held"))
    masks = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    filled = lambda c: F.transform(masks, lambda m: F.coalesce(F.try_element_at(F.col("held"), m)[c], F.lit(0).cast("long")))
    filled_in = by_part.select("part", *[filled(c).alias(c) for c in ("n", "good", "toxic")])
    survivors = zeta(filled_in.withColumn("own", F.col("n")), ("n", "good", "toxic")).withColumn("sums", shapley(F.col("n")))

    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = survivors.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "bit": bits(F.substring("filter_order", F.col("step"), F.lit(1)))})
    left = lambda c, gone: F.get(F.col(c), SUBSETS - 1 - gone)
    before, after, bit = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    lost = lambda c: left(c, before) - left(c, after)
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    return steps.select(
        "part",
        "filter_order",
        "step",
        left("n", after).alias("kept"),
        lost("n").alias("removed"),
        (left("n", F.lit(0)) - left("n", bit) - lost("n")).alias("redundant"),
        F.get("own", bit).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("sums", place).alias("shapley"),
    )
