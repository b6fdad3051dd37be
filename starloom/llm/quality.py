"""Quality rules in DataFrame functions only: base rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. One multinomial over buckets is
counted on the trusted target (all documents labelled good), one on the whole raw corpus. A document's
ratio is its mean log ratio over its n-grams. Both counts of a bucket start from the same
pseudo-count, which is as large as the chance of a count and not of a share, so that a bucket with
few n-grams says little whatever the size of the target.

The threshold is set by a stated rule from held-out documents: the target is dealt into halves, each
scored against the counts of the other; documents go that lie further below the median of these
ratios than STRETCH times the distance from the median to the LOW quantile, or what counts for it
at least. Where the target is
small its halves scatter and the threshold falls with them, so that clean documents stay.

Defined results: a null text has no words and fails the base rules; a document without n-grams has
ratio 0; with no labelled rows every ratio is 0 and only the base rules reject; repeated rows are
judged each; rows with a null id are judged and never trusted; an empty table gives no rows; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import discard, id_text, materialise

#: A power of two.
BUCKETS = 1 << 16
#: Pseudo-count of a bucket in the target and in what the raw corpus makes expect there.
PSEUDO = 3.0
#: The threshold lies STRETCH times as far below the median of the held-out ratios as their LOW quantile does; LEAST_SPREAD counts at least, and one over the root of their number, since few documents say little about the rest.
STRETCH, LOW, LEAST_SPREAD = 1.5, 0.01, 0.02
#: Ratios are compared in units of so small a part, and their quantiles found by counts in steps of so many units.
UNITS, STEPS = 1_000_000_000, (1_000_000, 1_000, 1)
SPACE = r"\x20\x09-\x0D"
MIN_WORDS = 50


def computed_once(value: Column) -> Column:
    """``value``, which Spark may not copy into filters above it: a copy there would be worked out for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def ones_of(words: str) -> Column:
    """A hash of every word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def twos_of(ones: str) -> Column:
    """A hash of every pair of neighbours. The last word has no second one and is left off."""
    pairs = F.zip_with(ones, F.slice(ones, 2, F.size(ones)), lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(ones) - 1, F.lit(0)))


def with_hashes(d: DataFrame) -> DataFrame:
    """ones and twos in place of ``words``."""
    return d.withColumn("ones", ones_of("words")).drop("words").withColumn("twos", twos_of("ones"))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs``), doc_id, ones, twos and the base counts of every document."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Each step is written as a row: what is no longer needed is left behind.
    d = d.select(
        "row",
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    d = d.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.char_length(F.array_join("words", "")).cast("long"), "ones": ones_of("words")})
    d = d.select("row", "doc_id", *counts, "ones", twos_of("ones").alias("twos"))
    windows = F.zip_with("twos", F.slice("ones", 3, F.size("ones")), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("windows", F.slice(windows, F.lit(1), F.greatest(F.size("ones") - 2, F.lit(0))))
    # Only texts in which a window repeats are sorted; the rest have no repeated words.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    d = d.withColumn("places", computed_once(F.array_sort(F.transform(again, lambda x: x["i"]))))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("row", "doc_id", "ones", "twos", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def bucket_of(h: Column, buckets: int = BUCKETS) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def mean_ratio(table: Column, buckets: int = BUCKETS) -> Column:
    """Mean of ``table`` over a document's ``hashes``."""
    total = F.aggregate("hashes", F.lit(0.0), lambda a, h: a + F.get(table, bucket_of(h, buckets)))
    return F.round(total / F.greatest(F.size("hashes"), F.lit(1)), 9)


def as_tables(spark: SparkSession, tables: dict[str, list[float]]) -> dict[str, Column]:
    """Each list of values as a column of one array, the same for every row.

    They are subqueries of one row and no constants, as the driver writes each plan out, and keeps it,
    with all its constants.
    """
    row = {name: pa.array([[float(f"{v:.7g}") for v in values]], pa.list_(pa.float64())) for name, values in tables.items()}
    one = spark.createDataFrame(pa.table(row))
    return {name: one.select(name).scalar() for name in tables}


def half_of(doc_id: Column) -> Column:
    """0 or 1: the half of the target that a document is in, if it is trusted."""
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2))


def count_buckets(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[int], list[list[int]]]:
    """N-grams of each bucket in the raw corpus, and in each half of the target.

    Counts are taken over all documents, meet as one row a bucket and task, and end as ``buckets`` rows.
    The number of ``target_ids`` grows with the corpus, so the texts are dealt out to them by id and
    the ids are never broadcast.
    """
    ids = target_ids.select(F.col("doc_id").alias("t_id"), half_of(F.col("doc_id")).alias("half")).hint("shuffle_hash")
    d = id_text(docs, id_col, text_col).join(ids, F.col("doc_id") == F.col("t_id"), "left").select(words_of(F.col("text")).alias("words"), "half")
    found = (
        with_hashes(d)
        .select(computed_once(F.concat("ones", "twos")).alias("hashes"), "half")
        .select(F.explode("hashes").alias("h"), "half")
        .groupBy(bucket_of(F.col("h"), buckets).alias("bucket"))
        .agg(F.count("*").alias("raw"), *[F.count_if(F.col("half") == k).alias(f"n{k}") for k in (0, 1)])
        .toArrow()
        .to_pydict()
    )
    raw, halves = [0] * buckets, [[0] * buckets, [0] * buckets]
    for to, name in ((raw, "raw"), (halves[0], "n0"), (halves[1], "n1")):
        for bucket, n in zip(found["bucket"], found[name]):
            to[bucket] = n
    return raw, halves


def ratio_table(raw: list[int], target: list[int], pseudo: float = PSEUDO) -> list[float]:
    """log(target / raw) of each bucket; both shares stand for as many n-grams as the target has."""
    n_target, n_raw = sum(target), sum(raw)
    if not n_target:
        return [0.0] * len(raw)
    return [math.log((t + pseudo) / (n_target * r / n_raw + pseudo)) for t, r in zip(target, raw)]


def values_at(units: DataFrame, ranks: Callable[[int], list[int]]) -> tuple[list[int], int]:
    """Exact values of the given ranks (from 0 on, a function of the number of rows) in the column ``units`` of longs, and that number.

    Rows are counted in wide steps, those of the steps with the ranks in narrower ones, and so on, so
    that what reaches the driver is as large as a step holds narrower ones, whatever the rows.
    """
    start = lambda width: F.col("units") - F.pmod("units", F.lit(width))
    inside, places, n = F.lit(True), [], 0
    for k, width in enumerate(STEPS):
        found = sorted((r["start"], r["n"]) for r in units.where(inside).groupBy(start(width).alias("start")).agg(F.count("*").alias("n")).collect())
        if not k:
            n = sum(c for _, c in found)
            places = [(None, rank) for rank in ranks(n)] if n else []
        if not places:
            return [], n
        for i, (above, rank) in enumerate(places):
            for at, c in found:
                if above is None or above <= at < above + STEPS[k - 1]:
                    if rank < c:
                        places[i] = (at, rank)
                        break
                    rank -= c
        inside = start(width).isin(sorted({at for at, _ in places}))
    return [at for at, _ in places], n


def threshold(held_out: DataFrame) -> float:
    """Least ratio of a document that is kept, from the column ``ratio`` of the target's halves against each other's counts."""
    shares = (0.5, LOW)
    units = materialise(held_out.select(F.round(F.col("ratio") * UNITS).cast("long").alias("units")), "held-out")
    found, n = values_at(units, lambda n: [f((n - 1) * q) for q in shares for f in (math.floor, math.ceil)])
    discard(units)
    if not n:
        return -math.inf
    parts = [(n - 1) * q % 1 for q in shares]
    median, low = (((1 - part) * found[2 * i] + part * found[2 * i + 1]) / UNITS for i, part in enumerate(parts))
    return median - STRETCH * max(median - low, LEAST_SPREAD, 1 / math.sqrt(n))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = True) -> DataFrame:
    """row (all columns of ``docs``; not without ``rows``), doc_id, the base counts, base_failed, ratio, least_ratio and kept of every document.

    Beside its own ratio a document has the one that counts if it is trusted, against the half that it
    isn't in. Without rows both are taken in one pass, written to the shared folder; texts aren't
    written there, and with rows they are judged once the threshold is known.
    """
    target_ids = trusted_ids(labels)
    raw, halves = count_buckets(docs, target_ids, id_col=id_col, text_col=text_col)
    tables = as_tables(docs.sparkSession, {name: ratio_table(raw, t) for name, t in (("whole", [a + b for a, b in zip(*halves)]), ("first", halves[0]), ("second", halves[1]))})
    held_out = computed_once(F.when(F.col("n_words") >= MIN_WORDS, F.when(half_of(F.col("doc_id")) == 0, mean_ratio(F.col("second"))).otherwise(mean_ratio(F.col("first")))))
    # Each table is used once and what lies below isn't copied up, so that Spark works it into its use and no row carries it.
    d = base_rules(docs, id_col, text_col).withColumn("hashes", computed_once(F.concat("ones", "twos"))).drop("ones", "twos").withColumns(tables)
    d = d.withColumns({"ratio": computed_once(mean_ratio(F.col("whole"))), "held_out": held_out}).drop("hashes", *tables)
    d = d if rows else materialise(d.drop("row"), "judged")
    least = -math.inf
    if all(map(sum, halves)):
        least = threshold(d.where("held_out is not null").select("doc_id", F.col("held_out").alias("ratio")).join(target_ids, "doc_id"))
    return d.drop("held_out").withColumn("least_ratio", F.lit(least)).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.col("least_ratio")))
