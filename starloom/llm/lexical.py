"""Ranked lexical search by best-first branch and bound over trees of maxima.

Items (queries) are searched in blocks of bounded size: a block's terms go to all tasks. One pass over
the texts keeps, for each document, how often it holds each of the block's terms; from it come the
counts of documents by term. A second pass over these postings cuts them into ranges of documents and
builds, for each term, a tree of the highest impact in ever wider ranges. A range of documents can
score no more than the sum of its terms' maxima, so the search opens the range with the highest sum
first and stops where no sum reaches the last score it would return; sums equal to it are opened,
since ties go to the smaller id. Each task hands on its own best documents of each item.

Scores are whole numbers throughout, so every order of work gives the same result.

Defined results: a null or empty text has no term, and neither finds nor is found; rows with a null id
are ranked like others and come after all ids among equal scores; repeated documents are ranked each;
repeated items with the same id and text are searched once; an empty table gives no rows; columns
other than the ids and texts are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise

#: Documents that are returned for an item.
BEST = 50
#: Bytes of terms in a block of items, about.
BLOCK_BYTES = 4_000_000
#: Children of a node; documents and postings of a range, at most (but for one document).
FAN, RANGE_DOCUMENTS, RANGE_POSTINGS = 32, 32_768, 2_000_000
#: Nodes of one level that are opened together.
WAVE = 32
#: Lower-cases A-Z and turns what separates terms into spaces; bytes from 0x80 on belong to terms.
FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class MaxTree:
    """For each term, the highest impact in ranges of documents; level 0 has the documents, the last level one node."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.lexsort((doc, term))
        term, at, best = term[order], doc[order], impact[order]
        self.sizes, self.keys, self.best = [], [], []
        while True:
            key = term * docs + at
            first = np.flatnonzero(np.diff(key, prepend=-1))
            term, at, best = term[first], at[first], np.maximum.reduceat(best, first) if len(first) else best
            self.sizes.append(docs)
            self.keys.append(key[first])
            self.best.append(best)
            if docs == 1:
                return
            docs, at = -(-docs // FAN), at // FAN

    def sums(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children of ``nodes`` that hold a term, the sum of their weighted maxima): children are on ``level``."""
        size, keys = self.sizes[level], self.keys[level]
        begin = nodes * FAN
        base = terms[:, None] * size
        low = np.searchsorted(keys, (base + begin).ravel())
        high = np.searchsorted(keys, (base + np.minimum(begin + FAN, size)).ravel())
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, node = np.divmod(np.repeat(np.arange(len(n)), n), len(nodes))
        slot = node * FAN + keys[at] - terms[row] * size - begin[node]
        sums = np.zeros(len(nodes) * FAN, np.int64)
        np.add.at(sums, slot, weights[row] * self.best[level][at])
        found = np.flatnonzero(sums)
        return begin[found // FAN] + found % FAN, sums[found]


class Best:
    """The highest scores so far: by score, then by id, null last."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """The score that a document needs to be looked at."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        s, d, z = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((d, z, -s))[: self.most]
        self.score, self.doc, self.null = s[order], d[order], z[order]


def search(tree: MaxTree, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Adds to ``best`` what the tree holds of it; returns the number of documents scored."""
    open_nodes: list[tuple[int, int, int]] = []
    scored = 0

    def expand(level: int, nodes: np.ndarray) -> None:
        nonlocal scored
        children, sums = tree.sums(level, nodes, terms, weights)
        enough = sums >= best.least()
        children, sums = children[enough], sums[enough]
        if level == 0:
            scored += len(children)
            best.add(sums, ids[children], null[children])
        else:
            for child, bound in zip(children.tolist(), sums.tolist()):
                heapq.heappush(open_nodes, (-bound, level, child))

    # Above the last level stands a node with the whole range below it.
    expand(len(tree.sizes) - 1, np.zeros(1, np.int64))
    while open_nodes and -open_nodes[0][0] >= best.least():
        level, wave = open_nodes[0][1], []
        while open_nodes and open_nodes[0][1] == level and len(wave) < WAVE and -open_nodes[0][0] >= best.least():
            wave.append(heapq.heappop(open_nodes)[2])
        expand(level - 1, np.array(wave, np.int64))
    return scored


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number), item_id, terms (distinct, in order), size (their bytes) of each item that has a term; written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({*terms_of(t.as_py().encode())}) for t in batch.column(1)]
            sizes = [sum(map(len, t)) + 8 * len(t) for t in terms]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(sizes, pa.int64())], ["item_id", "terms", "size"])

    kind = items.schema[id_col].dataType.simpleString()
    d = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    found = d.mapInArrow(run, f"item_id {kind}, terms array<binary>, size long").where("size > 0")
    return materialise(found.withColumn("item", F.monotonically_increasing_id()), "items")


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows (item, terms) in blocks of about ``block_bytes`` bytes of terms; an item larger than that stands alone at most."""
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    blocks = -(-total // block_bytes)
    while blocks:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        fullest = dealt.groupBy("block").agg(F.sum("size").alias("s"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("s") > 4 * block_bytes))
        if fullest.isEmpty():
            for k in range(blocks):
                yield dealt.where(F.col("block") == k).select("item", "terms").orderBy("item").collect()
            return
        blocks *= 2


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tf (the terms of ``vocabulary`` that the text holds, and how often)."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        wanted = number.__contains__
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch.column(1):
                terms = terms_of(text.as_py().encode())
                held = Counter(filter(wanted, terms))
                n.append(len(terms))
                ids.append([number[t] for t in held])
                tfs.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tf"])

    return docs.where("text is not null").mapInArrow(run, "doc_id long, n long, ids array<int>, tf array<long>")


def best_of_tasks(held: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n: int, length: int, best: int) -> DataFrame:
    """item, doc_id, score: for each item, the ``best`` documents of each task's own."""
    sent = held.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(best) for _ in sent.value]
        waiting: list[pa.RecordBatch] = []

        def work() -> None:
            part = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            docs = part.num_rows
            lists, tfs = part.column("ids").combine_chunks(), part.column("tf").combine_chunks()
            doc = np.repeat(np.arange(docs), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
            m = 50 + (50 * part.column("n").to_numpy() * n) // length
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            ids = part.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy()
            tree = MaxTree(term, doc, impact, docs)
            for (_, terms, weights), own in zip(sent.value, found):
                search(tree, terms, weights, numbers, null, own)

        rows = cells = 0
        for batch in batches:
            # Batches are cut so that a range stays within its bounds.
            ends = batch.column(2).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                last = int(np.searchsorted(ends, ends[at] + RANGE_POSTINGS - cells, side="right")) - 1
                upto = min(max(last, at + (rows == 0)), at + RANGE_DOCUMENTS - rows, batch.num_rows)
                if upto > at:
                    waiting.append(batch.slice(at, upto - at))
                    rows, cells = rows + upto - at, cells + int(ends[upto] - ends[at])
                    at = upto
                if at < batch.num_rows:
                    work()
                    rows = cells = 0
        if waiting:
            work()
        for (item, _, _), own in zip(sent.value, found):
            if len(own.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.score), item)), pa.array(own.doc, mask=own.null), pa.array(own.score)], ["item", "doc_id", "score"])

    return held.where(F.size("ids") > 0).mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents with a score above 0 of each item."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_items = item_terms(items, item_col, item_text_col)
    out = None
    for block in item_blocks(of_items, block_bytes):
        vocabulary = sorted({bytes(t) for row in block for t in row["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        held = materialise(postings(d, vocabulary), "postings")
        sums = held.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        # A row for each term of the block.
        df = {r["id"]: r["count"] for r in held.select(F.explode("ids").alias("id")).groupBy("id").count().collect()}
        queries = []
        for row in block:
            terms = np.array([i for i in (number[bytes(t)] for t in row["terms"]) if i in df], np.int64)
            queries.append((row["item"], terms, np.array([weight(sums["n"], df[int(i)]) for i in terms], np.int64)))
        top = best_of_tasks(held, [q for q in queries if len(q[1])], sums["n"], max(sums["length"], 1), best)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = materialise(top.withColumn("rank", place).where(F.col("rank") <= best), "ranked")
        discard(held)
        out = ranked if out is None else out.unionByName(ranked)
    named = of_items.select("item", "item_id")
    if out is None:
        return named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out.join(named, "item").select("item_id", "rank", "doc_id", "score")
