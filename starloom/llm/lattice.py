"""Language-model scoring by the likelihood of all segmentations of a text into subwords.

The pieces of an existing vocabulary weight the segmentations of each word, of which a character may
also be spelt in bytes: a word's lattice probability is the sum over all its segmentations, found by
a forward recursion in logs. The vocabulary at hand is a BPE one whose scores are merge ranks; they
count as 1 / (rank + 100). One round of expected pieces over the distinct training words refits the
weights, of which the vocabulary's own keep the share OWN whatever the input's size.

A text's probability is the product over its words and its end, each summed over all its
segmentations. Among a word's segmentations is the word as one piece, if training texts hold it: such
a piece weighs c / (N + V), its count, and all segmentations into the vocabulary's pieces share
V / (N + V) (Witten-Bell). So the marginal of a word is (c + V * lattice) / (N + V), counts enter as
weights of pieces only, and the probabilities of all words sum to one at most.

Each distinct word is segmented once: counts of words meet in Spark, and the documents' word counts
join the scored words. The COMMON commonest words, and the end, which stands in every text, are
looked up inside tasks instead; that changes no result. Words join by 96 bits of hashes of their bytes.

Defined results: a null text counts as empty and has only its end; with nothing to learn from, the
vocabulary's scores are used as they are; rows with a null id are scored and not learned from;
repeated rows are scored each; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise
from starloom.llm.hashindex import HashIndex

#: Words a task counts before it passes the counts on; word and start cells of one block of lattices.
HELD_WORDS, CELLS = 400_000, 200_000
#: Share of the vocabulary's own weights among the refitted ones, of bytes among pieces at the start, and of the end among what words a lattice gives.
OWN, BYTES, ENDS = 0.1, 0.001, 0.01
#: Words that are looked up inside tasks, at least one.
COMMON = 20_000
BASE = np.uint64(1_000_003)
BEGIN = "▁"
SPREAD_NAMES = "row doc_id learn h h2 n n_tokens n_known logs score".split()


def word_hash(word: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(word) - (1 << 63), zlib.crc32(word)


class Pieces:
    """Pieces of a vocabulary, found by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in own]
        hashes: dict[int, float] = {}
        for text, i in zip(texts, own):
            hashes.setdefault(self.hash(text), -model.get_score(i))
        self.longest = max(map(len, texts))
        self.index = HashIndex(np.array(list(hashes), np.uint64))
        weight = 1 / (np.array(list(hashes.values())) + 100)
        self.start = weight / weight.sum()

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """Lattices of words of one length; all words advance together."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.n, self.length = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(self.n, self.length)
        self.bytes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        # edges[j]: (i, words that have the piece from i to j, its number)
        self.edges: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        step = points.astype(np.uint64) + np.uint64(1)
        for i in range(self.length):
            h = np.zeros(self.n, np.uint64)
            for j in range(i + 1, min(self.length, i + pieces.longest) + 1):
                h = h * BASE + step[:, j - 1]
                found = pieces.index.find(h)
                at = np.flatnonzero(found >= 0)
                if len(at):
                    self.edges[j].append((i, at, found[at]))

    def forward(self, logs: np.ndarray, byte: float) -> np.ndarray:
        alpha = np.full((self.length + 1, self.n), -np.inf)
        alpha[0] = 0
        for j in range(1, self.length + 1):
            alpha[j] = alpha[j - 1] + byte * self.bytes[:, j - 1]
            for i, at, piece in self.edges[j]:
                alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + logs[piece])
        return alpha

    def expect(self, logs: np.ndarray, byte: float, weight: np.ndarray, counts: np.ndarray) -> float:
        """Adds the expected uses of each piece to ``counts``; returns those of bytes."""
        alpha = self.forward(logs, byte)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        whole, spelt = alpha[-1], 0.0
        for j in range(self.length, 0, -1):
            down = beta[j] + byte * self.bytes[:, j - 1]
            beta[j - 1] = np.logaddexp(beta[j - 1], down)
            spelt += float((weight * self.bytes[:, j - 1] * np.exp(alpha[j - 1] + down - whole)).sum())
            for i, at, piece in self.edges[j]:
                over = logs[piece] + beta[j, at]
                beta[i, at] = np.logaddexp(beta[i, at], over)
                counts += np.bincount(piece, weight[at] * np.exp(alpha[i, at] + over - whole[at]), len(counts))
        return spelt


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and marked words, in blocks of equal length."""
    groups: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w) + 1].append(k)
    for length, own in groups.items():
        block = max(1, CELLS // length)
        for at in range(0, len(own), block):
            part = own[at : at + block]
            yield part, [BEGIN + words[k] for k in part]


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: uses in the training texts of every word of any text; the empty word stands for the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter = Counter()
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            words = list(seen | learned.keys())
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([learned[w] for w in words], pa.int64())], ["word", "c"])
            learned.clear()
            seen.clear()
            return out

        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                words = text.as_py().encode().lower().split()
                if learn:
                    learned.update(words)
                    learned[b""] += 1
                else:
                    seen.update(words)
                    seen.add(b"")
                if len(seen) + len(learned) > HELD_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text", "learn").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, vocabulary: str) -> tuple[np.ndarray, float]:
    """(log probability of each piece, of a byte) from the pieces expected in the distinct training words."""
    start = pieces_of(vocabulary).start
    size = len(start)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(vocabulary)
        logs, byte = np.log(own.start * (1 - BYTES)), math.log(BYTES / 256)
        counts, spelt = np.zeros(size), 0.0
        for batch in batches:
            for at, marked in by_length(batch.column(0).to_pylist()):
                spelt += Lattices(own, marked).expect(logs, byte, np.ones(len(at)), counts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int64()), pa.array([*counts[used], spelt])], ["piece", "n"])

    found = words.where("c > 0 and word <> ''").select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    by_piece = {r["piece"]: r["n"] for r in found}
    counts, spelt = np.array([by_piece.get(i, 0.0) for i in range(size)]), by_piece.get(-1, 0.0)
    total = counts.sum() + spelt
    share = 1.0 if not total else OWN
    pieces = (1 - share) * counts / max(total, 1.0) + share * (1 - BYTES) * start
    return np.log(pieces), math.log(((1 - share) * spelt / max(total, 1.0) + share * BYTES) / 256)


def score_words(words: DataFrame, vocabulary: str, model: tuple[np.ndarray, float], n: int, v: int) -> DataFrame:
    """h, h2, c, log10_p of each word; ``n`` training tokens, ``v`` distinct ones."""
    frozen = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(vocabulary)
        logs, byte = frozen.value
        # A word is a marked piece and any number of others, so all words together have begins / (1 - rest) = 1.
        whole = math.log1p(-ENDS)
        for batch in batches:
            texts, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            out = np.full(len(texts), math.log(ENDS))
            filled = [k for k, t in enumerate(texts) if t]
            for at, marked in by_length([texts[k] for k in filled]):
                out[[filled[k] for k in at]] = whole + Lattices(own, marked).forward(logs, byte)[-1]
            p = np.log10((c + max(v, 1) * np.exp(out)) / (n + max(v, 1)), where=c > 0, out=(out + math.log(max(v, 1) / (n + max(v, 1)))) / math.log(10))
            hashes = [word_hash(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in hashes], pa.int64()), pa.array([h for _, h in hashes], pa.int64()), batch.column(1), pa.array(p)], ["h", "h2", "c", "log10_p"])

    return words.select("word", "c").mapInArrow(run, "h long, h2 long, c long, log10_p double")


def spread_words(docs: DataFrame, scored: DataFrame, common: int = COMMON) -> DataFrame:
    """What each row holds: row, doc_id, learn, h, h2, n (uses of a word), n_tokens, n_known, logs, score.

    One row for each word that isn't common, with its uses, and one for each document, without any
    and with the sums over its common words and its end.
    """
    top = scored.orderBy(F.desc("c"), "h", "h2").limit(common).toPandas().drop_duplicates("h")  # COMMON rows at most
    frozen = docs.sparkSession.sparkContext.broadcast(tuple(top[k].to_numpy() for k in ("h", "h2", "c", "log10_p")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        h, h2, c, log10_p = frozen.value
        index = HashIndex(h.view(np.uint64))
        logs, seen = np.log10(c + 1.0), c > 0
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hashes: list[tuple[int, int]] = []
                uses: list[int] = []
                sizes = []
                for text in part.column(1):
                    counted = Counter(text.as_py().encode().lower().split())
                    counted[b""] = 1
                    for w in counted:
                        if w not in known:
                            known[w] = word_hash(w)
                    hashes += [known[w] for w in counted]
                    uses += counted.values()
                    sizes.append(len(counted))
                if len(known) > HELD_WORDS:
                    known.clear()
                own, times, keys = np.repeat(np.arange(part.num_rows), sizes), np.array(uses, np.int64), np.array(hashes, np.int64)
                found = index.find(keys[:, 0].copy().view(np.uint64))
                found[(found >= 0) & (h2[found] != keys[:, 1])] = -1
                near, far = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
                here, n = found[near], times[near]
                sums = [np.bincount(own[near], w, part.num_rows) for w in (n, n * seen[here], n * logs[here], n * log10_p[here])]
                rows = np.concatenate([own[far], np.arange(part.num_rows)])
                zeros, again = np.zeros(len(far)), pa.array(rows)
                columns = [
                    pa.array(rows + row),
                    part.column(0).take(again),
                    part.column(2).take(again),
                    # A document's own row joins no word; its number spreads it.
                    pa.array(np.concatenate([keys[far, 0], (np.arange(part.num_rows) + row) * 0x5851F42D4C957F2D])),
                    pa.array(np.concatenate([keys[far, 1], np.full(part.num_rows, -1)])),
                    pa.array(np.concatenate([times[far], np.zeros(part.num_rows, np.int64)])),
                    *[pa.array(np.concatenate([zeros, s]).astype(kind)) for s, kind in zip(sums, (np.int64, np.int64, float, float))],
                ]
                yield pa.RecordBatch.from_arrays(columns, SPREAD_NAMES)
                row += part.num_rows

    return docs.select("doc_id", "text", "learn").mapInArrow(run, "row long, doc_id long, learn boolean, h long, h2 long, n long, n_tokens long, n_known long, logs double, score double")


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", learn_col: str = "learn") -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score (log10) of every document.

    ``learn_col`` (boolean, null: false) marks the documents to learn from.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(learn_col), F.lit(False)).alias("learn"))
    words = materialise(count_words(d), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    scored = materialise(score_words(words, vocabulary, fit(words, vocabulary), sums["n"], sums["v"]), "scored")
    discard(words)
    joined = spread_words(d, scored).join(scored.select(F.col("h").alias("w_h"), F.col("h2").alias("w_h2"), "c", "log10_p"), (F.col("h") == F.col("w_h")) & (F.col("h2") == F.col("w_h2")), "left")
    of_words = lambda value: F.coalesce(F.col("n") * value, F.lit(0))
    sums_of = joined.groupBy("row", "doc_id", "learn").agg(
        F.sum(F.col("n_tokens") + F.col("n")).alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).cast("long").alias("n_known"),
        F.sum(F.col("logs") + of_words(F.log10(F.col("c") + 1.0))).alias("logs"),
        F.sum(F.col("score") + of_words(F.col("log10_p"))).alias("score"),
    )
    below = math.log10(sums["n"] + sums["v"] + 1)
    return sums_of.select("doc_id", "learn", "n_tokens", "n_known", F.lit(int(sums["n"])).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")
