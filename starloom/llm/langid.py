"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes holds how often each byte followed.
All contexts of a byte are blended: each gives its counts' share and passes the probability of its
escape (method C) to the next shorter one, so that the probabilities of all bytes sum to one; below
the empty context all bytes are alike. Statistics are frozen after learning; a text goes to the language that gives
it the shortest code, and the score is that language's posterior under even priors.

Learning reads the whole texts of all labelled rows. The counts meet in Spark, one row for each
language and four bytes, and the model is as large as the distinct four bytes of the texts, not as
the texts.

The score only tells the learned languages from each other. Whether a text is in any of them its code
length by one tree of all learned words tells (``learn_words``, ``code_bits``); words are runs of
letters in lower case, without what digits are mixed into (``words_of``). ``bounds`` gives the bits a
byte that a text may take: all labelled rows are dealt into halves by a hash of the text and each is
coded by the other half's tree; a language's bound is the geometric mean of its rows' median and of
the 8 bits a byte takes that nothing is known of.

Defined results: a null text and a text without letters are ``und`` with score 0, as is every text
if nothing could be learned; rows with a null language aren't learned from; ties go to the language
that is first in order; repeated rows count as often as they come; an empty table gives no rows;
columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.hashindex import HashIndex

UNKNOWN = "und"
PAD = 10
#: Bits that a byte takes of which nothing is known.
UNLEARNED = 8
#: Numbers that one block of scores holds, and bytes of the texts that are looked at together, unless one text has more.
BLOCK, PART = 1_000_000, 1_000_000


def four_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte the code of it and the three before it, oldest first; before a text stand line ends."""
    code = data.astype(np.uint64)
    for back in (1, 2, 3):
        shifted = np.full(len(data), PAD, np.uint64)
        shifted[back:] = data[:-back]
        for k in range(back):
            at = starts[sizes > k] + k
            shifted[at] = PAD
        code |= shifted << np.uint64(8 * back)
    return code


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, where each starts, and their sizes."""
    parts = [t.encode() for t in texts.to_pylist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def parts(texts: pa.Array) -> Iterator[slice]:
    """Ranges of texts with at most PART characters together."""
    at = size = 0
    for i, n in enumerate(pc.utf8_length(texts).fill_null(0).to_pylist()):
        if size and size + n > PART:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def count_contexts(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, code, n: how often each byte followed three others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for r in parts(batch.column(1)):
                part, own = batch.slice(r.start, r.stop - r.start), langs[r]
                for lang in dict.fromkeys(own):
                    data, starts, sizes = buffers(part.column(1).filter(pa.array(own == lang)))
                    codes, n = np.unique(four_bytes(data, starts, sizes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text is not null and lang is not null").mapInArrow(run, "lang string, code long, n long")
    return counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Log probabilities of all languages' trees, laid out for lookups by whole arrays."""

    def __init__(self, langs: list[str], code: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs = langs
        size = len(langs)
        below = np.full((1 << 8, size), -8 * np.log(2))
        self.orders: list[tuple[HashIndex, np.ndarray, HashIndex, np.ndarray]] = []
        for width in (1, 2, 3, 4):
            own = code & ((1 << 8 * width) - 1)
            keys, at = np.unique(own, return_inverse=True)
            count = np.zeros((len(keys), size))
            np.add.at(count, (at, lang), n)
            contexts, above = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, above, count)
            np.add.at(kinds, above, count > 0)
            whole = np.maximum(total + kinds, 1)
            escape = np.where(kinds > 0, np.log(np.maximum(kinds, 1) / whole), 0.0)
            lower = self._lower(keys & ((1 << 8 * (width - 1)) - 1), width - 1, below)
            value = np.log(count / whole[above] + np.exp(escape[above] + lower))
            self.orders.append((HashIndex(keys), value.astype(np.float32), HashIndex(contexts), escape.astype(np.float32)))

    def _lower(self, codes: np.ndarray, width: int, below: np.ndarray) -> np.ndarray:
        return self.log_probability(codes.astype(np.uint64), width) if width else below[np.zeros(len(codes), int)]

    def log_probability(self, codes: np.ndarray, width: int = 4) -> np.ndarray:
        """A row of natural logs for each code, one column a language."""
        if not width:
            return np.full((len(codes), len(self.langs)), -8 * np.log(2), np.float32)
        keys, value, contexts, escape = self.orders[width - 1]
        at = keys.find(codes)
        out = value[at] if len(value) else np.zeros((len(codes), len(self.langs)), np.float32)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            lost = codes[missed]
            more = self.log_probability(lost & np.uint64((1 << 8 * (width - 1)) - 1), width - 1)
            seen = contexts.find(lost >> np.uint64(8))
            more = more + np.where((seen >= 0)[:, None], escape[seen], 0) if len(escape) else more
            out[missed] = more
        return out

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score of each text."""
        total = self.totals(texts)
        best = total.argmax(axis=1)
        return best, 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Log probability of each text, one column a language."""
        data, starts, sizes = buffers(texts)
        codes = four_bytes(data, starts, sizes)
        total = np.zeros((len(sizes), len(self.langs)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        step = max(1, BLOCK // len(self.langs))
        for at in range(0, len(codes), step):
            part = owner[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total[part[first]] += np.add.reduceat(self.log_probability(codes[at : at + step]), first, axis=0, dtype=np.float64)
        return total


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> ContextTrees | None:
    """Trees of the languages of all labelled ``rows``; None if there are none."""
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = sorted(r["lang"] for r in labelled.select(F.col(lang_col).alias("lang")).distinct().collect())
    if not langs:
        return None
    counts = count_contexts(labelled, lang_col, text_col).toArrow()
    return ContextTrees(langs, counts["code"].to_numpy(), pc.index_in(counts["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64), counts["n"].to_numpy())


def words_of(text: Column) -> Column:
    """The words of letters, in lower case and one space apart; null if there are none."""
    plain = F.regexp_replace(text.cast("string"), r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]++", " ")
    words = F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{M}]++", " "))
    return F.when(words != "", words)


def halves_of(words: Column) -> Column:
    """0 or 1: copies of a text are in one half."""
    return F.pmod(F.xxhash64(words, F.lit("half")), F.lit(2))


def learn_words(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> ContextTrees:
    """Trees of the words of all labelled rows: of both halves of them, of the first and of the second."""
    words = rows.where(F.col(lang_col).isNotNull()).select(words_of(F.col(text_col)).alias("words"))
    counts = count_contexts(words.withColumn("half", halves_of(F.col("words")).cast("string")), "half", "words").toArrow()
    code, n = (np.tile(counts[c].to_numpy(), 2) for c in ("code", "n"))
    half = pc.cast(counts["lang"], pa.int64()).to_numpy()
    return ContextTrees(["all", "first", "second"], code, np.concatenate([np.zeros_like(half), 1 + half]), n)


def bits_of(trees: ContextTrees, words: pa.Array, tree: np.ndarray) -> np.ndarray:
    """Bits that each text's words take by the tree of that number; NaN for null."""
    out = np.full(len(words), np.nan)
    known = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
    there = words.take(pa.array(known))
    for r in parts(there):
        out[known[r]] = -trees.totals(there.slice(r.start, r.stop - r.start))[np.arange(r.stop - r.start), tree[known[r]]] / np.log(2)
    return out


def rates(rows: DataFrame, trees: ContextTrees, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rate: bits a byte that the words of each labelled row take by the tree of the half that it isn't in."""
    frozen = rows.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def run(words: pa.Array, half: pa.Array) -> pa.Array:
        return pa.array(bits_of(frozen.value, words, 2 - half.to_numpy(zero_copy_only=False)))

    d = rows.select(F.col(lang_col).alias("lang"), words_of(F.col(text_col)).alias("words")).where("lang is not null and words is not null")
    return d.select("lang", (run(F.col("words"), halves_of(F.col("words"))) / F.octet_length("words")).alias("rate"))


def bounds(rows: DataFrame, trees: ContextTrees, lang_col: str = "lang", text_col: str = "text") -> dict[str, float]:
    """Bits a byte that the words of a text in each language may take. A language without words has none."""
    medians = rates(rows, trees, lang_col, text_col).groupBy("lang").agg(F.percentile_approx("rate", 0.5, 10_000).alias("rate")).collect()
    return {r["lang"]: math.sqrt(r["rate"] * UNLEARNED) for r in medians}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: ContextTrees | None, text_col: str = "text", trees: ContextTrees | None = None) -> DataFrame:
    """row (all columns of ``docs``), lang_pred, score of every document; with ``trees`` also words and bits, the code length of its words by the first of them."""
    rows = docs.select(F.struct("*").alias("row"), F.when(has_letter(F.col(text_col)), F.col(text_col).cast("string")).alias("text"))
    more = [] if trees is None else ["words", "bits"]
    if trees is not None:
        rows = rows.withColumn("words", words_of(F.col("text")))
    if model is None:
        return rows.withColumn("bits", F.lit(None).cast("double")).select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *more)
    frozen = docs.sparkSession.sparkContext.broadcast((model, trees))

    # Only texts reach Python, in one pass for both codes; the rows stay where they are.
    @F.arrow_udf("struct<best:int,score:double,bits:double>")
    def run(text: pa.Array, words: pa.Array) -> pa.Array:
        model, trees = frozen.value
        best, score = np.full(len(text), len(model.langs), np.int32), np.zeros(len(text))
        known = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
        there = text.take(pa.array(known))
        for r in parts(there):
            best[known[r]], score[known[r]] = model.judge(there.slice(r.start, r.stop - r.start))
        bits = np.full(len(text), np.nan) if trees is None else bits_of(trees, words, np.zeros(len(words), np.int64))
        return pa.StructArray.from_arrays([pa.array(best), pa.array(score), pa.array(bits)], ["best", "score", "bits"])

    names = F.array(*[F.lit(x) for x in (*model.langs, UNKNOWN)])
    found = rows.withColumn("found", run(F.col("text"), F.col("words") if more else F.lit(None).cast("string")))
    found = found.withColumns({"lang_pred": F.get(names, F.col("found.best")), "score": F.col("found.score"), "bits": F.nanvl("found.bits", F.lit(None).cast("double"))})
    return found.select("row", "lang_pred", "score", *more)
