"""BPE encoding and decoding with a pair occurrence index.

Words that a partition meets for the first time go together into one arena of symbols. Each
mergeable pair keeps the list of all its positions in the arena; active ranks are applied in
ascending order, a rank to all its positions at once, and the lists of the pairs next to a merge
are updated. A word's ids are kept for the words to come, up to a bound.

Defined results: a null text counts as empty (no ids, empty decoded text); repeated rows give
repeated results; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from starloom.llm.common import id_text

#: Words a worker process keeps encoded; beyond it the store starts anew.
KEPT_WORDS = 600_000
#: Characters that the vocabulary's pattern takes for white space.
SPACES = r"\t-\r \x85\xa0  -     　"
#: Letters and digits of Unicode versions that the vocabulary's library doesn't know yet; it takes them for symbols.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals that the library lowers and Python doesn't know yet.
LOWERED = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWERED |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
HAS_NEWER = regex.compile(f"[{NEWER}{''.join(map(chr, LOWERED))}]")
WORDS_NEWER = regex.compile(rf"(?V1){CONTRACTIONS}|[\p{{L}}--[{NEWER}]]+|[\p{{N}}--[{NEWER}]]|(?:[^{SPACES}\p{{L}}\p{{N}}]|[{NEWER}])+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class WordBpe:
    """Lower-casing word BPE with word ends, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.inner = [self.vocab[x] for x in byte_letters()]
        self.last = [self.vocab[x + end] for x in byte_letters()]
        self.merges: dict[int, tuple[int, int]] = {}
        self.pairs: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.vocab[left] << 20 | self.vocab[right]
            self.pairs.append(pair)
            self.merges[pair] = rank, self.vocab[left + right]
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter, a sigma at a word's end stays an inner one.
        newer = not text.isascii() and HAS_NEWER.search(text)
        text = text.replace("Σ", "σ").lower()
        return WORDS_NEWER.findall(text.translate(LOWERED)) if newer else WORDS.findall(text)

    def parts(self, text: str) -> list[str]:
        """Words and special tokens of ``text``, in order; a special token stands as it is written."""
        if not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.splits.split(text) for w in ([part] if part in self.special else self.words(part))]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words by the pair occurrence index and keeps them."""
        words = [w for w in words if w not in self.known]
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known.clear()
        symbols: list[int] = []
        following: list[int] = []
        before: list[int] = []
        first: list[int] = []
        places: dict[int, list[int]] = {}
        merges, inner, last = self.merges, self.inner, self.last
        for word in words:
            data = word.encode()
            begin, n = len(symbols), len(data)
            first.append(begin)
            symbols += [inner[b] for b in data[:-1]]
            symbols.append(last[data[-1]])
            following += range(begin + 1, begin + n)
            following.append(-1)
            before.append(-1)
            before += range(begin, begin + n - 1)
            for i in range(begin, begin + n - 1):
                found = merges.get(symbols[i] << 20 | symbols[i + 1])
                if found:
                    places.setdefault(found[0], []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            pair = self.pairs[rank]
            left, right, new = pair >> 20, pair & 0xFFFFF, merges[pair][1]
            spots = places.pop(rank)
            if left == right:
                spots.sort()  # of overlapping occurrences the leftmost merges
            for i in spots:
                j = following[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue  # a merge has taken one side meanwhile
                after = following[j]
                symbols[i], symbols[j] = new, -1
                following[i] = after
                if after >= 0:
                    before[after] = i
                    found = merges.get(new << 20 | symbols[after])
                    if found:
                        if found[0] not in places:
                            places[found[0]] = []
                            heapq.heappush(active, found[0])
                        places[found[0]].append(i)
                k = before[i]
                if k >= 0:
                    found = merges.get(symbols[k] << 20 | new)
                    if found:
                        if found[0] not in places:
                            places[found[0]] = []
                            heapq.heappush(active, found[0])
                        places[found[0]].append(k)
        for word, i in zip(words, first):
            ids = []
            while i >= 0:
                ids.append(symbols[i])
                i = following[i]
            self.known[word] = tuple(ids), " ".join(map(str, ids))
        for token, i in self.special.items():
            self.known[token] = (i,), str(i)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of each text, as a list and as decimals joined by one space."""
        for begin in range(0, len(texts), 256):
            split = [self.parts(t) for t in texts[begin : begin + 256]]
            new = set().union(*split)
            if not self.known.keys() >= new:
                if len(self.known) + len(new) > KEPT_WORDS:
                    self.known.clear()
                self.learn(sorted(new - self.known.keys()))
            for words in split:
                found = [self.known[w] for w in words]
                yield [i for ids, _ in found for i in ids], " ".join([s for _, s in found])

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space: the vocabulary names no decoder that would do more."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _texts(column: pa.Array) -> list[str]:
    return column.to_pylist()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            ids = pa.array([ids for ids, _ in bpe.encode_batch(_texts(batch.column(1)))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text that the ids stand for (null ids: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"`{id_col}` doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass; keeps the count and digests instead of the arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for ids, decimals in bpe.encode_batch(_texts(batch.column(1))):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(decimals.encode()).hexdigest())
                of_texts.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
