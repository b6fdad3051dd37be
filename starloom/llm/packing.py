"""Packing token sequences into fixed windows by best-fit decreasing.

A document's ids are cut into full windows and one remainder. Full windows stand alone; remainders
are packed, longest first, each into the open window with the tightest remaining capacity, found
by a segment tree over capacities. Remainders are packed in blocks of bounded size that a hash of
the piece and its number deals out, so that null and repeated ids spread too and no task holds more than a block and a block's result depends only on
its own rows: a lost executor's blocks come out the same again.

Defined results: a null text counts as empty (its one id is the end id); rows with a null id are
packed like others; repeated rows are separate documents; an empty table gives no pieces; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import id_text, materialise

WINDOW = 2048
#: Remainders that one block holds in the mean.
BLOCK = 2048
END_ID = 1
END_OF_TEXT = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def byte_encoder(ranks_path: str, pattern: str):
    """The byte-level BPE whose merges are the ranks in ``ranks_path``; one for each worker process."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


@lru_cache(maxsize=2)
def reference_encoder(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def byte_ids(text: str, ranks_path: str, pattern: str, json_path: str) -> list[int]:
    """Ids of ``text``. A run of white space too long for the fast encoder's regex goes to the slow one."""
    try:
        return byte_encoder(ranks_path, pattern).encode(text, allowed_special="all")
    except (ValueError, RuntimeError):
        return reference_encoder(json_path).encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, encode, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids plus ``end_id``, cut into full windows and a remainder.

    ``encode`` maps a text to its list of ids. One row a piece: doc_id, start, length, ids_crc32,
    doc_tokens, and the ids themselves if ``with_ids``.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    row = (doc_id, start, len(piece), zlib.crc32(piece), len(ids))
                    for column, value in zip(out, row + ((piece.astype("i4"),) if with_ids else ())):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


class OpenWindows:
    """Segment tree over remaining capacities; a leaf holds the open windows with that capacity left."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.full = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.full[node]:
            self.full[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``size``, taken out; else None."""
        node = self.leaves + size
        full = self.full
        if not full[node]:
            while node > 1 and (node & 1 or not full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not full[2 * node])
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            full[node] = 0
            node >>= 1
            while node and not (full[2 * node] or full[2 * node + 1]):
                full[node] = 0
                node >>= 1
        return capacity, window


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each length, given longest first."""
    tree, at, offsets, opened = OpenWindows(window), [], [], 0
    for size in lengths:
        found = tree.take(size)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, number = found
        at.append(number)
        offsets.append(window - capacity)
        if capacity > size:
            tree.add(capacity - size, number)
    return at, offsets


def pack(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``window`` ids."""
    # A number of its own for each piece, fixed by being written.
    pieces = materialise(pieces.withColumn("piece_number", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-pieces.count() // block))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "piece_number")

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("piece_number", "ascending")]).drop_columns(["block", "piece_number"])
        at, offsets = best_fit(table.column("length").to_pylist(), window)
        base = key[0].as_py() << 32
        return table.append_column("sequence_id", pa.array([base + x for x in at], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "piece_number"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(fill, schema + ", sequence_id long, offset long")
