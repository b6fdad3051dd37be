import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import bpe, packing
from starloom.llm.queries import byte_bpe_encoder

WORD_JSON = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_JSON)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def test_round_trip_equals_the_library(odd, odd_rows, library):
    got = sorted(map(tuple, bpe.round_trip_digests(odd, WORD_JSON).collect()), key=repr)
    assert got == sorted(((r[0], *expected(library, r[1])) for r in odd_rows), key=repr)


def test_clashing_columns_and_empty_table(clashing, nothing, odd):
    assert bpe.round_trip_digests(clashing, WORD_JSON).count() == odd.count()
    assert bpe.round_trip_digests(nothing, WORD_JSON).count() == 0


def test_decode_is_the_inverse(odd, odd_rows, library):
    found = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd, WORD_JSON), WORD_JSON).collect()}
    assert found[1] == library.decode(library.encode(odd_rows[0][1], add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abtheins'sΣI \t́é<|>"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    library, own = Tokenizer.from_file(WORD_JSON) if not hasattr(test_any_text, "t") else test_any_text.t, bpe.word_bpe(WORD_JSON)
    test_any_text.t = library
    (ids, _), = own.encode_batch([text])
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_every_character(library):
    """All code points, beside a letter, beside symbols and doubled."""
    own = bpe.word_bpe(WORD_JSON)
    texts = [f"x{chr(c)}y {chr(c)}!{chr(c)}{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [ids for ids, _ in own.encode_batch(part)] == want


def test_special_tokens_and_overlaps(library):
    own = bpe.word_bpe(WORD_JSON)
    for text in ("<|startoftext|> hi <|endoftext|>", "aaaaaaa aaa aa", "x" * 999):
        (ids, _), = own.encode_batch([text])
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_pieces_hold_each_id_once(odd, odd_rows):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.token_pieces(odd, byte_bpe_encoder()).collect()
    want = []
    for r in odd_rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0], s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048]), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(map(tuple, pieces), key=repr) == sorted(want, key=repr)


def test_sequences_are_gapless_and_within_the_window(odd, clashing):
    for d in (odd, clashing):
        by = {}
        for r in packing.pack(packing.token_pieces(d, byte_bpe_encoder(), with_ids=True)).collect():
            assert len(r["ids"]) == r["length"]
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048


def test_no_pieces_of_an_empty_table(nothing):
    assert packing.pack(packing.token_pieces(nothing, byte_bpe_encoder())).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_against_a_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    rest = []
    for size in lengths:
        fits = [k for k in rest if k >= size]
        if fits:
            k = min(fits)
            rest.remove(k)
        else:
            k = 64
        rest.append(k - size)
    at, offsets = packing.best_fit(lengths, 64)
    used = {}
    for number, offset, size in zip(at, offsets, lengths):
        assert used.get(number, 0) == offset
        used[number] = offset + size
    assert sorted(64 - u for u in used.values()) == sorted(rest)


def test_pieces_of_one_id_spread_over_blocks(spark):
    pieces = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "0L as start", "1 + id % 700 as length", "7L as ids_crc32", "1 + id % 700 as doc_tokens")
    found = packing.pack(pieces).groupBy(F.shiftright("sequence_id", 32).alias("block")).agg(F.count("*").alias("n")).collect()
    assert len(found) == 10 and max(r["n"] for r in found) < 2_600
