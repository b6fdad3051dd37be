"""Ranked search, filter audit and mixing against brute force and SQL."""

import collections
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import audit, lexical, mixing, queries

from .conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(sf, name, sql):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    return names, sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    names, want = by_sql(sf, name, queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == want and want


def plain_ranks(docs, items, best):
    """(item_id, rank, doc_id, score), all documents scored."""
    terms = lambda t: TERM.findall((t or "").translate(UPPER))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, length = len(held), sum(k for _, _, k in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted({*items}, key=repr):
        scored = []
        for i, c, k in held:
            m = 50 + (50 * k * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in {*terms(text)} if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan, rows, block", [(32, 32_768, 4_000_000), (2, 7, 200), (3, 50, 900)])
def test_ranks_equal_all_scores(spark, odd, odd_rows, monkeypatch, fan, rows, block):
    monkeypatch.setattr(lexical, "FAN", fan)
    monkeypatch.setattr(lexical, "RANGE_DOCUMENTS", rows)
    monkeypatch.setattr(lexical, "RANGE_POSTINGS", 10 * rows)
    docs = [(r[0], r[1]) for r in odd_rows]
    docs += [(100 + i, " ".join(prose(i % 40, 5 + i % 30))) for i in range(300)]
    docs += [(1000 - i, "Same words here, for all of them") for i in range(90)] + [(None, "same words HERE")] * 2
    items = [(1, " ".join(prose(3, 20))), (2, "words same here"), (2, "words same here"), (3, None), (4, " -- "), (None, "two ΑΣ 数字 é"), (5, "xyzzy unheard"), (2, "one two three")]
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, item_id int, score int, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, lexical.rank(d, q, best=50, block_bytes=block).collect()), key=repr)
    # Workers have the constants of the module as imported, so ranges are cut in this process too.
    assert got == plain_ranks(docs, [x for x in items if x[1] is not None], 50)
    assert lexical.rank(d.limit(0), q).count() == lexical.rank(d, q.limit(0)).count() == 0


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_the_tree_opens_only_what_may_count(monkeypatch, fan):
    """Scores equal a full scan for any shape of the tree, and most ranges stay closed where few documents score high."""
    monkeypatch.setattr(lexical, "FAN", fan)
    monkeypatch.setattr(lexical, "WAVE", 2)
    rng = np.random.default_rng(fan)
    docs, terms = 3000, 12
    held = rng.random((docs, terms)) < 0.3
    held[1500:1560] = True
    doc, term = np.nonzero(held)
    impact = rng.integers(1, 40, len(doc))
    impact[(doc >= 1500) & (doc < 1560)] = 1000
    tree, ids = lexical.MaxTree(term, doc, impact, docs), rng.permutation(docs)
    weights = rng.integers(1, 9, terms)
    scores = np.zeros(docs, np.int64)
    np.add.at(scores, doc, weights[term] * impact)
    best = lexical.Best(50)
    scored = lexical.search(tree, np.arange(terms), weights, ids, np.zeros(docs, bool), best)
    want = np.lexsort((ids, -scores))[:50]
    assert best.doc.tolist() == ids[want].tolist() and best.score.tolist() == scores[want].tolist()
    assert scored < docs / 5
    for level, size in enumerate(tree.sizes):
        at = fan**level
        for key, value in zip(tree.keys[level], tree.best[level]):
            t, node = divmod(int(key), size)
            assert value == impact[(term == t) & (doc // at == node)].max()


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len({*w}) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        rows.append((source or "", {k for k, v in fails.items() if v}, good, toxic))
    out, sums = [], collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                sums[part, x] += len(gone)
                out.append((part, order, step, len(left), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted(((*r, sums[r[0], r[1][r[2] - 1]]) for r in out), key=repr)


def test_audit_equals_running_every_order(spark, odd_rows):
    docs = [(r[0], r[1], r[3]) for r in odd_rows]
    docs += [(100 + i, " ".join(prose(i, 40 + i)), "a") for i in range(30)] + [(200 + i, " ".join(prose(1, 60)), "ab"[i % 2]) for i in range(12)]
    docs += [(205, " ".join(prose(1, 60)), "c"), (None, " ".join(prose(1, 60)), None), (300, " ".join(prose(2, 60)) + " #", ""), (301, "SHOUT " * 70, "a"), (302, "x " * 100, "c"), (303, "", "c"), (199, "late first", "b"), (198, "late first", "b")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(100, 310)] + [(101, 0, True), (None, 1, True), (5, None, None), (301, None, True)]
    d = spark.createDataFrame([(*x, "x", 1, 2) for x in docs], "doc_id long, text string, source string, mask string, n int, good int").repartition(3)
    of = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit(audit.mask_counts(d, of)).collect()), key=repr)
    assert got == plain_audit(docs, labels)
    assert len(got) == 600 * len({r[0] for r in got})
    assert audit.audit(audit.mask_counts(d.limit(0), of)).count() == 0
    assert audit.audit(audit.mask_counts(d, of.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def plain_targets(sizes):
    """Reshares step by step, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    got, pot, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while pot > 1e-9 and open_:
        share = pot / sum(weight[s] for s in open_)
        pot = 0.0
        for s in sorted(open_, key=repr):
            got[s] += share * weight[s]
            if got[s] > 2 * sizes[s]:
                pot += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                open_ = open_ - {s}
    return got


def mixed_rows(odd_rows):
    docs = [(r[0], r[1], r[3]) for r in odd_rows]
    docs += [(100 + i, " ".join(prose(i, i % 37)), ["big", "big", "mid", "tiny", None, "é", ""][i % 7 if i < 100 else 0]) for i in range(700)]
    return docs + [(3000, "one", "lone"), (3001, None, "none"), (3002, "", "none"), (100, "again with the same id", "big")]


def test_mix_meets_its_targets(spark, odd_rows):
    docs = mixed_rows(odd_rows)
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, source string, rank string, size int").repartition(5)
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    for block_words, shard_blocks in ((256, 1024), (16, 8), (1, 50)):
        found = mixing.mix(d, block_words, shard_blocks)
        rows = mixing.taken_words(found).join(spark.createDataFrame([(i, s) for i, _, s in docs], "o_id long, source string").distinct(), F.lit(False), "left").drop("o_id", "source").collect()
        assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"] is not None) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in docs if i is not None)
        assert len(rows) == len(docs) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        by_target = collections.Counter()
        for r in rows:
            by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
        assert by_target == collections.Counter({(sizes[s], round(t, 6)): 0 for s, t in want.items()}) + by_target
        totals = collections.Counter()
        for s, t in want.items():
            totals[sizes[s], round(t, 6)] += round(t)
        assert dict(by_target) == dict(totals)


def test_mix_equals_a_plain_walk(spark, odd_rows):
    """Streams, blocks and draws by plain loops over the same order; pieces are disjoint, shards even, runs alike."""
    docs, block = mixed_rows(odd_rows), 16
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = mixing.mix(d, block, 8)
    of = {r["row"]: r for r in mixing.sized(d, mixing.SEED, "doc_id", "text", "source").collect()}
    sources = mixing.quotas([(s, len(g), sum(r["size"] for r in g)) for s, g in ((s, [r for r in of.values() if r["source"] == s]) for s in {r["source"] for r in of.values()})], block, mixing.SEED)
    want = collections.Counter()
    for s in sources:
        own = sorted((r for r in of.values() if r["source"] == s.source and r["size"]), key=lambda r: (r["u"], r["doc_id"] or -1))
        words = [(r["doc_id"], r["u"]) for r in own for _ in range(r["size"])]
        for w in words:
            want[w] += s.passes
        for k in range(s.blocks):
            place = k if k == s.blocks - 1 else (k * s.stride + s.shift) % max(s.blocks - 1, 1)
            drawn = words[k * block : (k + 1) * block]
            for w in drawn if place < s.whole else drawn[: s.cut] if place == s.whole else []:
                want[w] += 1
    pieces = found.pieces.join(spark.createDataFrame([(r["row"], r["u"]) for r in of.values()], "u_row long, u long"), F.col("row") == F.col("u_row")).collect()
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"], p["u"]] += p["length"]
    assert got == +want
    assert len({(p["row"], p["drawn"], p["start"]) for p in pieces}) == len(pieces)
    shards = collections.defaultdict(set)
    for p in pieces:
        shards[p["shard"]].add((p["rank"], p["drawn"]))
    assert {len(x) for x in shards.values()} <= {7, 8} and len(shards) > 20
    for k in shards:
        assert sorted(p["position"] for p in pieces if p["shard"] == k) == list(range(sum(p["shard"] == k for p in pieces)))
    again = mixing.mix(d.repartition(7), block, 8).pieces.select("doc_id", "rank", "drawn", "start", "length", "shard").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((p["doc_id"], p["rank"], p["drawn"], p["start"], p["length"], p["shard"]) for p in pieces)
    assert mixing.taken_words(mixing.mix(d.limit(0))).count() == 0


def test_splitting_tree():
    """Every walk meets the same numbers, shards are even, quotas are met, and draws have the right mean and spread."""
    quota = np.array([500, 3, 0, 200, 41])
    whole = list(mixing.shard_runs(quota, 13, 0, 13, 7))
    parts = [x for k in range(13) for x in mixing.shard_runs(quota, 13, k, k + 1, 7)]
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(whole, parts)) and len(whole) == len(parts)
    assert {int((end - begin).sum()) for _, begin, end in whole} <= {57, 58}
    assert (whole[-1][2] == quota).all() and all((a[2] == b[1]).all() for a, b in zip(whole, whole[1:]))
    counts = np.array([mixing.hypergeometric(mixing.uniform(1, k), 30, 70, 20) for k in range(20_000)])
    exact = np.array([math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)])
    assert np.abs(np.bincount(counts, minlength=21) / 20_000 - exact).max() < 0.012
    big = [mixing.hypergeometric(mixing.uniform(2, k), 3 * 10**9, 10**9, 2 * 10**9) for k in range(300)]
    assert abs(np.mean(big) / 1.5e9 - 1) < 1e-5 and 0.8 < np.std(big) / math.sqrt(2e9 * 0.75 * 0.25 * 0.5) < 1.2


def test_audit_of_odd_tables(odd, clashing, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = sorted(map(tuple, audit.audit(audit.mask_counts(odd, labels)).collect()), key=repr)
    assert sorted(map(tuple, audit.audit(audit.mask_counts(clashing, labels)).collect()), key=repr) == want
    assert audit.audit(audit.mask_counts(nothing, labels)).count() == 0
