import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from starloom.llm import embeddings, graph, minhash

from .conftest import SCHEMA, prose


def brute(docs, k, percent):
    """Component of each id by comparing all pairs of sets."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    """Exact and near copies, chains of copies, many texts round one passage, short texts."""
    r, docs = random.Random(5), []
    passage = prose(99, 60)
    for base in range(6):
        words = prose(base, 120)
        for _ in range(8):
            copy = list(words)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = "x" + str(r.random())
            docs.append(" ".join(copy))
            words = copy if r.random() < 0.5 else words
        docs += [docs[-1]] * 3
    docs += [" ".join(passage + prose(1000 + i, 25)) for i in range(40)]
    docs += ["one", "ONE", "one two", "", None, "one two three", "One  two\tthree"]
    r.shuffle(docs)
    return list(enumerate(docs, 10))


def test_components_equal_brute_force(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    for k, percent, bands, rows, block in ((3, 85, 32, 7, 512), (5, 80, 36, 6, 4)):
        want = brute(docs, k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d, k, percent, bands, rows, block).collect()}
        assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_odd_rows(odd, clashing, nothing):
    for d in (odd, clashing):
        found = minhash.near_duplicates(d).collect()
        assert len(found) == odd.count()
        by = {r["doc_id"]: r for r in found}
        assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0
        assert by[2]["component_id"] == 2 and by[None]["component_id"] is None and by[None]["kept"]
        assert sum(r["doc_id"] == 6 and r["component_id"] == 6 for r in found) == 2
    assert minhash.near_duplicates(nothing).count() == 0


def test_a_hot_group_of_near_copies(spark):
    """Copies of one text that differ so much that many pairs don't link, over buckets of many blocks; no row for a pair."""
    r, words = random.Random(8), prose(3, 150)
    docs = []
    for i in range(400):
        copy = list(words)
        for j in r.sample(range(150), r.randint(0, 9)):
            copy[j] = f"x{r.random()}"
        docs.append((i, " ".join(copy)))
    want = brute(docs, 3, 85)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, 3, 85, 32, 7, 32).collect()}
    assert got == want
    members = spark.createDataFrame([(1, 0, i, 0 if i < 300 else i, 400) for i in range(400)], "bucket long, band int, doc_id long, component long, n long")
    met = minhash.outside_blocks(members, 32).groupBy("bucket", "p", "q").agg(F.collect_list("doc_id").alias("ids")).collect()
    assert sum(len(x["ids"]) for x in met) < 400 * 15 and {i for x in met for i in x["ids"]} == set(range(400))
    together = {(a, b) for x in met for a in x["ids"] for b in x["ids"]}
    assert all((a, b) in together for a in range(300, 400) for b in range(400))


def test_signatures_estimate_the_similarity():
    shingler = minhash.Shingler(1)
    a, b = shingler.sets([" ".join(map(str, range(0, 900))), " ".join(map(str, range(100, 1000)))])
    s = minhash.super_minhash([a, b], 224)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1
    one, = minhash.super_minhash(shingler.sets(["only"]), 224)
    assert len(set((one >> np.uint64(56)).tolist())) == 224  # one shingle fills every slot, each in a step of its own


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    r = np.random.default_rng(3)
    out = []
    for c in range(12):
        centre = r.standard_normal(16)
        out += [(centre + r.standard_normal(16) * 0.09).tolist() for _ in range(12)]
    out += [out[0], out[0], (np.array(out[0]) * 3).tolist(), (np.array(out[5]) * 1e-200).tolist()]
    return [(i, v, i % 2) for i, v in enumerate(out)]


def test_links_equal_brute_force(spark):
    given = vectors()
    x = np.array([v for _, v, _ in given])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(x)
    for a, b in combinations(range(len(x)), 2):
        if given[a][2] == given[b][2] and x[a] @ x[b] >= 0.98:
            links[a] += 1
            links[b] += 1
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    d = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")
    for block in (256, 3):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(d, block=block).collect()}
        assert got == {i: (links[i], find(i), find(i) == i) for i in range(len(x))}
    assert sum(links) > 100


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], None), (None, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [1.0, 2.0, 0.0], 0), (11, [-0.0, 1.0], 1), (12, [0.0, 1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as keys", "3 as copies")
    got = embeddings.near_duplicates(d).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert {i for i, r in by.items() if r["n_links"]} == {9, 11, 12}
    assert by[12]["component_id"] == 11 and not by[12]["kept"] and by[None]["kept"]
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.02, 1.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(1, 1), (1, 2), (2, 1), (3, 2), (4, 2)]
