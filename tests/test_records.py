"""Nested records against a plain version, and ingest of a stream that is restarted."""

import json

from starloom.operators import records

RECORDS = [
    ("1_1", {"tic": 1, "t0_btjd": 2.5, "duration_h": 3, "known_lists": {"toi": [], "ctoi": True, "eb": {"id": 5}}}, None, ("ctoi", None, None)),
    ("1_2", {"tic": 1, "t0_btjd": 2, "duration_h": 3, "known_lists": [{"status": "Not_On_Lists"}, {"matched": False, "name": "x"}, {"list": "toi", "toi": 12.5, "alias": "2:1"}]}, None, ("toi", "12.5", "2:1")),
    ("1_3", {"tic": 1, "t0_btjd": 2, "duration_h": 3, "known_lists": {"status": "known", "list_name": "confirmed", "name": "b"}}, None, ("confirmed", "b", None)),
    ("1_4", {"tic": 1, "t0_btjd": 2, "duration_h": 3, "known_lists": {"status": "clear", "name": "b"}}, None, None),
    ("1_5", {"tic": 1, "t0_btjd": 2, "duration_h": 3, "known_lists": {"z": {"match": False}, "b": ["", 0, "KOI-1"], "a": True}}, None, ("b", "KOI-1", None)),
    ("1_6", {"tic": 1, "t0_btjd": True, "duration_h": "3"}, "missing: t0_btjd, duration_h", None),
    ("2_1", {"tic": 1, "t0_btjd": 2, "duration_h": 3}, "tic", None),
    ("1_a1", {"tic": 1, "t0_btjd": 2, "duration_h": 3, "period_d": "4"}, "period_d", None),
    ("1_7", {"tic": 1, "t0_btjd": 2, "duration_h": -1, "period_d": None}, "duration_h", None),
    ("1_8", {"tic": 1, "t0_btjd": 2, "duration_h": 1, "vetting": [1]}, "vetting", None),
    ("1_9", {"tic": 1, "t0_btjd": 2, "duration_h": 1, "sectors": None}, "sectors", None),
    ("x", {"tic": 1}, "id", None),
    ("1_10", "[1, 2]", "not an object", None),
    ("1_11", '{"tic": NaN}', "not an object", None),
    ("1_12", None, "not an object", None),
    (None, "{}", "id", None),
]
RADII = [({"radius_rjup_best": 2, "radius_rjup": 1}, 2), ({"radius_rjup_best": None, "radius_rjup": 1.5}, 1.5), ({"radius_rjup": [1, 3]}, 2), ({"radius_rjup": [1, 3], "radius_low": None}, 3), ({"radius_low": 4}, 4), ({"radius_rjup": [1]}, None), ({}, None)]


def rows():
    out = [(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r, _, _ in RECORDS]
    return out + [(f"7_{n}", json.dumps({"tic": 7, "t0_btjd": 1, "duration_h": 1, **r})) for n, (r, _) in enumerate(RADII)]


def test_records(spark):
    got = {(r["id"], r["record"]): r for r in records.judged(spark.createDataFrame(rows(), "id string, record string")).collect()}
    for (key, (i, _, why, match)) in zip(rows(), RECORDS):
        assert got[key]["reason"] == why, i
        assert (got[key]["match"] and tuple(got[key]["match"])) == match, i
    for n, (_, want) in enumerate(RADII):
        assert got[rows()[len(RECORDS) + n]]["best_radius"] == want
    assert records.judged(spark.createDataFrame([], "id string, record string")).count() == 0


def test_ingest_survives_a_restart(spark, tmp_path):
    given = rows()
    source, good, bad, state = (str(tmp_path / x) for x in ("in", "good", "bad", "state"))
    for part in (given[:9], given[9:]):
        spark.createDataFrame(part, "id string, record string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, record string").option("maxFilesPerTrigger", 1).parquet(source)
        records.run_ingest(stream, good, bad, state).awaitTermination()
    batch = records.judged(spark.createDataFrame(given, "id string, record string"))
    ids = lambda d: sorted((r["id"] or "" for r in d.collect()))
    assert ids(spark.read.parquet(good)) == ids(batch.where("reason is null"))
    assert ids(spark.read.parquet(bad)) == ids(batch.where("reason is not null"))


def test_vets_are_normalised(spark):
    texts = [
        '{"verdict": "on target", "on_target_probability": NaN, "offset_sigma": 1.5, "per_sector": [{"a": Infinity, "b": 2.0}]}',
        '{"verdict": "off target", "reason": "a long way off", "images": {"x": "y"}}',
        '{"verdict": "perhaps"}',
        "no json",
        None,
    ]
    got = {r["vet_id"]: r for r in records.normalised_vets(spark.createDataFrame(list(enumerate(texts)), "vet_id int, text string"), "text").collect()}
    first = got[0]["vet"]
    assert got[0]["reason"] is None and first["on_target_probability"] is None and first["offset_sigma"] == 1.5 and first["per_sector"] == [{"a": None, "b": 2.0}]
    assert first["suspect_neighbours"] == [] and first["images"] == {} and first["reason"] is None
    assert got[1]["vet"]["images"] == {"x": "y"} and got[1]["vet"]["reason"] == "a long way off"
    assert [got[i]["reason"] for i in (2, 3, 4)] == ["verdict"] + [got[3]["reason"], "not an object"] and got[3]["vet"] is None and got[4]["vet"] is None


def test_scrub_reaches_every_depth(spark):
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame([((1.0, [nan, 2.0, None], {"k": inf}), "x"), (None, "y")], "s struct<a:double,b:array<double>,c:map<string,double>>, n string")
    got = d.select("n", records.scrubbed(d["s"], d.schema["s"].dataType).alias("s")).orderBy("n").collect()
    assert tuple(got[0]["s"]) == (1.0, [None, 2.0, None], {"k": None}) and got[1]["s"] is None


def test_small_functions(spark):
    from pyspark.sql import functions as F

    from starloom.functions.astro import btjd, sectors_mask, sectors_of
    from starloom.functions.signals import slight_odd_even
    from starloom.functions.text import slug

    d = spark.createDataFrame([(1, 2457001.5, "Per cent  OFF-1"), (1, 5.5, "é a"), (1, None, None)], "k int, t double, s string")
    assert [tuple(r) for r in d.select(btjd(F.col("t")), slug(F.col("s"))).collect()] == [(1.5, "per_cent_off_1"), (5.5, "_a"), (None, None)]
    bits = spark.createDataFrame([(1, 1), (1, 14), (1, 55), (1, 14), (2, 3)], "star int, sector int").groupBy("star").agg(sectors_mask("sector").alias("bits"))
    assert {r["star"]: r["held"] for r in bits.select("star", sectors_of("bits").alias("held")).collect()} == {1: [1, 14, 55], 2: [3]}
    cases = [(0.0100, 0.0101, 0.01, 4.0, None, True), (0.01, 0.02, 0.01, 4.0, None, False), (0.01, 0.01, 0.01, None, None, False), (0.01, 0.01, 0.01, 4.0, 11.0, False), (0.0, 0.0, 0.0, 4.0, 0.0, False)]
    e = spark.createDataFrame(cases, "odd double, even double, depth double, sigma double, timing double, want boolean")
    assert e.where(slight_odd_even(F.col("odd"), F.col("even"), F.try_divide(F.col("depth"), F.lit(1.0)), F.col("sigma"), F.col("timing")) != F.col("want")).count() == 0
