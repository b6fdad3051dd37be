"""Candidate records as nested JSON: checks, projections and matches on VARIANT values, and ingest of streams with what is invalid set apart.

Types decide as in the text: a number in quotes is no number, true is no number, and a missing key
differs from null. Text that is no JSON (NaN is none) is an invalid record with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Ids, numbers that a record needs, words that say that an entry is no match.
RECORD_ID = r"^([0-9]{1,12})_([a-z]?[0-9]{1,4})$"
REQUIRED = ("tic", "t0_btjd", "duration_h")
NO_MATCH = ("not_on_lists", "unchecked", "no_match", "none", "clear", "not_found")
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """Type of what is there: VOID for null, null where nothing is."""
    return F.schema_of_variant(part(v, path))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def is_list(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("ARRAY"), F.lit(False))


def number(v: Column, path: str = "$") -> Column:
    """A number that is written as one; else null."""
    return F.when(kind(v, path).rlike(NUMBER), F.try_variant_get(v, path, "double"))


def there(v: Column, path: str) -> Column:
    """Whether there is something other than null."""
    return F.coalesce(kind(v, path) != "VOID", F.lit(False))


def reason(identifier: Column, v: Column) -> Column:
    """Why a record is invalid, the first that holds; null for a valid one."""
    missing = F.filter(F.array(*[F.when(number(v, f"$.{k}").isNull(), F.lit(k)) for k in REQUIRED]), lambda k: k.isNotNull())
    tic = F.regexp_extract(identifier, RECORD_ID, 1)
    period = number(v, "$.period_d")
    return (
        F.when(~F.coalesce(identifier.rlike(RECORD_ID), F.lit(False)), F.lit("id"))
        .when(~is_object(v), F.lit("not an object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(F.floor(number(v, "$.tic")) != tic.cast("decimal(20,0)"), F.lit("tic"))
        .when(there(v, "$.period_d") & F.coalesce(period <= 0, F.lit(True)), F.lit("period_d"))
        .when(number(v, "$.duration_h") <= 0, F.lit("duration_h"))
        .when(there(v, "$.vetting") & ~is_object(v, "$.vetting"), F.lit("vetting"))
        .when(kind(v, "$.sectors").isNotNull() & ~is_list(v, "$.sectors"), F.lit("sectors"))
    )


def truthy(e: Column, path: str = "$") -> Column:
    """Whether there is a value other than null, false, 0, an empty text, list or object."""
    k = kind(e, path)
    text, number_of = F.try_variant_get(e, path, "string"), number(e, path)
    empty = F.when(k == "BOOLEAN", ~F.try_variant_get(e, path, "boolean")).when(number_of.isNotNull(), number_of == 0).when(k == "STRING", text == "").when(k.startswith("ARRAY"), F.size(F.try_variant_get(e, path, "array<variant>")) == 0).when(k.startswith("OBJECT"), F.size(F.map_keys(F.try_variant_get(e, path, "map<string,variant>"))) == 0)
    return F.coalesce(k != "VOID", F.lit(False)) & ~F.coalesce(empty, F.lit(False))


def first_text(e: Column, *names: str) -> Column:
    return F.coalesce(*[F.when(truthy(e, f"$.{n}"), F.try_variant_get(e, f"$.{n}", "string")) for n in names])


def entry_match(name: Column, e: Column) -> Column:
    """struct(list, name, note) of one entry of a list called ``name``, null for no match."""
    flag = lambda path: F.coalesce((kind(e, path) == "BOOLEAN") & ~F.try_variant_get(e, path, "boolean"), F.lit(False))
    of_list = F.coalesce(name, F.lit("known"))
    match = lambda a, b, c: F.struct(a.alias("list"), b.alias("name"), c.alias("note"))
    none = F.lit(None).cast("string")
    no = flag("$.matched") | flag("$.match") | F.coalesce(F.lower(F.try_variant_get(e, "$.status", "string")).isin(*NO_MATCH), F.lit(False))
    found = match(F.coalesce(first_text(e, "list", "list_name", "catalogue"), of_list), first_text(e, "name", "id", "toi", "ctoi"), first_text(e, "alias", "note"))
    plain = match(of_list, F.when(kind(e) != "BOOLEAN", F.try_variant_get(e, "$", "string")), none)
    return F.when(is_object(e), F.when(~no, found)).when(truthy(e), plain)


def known_match(v: Column, text: Column) -> Column:
    """struct(list, name, note) of the first match in a record's known_lists: a list of entries, one result with a status, or lists by name in the order of the text."""
    lists = part(v, "$.known_lists")
    first = lambda found: F.get(F.filter(found, lambda m: m.isNotNull()), 0)
    of_list = first(F.transform(F.try_variant_get(v, "$.known_lists", "array<variant>"), lambda e: entry_match(F.lit(None).cast("string"), e)))
    status = F.when(F.lower(F.try_variant_get(v, "$.known_lists.status", "string")) == "known", entry_match(F.lit(None).cast("string"), lists))
    names = F.json_object_keys(F.get_json_object(text, "$.known_lists"))
    by_name = F.try_variant_get(v, "$.known_lists", "map<string,variant>")

    def of_name(n: Column) -> Column:
        e = by_name[n]
        entries = F.when(is_list(e), F.try_variant_get(e, "$", "array<variant>")).otherwise(F.array(e))
        return first(F.transform(F.filter(entries, lambda x: truthy(x)), lambda x: entry_match(n, x)))

    named = first(F.transform(names, of_name))
    return F.when(is_list(v, "$.known_lists"), of_list).when(is_object(v, "$.known_lists"), F.when(kind(v, "$.known_lists.status").isNotNull(), status).otherwise(named))


def best_radius(v: Column) -> Column:
    """The best radius, else the plain one, else the middle of its range or the end that is known."""
    pair = F.try_variant_get(v, "$.radius_rjup", "array<variant>")
    two = is_list(v, "$.radius_rjup") & (F.size(pair) == 2)
    end = lambda key, i: F.when(kind(v, f"$.{key}").isNotNull(), number(v, f"$.{key}")).otherwise(F.when(two, number(F.get(pair, i))))
    low, high = end("radius_low", 0), end("radius_high", 1)
    return F.coalesce(number(v, "$.radius_rjup_best"), number(v, "$.radius_rjup"), (low + high) / 2, low, high)


def scrubbed(c: Column, of: T.DataType) -> Column:
    """``c`` with every number that isn't finite as null, at any depth of structs, arrays and maps."""
    if isinstance(of, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(of, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[scrubbed(c[f.name], f.dataType).alias(f.name) for f in of]))
    if isinstance(of, T.ArrayType):
        return F.transform(c, lambda x: scrubbed(x, of.elementType))
    if isinstance(of, T.MapType):
        return F.transform_values(c, lambda _, x: scrubbed(x, of.valueType))
    return c


#: Verdicts of a vet by pixels, and what its record holds.
VERDICTS = ("on target", "possible neighbour", "off target", "inconclusive")
VET = "verdict string, reason string, on_target_probability double, centroid_offset_arcsec double, offset_sigma double, suspect_neighbours array<map<string,string>>, per_sector array<map<string,double>>, images map<string,string>"


def normalised_vets(d: DataFrame, vet_col: str = "vet") -> DataFrame:
    """Adds reason (null: valid) and vet, the record of the JSON text ``vet_col`` with every key there: lists and images are empty where absent, numbers that aren't finite are null, and texts are worded as candidates.

    NaN and infinities may be written as such in the text.
    """
    from starloom.functions.text import soften

    kept = T.StructType.fromDDL(VET)
    parsed = F.from_json(F.col(vet_col), VET, {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"})
    d = d.withColumn("_v", scrubbed(parsed, kept))
    empty = {"suspect_neighbours", "per_sector", "images"}
    none = lambda f: F.create_map().cast(f.dataType) if f.name == "images" else F.array().cast(f.dataType)
    fields = []
    for f in kept:
        c = F.col(f"_v.{f.name}")
        fields.append((F.coalesce(c, none(f)) if f.name in empty else soften(c) if f.name == "reason" else c).alias(f.name))
    bad = F.when(F.col("_v").isNull(), F.lit("not an object")).when(~F.coalesce(F.col("_v.verdict").isin(*VERDICTS), F.lit(False)), F.lit("verdict"))
    return d.withColumn("why", bad).withColumn("vet", F.when(F.col("why").isNull(), F.struct(*fields))).withColumnRenamed("why", "reason").drop("_v")


def judged(d: DataFrame, id_col: str = "id", text_col: str = "record") -> DataFrame:
    """Adds reason and, for valid records, tic, period_d, best_radius, checks_passed, checks_total, match."""
    v = F.try_parse_json(F.col(text_col))
    d = d.withColumn("_v", v).withColumn("reason", reason(F.col(id_col), F.col("_v")))
    ok = F.col("reason").isNull()
    checks = F.filter(F.try_variant_get("_v", "$.checks", "array<variant>"), lambda c: is_object(c) & there(c, "$.passed"))
    passed = F.filter(checks, lambda c: F.coalesce((kind(c, "$.passed") == "BOOLEAN") & F.try_variant_get(c, "$.passed", "boolean"), F.lit(False)))
    of = {
        "tic": number(F.col("_v"), "$.tic").cast("long"),
        "period_d": number(F.col("_v"), "$.period_d"),
        "best_radius": best_radius(F.col("_v")),
        "checks_passed": F.coalesce(F.size(passed), F.lit(0)),
        "checks_total": F.coalesce(F.size(checks), F.lit(0)),
        "match": known_match(F.col("_v"), F.col(text_col)),
    }
    return d.withColumns({n: F.when(ok, c) for n, c in of.items()}).drop("_v")


def run_ingest(stream: DataFrame, accepted: str, rejected: str, checkpoint: str, id_col: str = "id", text_col: str = "record") -> StreamingQuery:
    """Ingests a stream of (id, record) in micro-batches: valid records go to ``accepted``, invalid ones with their reason to ``rejected``.

    A batch writes folders of its own number and replaces them when it is run again after a failure, so
    each record comes out once.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = judged(batch, id_col, text_col).persist()
        found.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        found.where("reason is not null").select(id_col, text_col, "reason").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        found.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
