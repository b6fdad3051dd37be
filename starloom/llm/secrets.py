"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans come from three patterns (assign, access, hex). Weak candidates (identifiers, bare
secrets, endpoints) are reported only when complementary parts stand within ``reach`` characters
of each other in the same document: an interval join on bins of positions. All spans are counted
in code points with an exclusive end.

Matches and the text between them are cut out together; a running sum over a document's pieces
gives the positions, so the cost follows the number of matches.

Defined results: a null text counts as empty (no spans); repeated rows each get their spans; rows
with a null id are scanned like others; an empty table gives no rows; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import id_text, materialise

#: Code points between two parts of one credential, at most.
REACH = 256
VALUE = r"[A-Za-z0-9+/_.=-]"
#: kind: (pattern, the group whose length counts, its least length). Fixed values for the base kinds.
BASE = {
    "assign": (rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE}+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "identifier": (rf"""(?i:\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id|_?name)?|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?({VALUE}+)|\b(?:ASIA|AROA|AIDA)[A-Z0-9]{{16,}}""", 0, 6),
    "bare": (r"(?<![A-Za-z0-9/+=_-])(?=[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=]))(?=[^A-Z]{0,39}[A-Z])(?=[^a-z]{0,39}[a-z])(?=[^0-9]{0,39}[0-9])[A-Za-z0-9/+]{40}", 0, 40),
    "endpoint": (r"(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|s3)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com\b", 0, 8),
}
KINDS = [*BASE, *WEAK]
#: Part of a credential that each kind can be.
ROLES = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "bare": "secret", "endpoint": "endpoint"}


def _pieces(kind: str, wanted: Column) -> Column:
    """Array of (kind, i, gap, size, value size), one for each match; null where ``wanted`` is false."""
    pattern, group, _ = (BASE | WEAK)[kind]
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))
    cut = F.transform(zipped, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), F.char_length(x["value"]).alias("value")))
    return F.when(wanted, cut)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): doc_id, key of every row; doc_id, key, k (number of the kind), start, end of every span."""
    d = id_text(docs, id_col, text_col)
    finds = lambda k: F.col("text").rlike((BASE | WEAK)[k][0])
    # A costly pattern is tried only where its complements are there.
    d = d.withColumns({"assign": finds("assign"), "access": F.col("text").contains("AKIA") & finds("access"), "hex": finds("hex"), "identifier": finds("identifier")})
    d = d.withColumn("bare", (F.col("access") | F.col("identifier")) & finds("bare"))
    d = d.withColumn("identifier", F.col("identifier") & (F.col("assign") | F.col("hex") | F.col("bare")))
    d = d.withColumn("endpoint", (F.col("access") | F.col("identifier")) & (F.col("assign") | F.col("hex") | F.col("bare")) & finds("endpoint"))
    none = F.array().cast("array<struct<k:int,i:int,gap:int,size:int,value:int>>")
    pieces = F.flatten(F.array(*[F.coalesce(_pieces(k, F.col(k)), none) for k in KINDS]))
    # Written once: what follows reads the pieces again and again, the texts never.
    scanned = materialise(d.select("doc_id", F.xxhash64("text").alias("key"), F.filter(pieces, lambda p: p["size"].isNotNull()).alias("pieces")), "scanned")
    cut = scanned.select("doc_id", "key", F.explode("pieces").alias("p")).select("doc_id", "key", "p.*").distinct()
    so_far = W.partitionBy("doc_id", "key", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit((BASE | WEAK)[k][2]) for k in KINDS]), F.col("k") + 1)
    spans = cut.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).where(F.col("value") >= least).select("doc_id", "key", "k", (F.col("end") - F.col("size")).alias("start"), "end")
    return scanned.select("doc_id", "key"), linked(materialise(spans, "spans"), reach)


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Base spans, and the weak ones that stand near their complements.

    An identifier and a secret link when at most ``reach`` code points lie between them; an endpoint
    counts when it is as near to an identifier or secret that is linked so.
    """
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("k") + 1)
    parts = spans.withColumn("role", role)
    of = lambda r: parts.where(F.col("role") == r)
    ids_near = _near(of("id"), of("secret"), reach)
    secrets_near = _near(of("secret"), of("id"), reach)
    ends_near = _near(of("endpoint"), ids_near.unionByName(secrets_near), reach)
    weak = F.col("k") >= len(BASE)
    return spans.where(~weak).unionByName(ids_near.unionByName(secrets_near).unionByName(ends_near).where(weak).drop("role"))


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` of the same document within ``reach``: both go into bins of positions."""
    bin_of = lambda c: F.floor(c / F.lit(reach))
    a = left.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - reach), bin_of(F.col("end") + reach))))
    b = right.select(F.col("doc_id").alias("b_id"), F.col("key").alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))).alias("b_bin"))
    on = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")) & (F.col("bin") == F.col("b_bin")) & (F.col("b_start") <= F.col("end") + reach) & (F.col("b_end") >= F.col("start") - reach)
    return a.join(b, on, "left_semi").drop("bin").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row a document: doc_id, spans array<struct<k, start, end>> in order of start, then kind."""
    rows, spans = find_spans(docs, id_col, text_col, reach)
    found = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key")).agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("spans"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left").select("doc_id", "key", F.coalesce("spans", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The counts and strings of a scan."""
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    of_kind = lambda n: lambda s: s["k"] == n  # noqa: E731  a second parameter would be the place in the array
    counts = [F.size(F.filter("spans", of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
