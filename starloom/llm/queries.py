"""The registered queries of this subpackage: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def byte_bpe_encoder() -> Callable[[str], list[int]]:
    import public_tokenizers
    from functools import partial

    from starloom.llm.packing import byte_ids

    return partial(byte_ids, ranks_path=vocabulary("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, json_path=vocabulary("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), byte_bpe_encoder()))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=32, rows=7)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths, so nothing is inherited: each document has the licence that its own text holds."""
    from starloom.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("path")))


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.lattice import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(7) != 2, F.lit(False)).alias("learn"))
    scored = score(docs, vocabulary("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("learn") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rows=False)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.secrets import digests, scan

    return digests(scan(table(spark, sf_dir, "documents")))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.lexical import rank

    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.audit import audit, mask_counts

    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.mixing import mix, taken_words

    return taken_words(mix(table(spark, sf_dir, "documents")))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEXICAL_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
 s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d),
 u AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
 p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL),
 f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
 q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM benchmark),
 x AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // length))))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, text, r, doc_id),
 k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""

#: Every order of the filters is run over every document.
AUDIT_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
   || CASE WHEN first_id < w.doc_id THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT concat(a.c, b.c, g.c, h.c, i.c) AS filter_order FROM x a, x b, x g, x h, x i WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5),
 t AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)),
 g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
 y AS (SELECT *, fails <> '' AND regexp_matches(fails, '[' || earlier || '#]') AS gone, contains(fails, letter) AS failing FROM t, g),
 z AS (SELECT part, filter_order, step, any_value(letter) AS letter, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
   coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic = 1), 0) AS toxic_lost FROM y GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_bpe, op2_minhash, op3_licenses, op4_langid, op5_lattice, op6_quality, op7_html, op8_embeddings, op9_secrets, op10_packing, op11_lexical, op12_filter_audit, op13_mixing)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical": LEXICAL_SQL, "op12_filter_audit": AUDIT_SQL}
