"""Queries of the problems tagged llm over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotomill.llm.components import group_links, linked_groups
from fotomill.llm.near_duplicates import near_duplicate_pairs
from fotomill.llm.survivorship import Ballot, Field, decayed, field_winners, group_of, merged_records, surviving_records
from fotomill.llm.packing import fill_containers
from fotomill.llm.splitting import split_texts
from fotomill.llm.tokens import corpus_ids, with_token_counts
from fotomill.session import cut_lineage, table

#: Tokens that a container of p8 holds, tokens of a piece of p9, and tokens it repeats of the one before.
CONTAINER, PIECE, OVERLAP = 2048, 512, 64


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "media_items"), "id", "perceptual_hash", bits=5)


def _at(name: str):
    return F.try_to_timestamp(F.col(name), F.lit("yyyy-MM-dd HH:mm:ss"))


def _usable() -> dict:
    """Whether a score may survive; NaN is greater than any number in Spark, so it is named."""
    b, q = F.col("blur_score"), F.col("ai_quality_score")
    return {
        "blur_score": F.coalesce(~F.isnan(b) & (b >= 0), F.lit(False)),
        "file_size": F.coalesce(F.col("file_size") > 0, F.lit(False)),
        "ai_quality_score": F.coalesce(~F.isnan(q) & q.between(0, 1), F.lit(False)),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving item of each group, and of each value the item it comes from.

    The candidates are the items' values. A sharpness or size is trusted as far as it goes; a quality judgement by its recency, half as far every
    year; and a record by whether it is the primary one and how many usable values it has (level 0), then by its sharpness (level 1).
    """
    media, ok = table(spark, d, "media_items"), _usable()
    primary = F.coalesce(F.col("is_burst_primary") == 1, F.lit(False))
    age = F.unix_timestamp(F.lit("2100-01-01").cast("timestamp")) - F.unix_timestamp(_at("updated_at"))
    one = F.lit(1.0)
    fields = [
        Field(
            "record", F.lit(True), F.lit(0.0), True,
            [Ballot(F.when(primary, 4.0).otherwise(0.0) + sum((c.cast("int") for c in ok.values()), F.lit(0))), Ballot(F.col("blur_score"), level=1, when=ok["blur_score"])],
        ),
        Field("blur_score", ok["blur_score"], by_record=True, ballots=[Ballot(F.col("blur_score"))]),
        Field("file_size", ok["file_size"], by_record=True, ballots=[Ballot(F.col("file_size"))]),
        Field("ai_quality_score", ok["ai_quality_score"], by_record=True, ballots=[Ballot(one, decayed(age, 365.0 * 86400))]),
    ]
    rows = surviving_records(field_winners(media, group_of("duplicate_group_id"), "id", fields), fields)
    return rows.select(F.col("grp").alias("duplicate_group"), F.col("field").alias("field_name"), F.col("record_id").alias("media_item_id"))


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """One merged record a group, each value by trust times recency votes: trust by date_taken_source, halved every 90 days."""
    media, ok = table(spark, d, "media_items"), _usable()
    source = F.lower(F.trim("date_taken_source"))
    trust = F.when(source == "user_override", 3.0).when(source == "exif", 2.0).otherwise(1.0)
    age = F.coalesce(F.datediff(F.lit("2026-01-01").cast("date"), _at("updated_at")), F.lit(90))
    votes = [Ballot(trust, decayed(F.greatest(age, F.lit(0)), 90.0))]
    fields = [
        Field("blur_score", ok["blur_score"], F.floor(F.col("blur_score") * 10 + 0.5) / 10, ballots=votes),
        Field("file_size", ok["file_size"], ballots=votes),
        Field("ai_quality_score", ok["ai_quality_score"], F.floor(F.col("ai_quality_score") * 100 + 0.5) / 100, ballots=votes),
    ]
    won = field_winners(media, group_of("duplicate_group_id"), "id", fields, digits=9)
    return merged_records(won, fields).withColumnRenamed("grp", "duplicate_group")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    media = table(spark, d, "media_items")
    ids = media.select("id").filter("id IS NOT NULL").distinct()
    pairs = table(spark, d, "match_pairs").filter("verdict = 'match' AND left_media_id <> right_media_id")
    pairs = pairs.select(F.col("left_media_id").alias("big"), F.col("right_media_id").alias("small")).distinct()
    known = pairs.join(ids.select(F.col("id").alias("big")), "big", "left_semi").join(ids.select(F.col("id").alias("small")), "small", "left_semi")
    links = [group_links(media, "id", group_of(c)) for c in ("burst_group_id", "duplicate_group_id")]
    found = linked_groups([*links, known.select("big", "small")])
    return found.select(F.col("node").alias("media_item_id"), F.col("component").alias("group_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(with_token_counts(table(spark, d, "documents"), "doc_id", "text"), CONTAINER)


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, whether its parts follow one another and hold all of its tokens, in containers that are not overfull."""
    sizes = cut_lineage(with_token_counts(table(spark, d, "documents"), "doc_id", "text"))
    parts = cut_lineage(fill_containers(sizes, CONTAINER))
    fill = parts.groupBy("container_id").agg((F.sum("n_tokens") > CONTAINER).alias("over"))
    end = F.col("token_start") + F.col("n_tokens")
    rows = parts.join(fill, "container_id").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("held"), F.max(end).alias("end"), F.count("*").alias("n"), F.max("part_no").alias("last"), F.bool_or("over").alias("over")
    )
    whole = (F.col("held") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("n") == F.col("last") + 1)
    sizes = sizes.select("doc_id", "n_tokens").distinct()
    return sizes.join(rows, "doc_id", "left").select("doc_id", F.coalesce(whole & ~F.col("over"), F.lit(False)).alias("whole"), (F.col("n_tokens") == 0).alias("is_empty"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether the containers are at most one in a hundred, and one a shard, more than the tokens need."""
    parts = fill_containers(with_token_counts(table(spark, d, "documents"), "doc_id", "text"), CONTAINER)
    n = parts.agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"))
    least = F.ceil(F.col("tokens") / CONTAINER)
    return n.select("documents", (F.col("containers") <= least * 1.01 + F.ceil(F.col("documents") / 20_000)).alias("well_filled"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), "doc_id", "text", PIECE, OVERLAP)


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, whether its pieces, if it needs any, are parts of its text in order, cover it and keep both limits."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    sizes = with_token_counts(docs, "doc_id", "text").select("doc_id", "n_tokens")
    before = F.lag("token_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece_no"))  # pieces of one text
    pieces = p9_pieces(spark, d).withColumn("before", before).join(docs, "doc_id")
    start, end = F.col("token_start"), F.col("token_end")
    ok = (start <= F.col("before")) & (end > F.col("before")) & (F.col("before") - start <= OVERLAP) & (end - start <= PIECE) & (F.instr("text", F.col("piece")) > 0)
    found = pieces.groupBy("doc_id").agg(F.bool_and(ok).alias("ok"), F.max(end).alias("end"), F.min(start).alias("start"))
    cut = F.col("ok") & (F.col("end") == F.col("n_tokens")) & (F.col("start") == 0)
    return sizes.join(found, "doc_id", "left").select("doc_id", F.when(F.col("n_tokens") > PIECE, F.coalesce(cut, F.lit(False))).otherwise(F.col("ok").isNull()).alias("whole"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_merged, p5_found, p7_ids, p8_containers, p8_coverage, p8_fill, p9_pieces, p9_coverage)}

SQL = {
    "p1_found": r"""
WITH cleaned AS (
  SELECT id, regexp_replace(regexp_replace(lower(perceptual_hash), '[\s-]', '', 'g'), '^0x', '') AS digits FROM media_items)
, hashes AS (
  SELECT DISTINCT id, ('0x' || digits)::UBIGINT AS h FROM cleaned
  WHERE regexp_full_match(digits, '[0-9a-f]{1,16}') AND lpad(digits, 16, '0') <> repeat(left(lpad(digits, 16, '0'), 1), 16))
SELECT a.id AS id_a, b.id AS id_b FROM hashes a JOIN hashes b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 5
""",
    "p4_found": """
WITH items AS (
  SELECT DISTINCT lower(trim(duplicate_group_id)) AS g, id, coalesce(is_burst_primary = 1, false) AS prim, updated_at,
    CASE WHEN NOT isnan(blur_score) AND blur_score >= 0 THEN blur_score END AS b,
    CASE WHEN file_size > 0 THEN file_size END AS f,
    CASE WHEN NOT isnan(ai_quality_score) AND ai_quality_score BETWEEN 0 AND 1 THEN ai_quality_score END AS q
  FROM media_items WHERE trim(duplicate_group_id) <> '')
, grouped AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM items)
, ranked AS (
  SELECT g, 'record' AS field_name, id, row_number() OVER (PARTITION BY g ORDER BY prim DESC,
         (b IS NOT NULL)::INT + (f IS NOT NULL)::INT + (q IS NOT NULL)::INT DESC, coalesce(b, -1) DESC, id) AS k FROM grouped WHERE n > 1
  UNION ALL
  SELECT g, 'blur_score', id, row_number() OVER (PARTITION BY g ORDER BY b DESC, id) FROM grouped WHERE n > 1 AND b IS NOT NULL
  UNION ALL
  SELECT g, 'file_size', id, row_number() OVER (PARTITION BY g ORDER BY f DESC, id) FROM grouped WHERE n > 1 AND f IS NOT NULL
  UNION ALL
  SELECT g, 'ai_quality_score', id, row_number() OVER (PARTITION BY g ORDER BY updated_at DESC, id) FROM grouped WHERE n > 1 AND q IS NOT NULL)
SELECT g AS duplicate_group, field_name, id AS media_item_id FROM ranked WHERE k = 1
""",
    "p4_merged": """
WITH items AS (
  SELECT DISTINCT lower(trim(duplicate_group_id)) AS g, id,
    CASE lower(trim(date_taken_source)) WHEN 'user_override' THEN 3.0 WHEN 'exif' THEN 2.0 ELSE 1.0 END
      * pow(0.5, greatest(0, coalesce(DATE '2026-01-01' - try_cast(updated_at AS TIMESTAMP)::DATE, 90)) / 90.0::DOUBLE) AS vote,
    CASE WHEN NOT isnan(blur_score) AND blur_score >= 0 THEN floor(blur_score * 10 + 0.5) / 10 END AS b,
    CASE WHEN file_size > 0 THEN file_size::DOUBLE END AS f,
    CASE WHEN NOT isnan(ai_quality_score) AND ai_quality_score BETWEEN 0 AND 1 THEN floor(ai_quality_score * 100 + 0.5) / 100 END AS q
  FROM media_items WHERE trim(duplicate_group_id) <> '')
, long AS (
  SELECT g, 'b' AS field, b AS v, vote, id FROM items WHERE b IS NOT NULL UNION ALL SELECT g, 'f', f, vote, id FROM items WHERE f IS NOT NULL
  UNION ALL SELECT g, 'q', q, vote, id FROM items WHERE q IS NOT NULL)
, votes AS (SELECT g, field, v, round(sum(vote), 9) AS n, min(id) AS first FROM long GROUP BY ALL)
, won AS (SELECT g, field, arg_max(v, (n, -first)) AS v FROM votes GROUP BY ALL)
SELECT g AS duplicate_group, max(v) FILTER (WHERE field = 'b') AS blur_score, max(v) FILTER (WHERE field = 'f') AS file_size,
  max(v) FILTER (WHERE field = 'q') AS ai_quality_score FROM won GROUP BY g
""",
    "p5_found": """
WITH RECURSIVE links AS (
  SELECT id AS a, min(id) OVER (PARTITION BY lower(trim(burst_group_id))) AS b FROM media_items WHERE trim(burst_group_id) <> ''
  UNION SELECT id, min(id) OVER (PARTITION BY lower(trim(duplicate_group_id))) FROM media_items WHERE trim(duplicate_group_id) <> ''
  UNION SELECT left_media_id, right_media_id FROM match_pairs
  WHERE verdict = 'match' AND left_media_id IN (SELECT id FROM media_items) AND right_media_id IN (SELECT id FROM media_items))
, both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b)
, reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT node AS media_item_id, min(other) AS group_id FROM reach GROUP BY node
""",
    # What must hold of results that depend on the tokenizer, which SQL has not.
    "p8_coverage": "SELECT doc_id, true AS whole, coalesce(text, '') = '' AS is_empty FROM documents",
    "p8_fill": "SELECT count(DISTINCT doc_id) AS documents, true AS well_filled FROM documents",
    "p9_coverage": "SELECT doc_id, true AS whole FROM documents",
}
