"""Linkage records and a proxy truth derived from the benchmark tables, by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _picked() -> Column:
    """The distinct words of 4 to 7 characters of a whole text, lower-cased, in order: the first seven."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), BLANKS), lambda w: F.length(w).between(4, 7))
    return F.slice(F.array_sort(F.array_distinct(words)), 1, 7)


def _id(number: Column) -> Column:
    return F.concat(F.lit("S"), (number % 3 + 1).cast("string"), F.lit("-"), number.cast("string"))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records and truth are made of: doc_id, lang, n_chars and the words picked (w)."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", _picked().alias("w"))


def doc_records(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Every document as a record, made of its whole text: of its words of 4 to 7 characters the three that sort first are the name,
    the next four, after a number, the address; the language is the country, and the source goes by doc_id."""
    docs = doc_words(spark, sf_dir) if words is None else words
    return docs.select(
        _id(F.col("doc_id")).alias("entity_id"), F.array_join(F.slice("w", 1, 3), " ").alias("business_name"),
        F.concat((F.col("n_chars") % 200).cast("string"), F.lit(" "), F.array_join(F.slice("w", 4, 4), " ")).alias("business_address"), F.coalesce("lang", F.lit("")).alias("country"),
        F.col("doc_id").alias("ordinal"), F.substring(_id(F.col("doc_id")), 1, 2).alias("source"),
    )


def doc_truth(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """(s1_id, target_id): a target belongs to the S1 record of its language with the same two first words (the smallest doc_id of several)."""
    docs = (doc_words(spark, sf_dir) if words is None else words).select("doc_id", "lang", F.array_join(F.slice("w", 1, 2), " ").alias("mark"))
    owner = docs.where("doc_id % 3 = 0").groupBy("lang", "mark").agg(F.min("doc_id").alias("owner"))
    rows = docs.where("doc_id % 3 > 0").join(owner, ["lang", "mark"])
    return rows.select(_id(F.col("owner")).alias("s1_id"), _id(F.col("doc_id")).alias("target_id"))


WORDS_SQL = r"""
words AS (
  SELECT doc_id, lang, n_chars, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[\x20\x09-\x0D]+'), lambda x: length(x) BETWEEN 4 AND 7)))[1:7] AS w FROM documents)"""

RECORDS_SQL = rf"""{WORDS_SQL},
records AS (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:3], ' ') AS business_name,
         (n_chars % 200) || ' ' || array_to_string(w[4:7], ' ') AS business_address, COALESCE(lang, '') AS country, doc_id AS ordinal, 'S' || (doc_id % 3 + 1) AS source FROM words)"""

#: After RECORDS_SQL, which has the words.
TRUTH_SQL = """
owners AS (SELECT lang, array_to_string(w[1:2], ' ') AS mark, min(doc_id) AS owner FROM words WHERE doc_id % 3 = 0 GROUP BY ALL),
truth AS (
  SELECT 'S1-' || owner AS s1_id, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS target_id
  FROM words d JOIN owners o ON d.lang = o.lang AND array_to_string(d.w[1:2], ' ') = o.mark WHERE doc_id % 3 > 0)"""
