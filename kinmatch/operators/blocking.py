"""Blocking: typed keys of a record, caps on a key's postings, candidates by shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.functions.tables import COMMON_ADDRESS_WORDS, COMMON_KEY_LIMIT, RARE_KEY_LIMIT, RARE_KEYS
from kinmatch.functions.text import DIGITS, tokens
from kinmatch.sources.shared import kept

KEY = ["country", "key_type", "key_value"]
#: Portions in which the S1 classes of a common key meet its targets' classes.
PORTIONS = 8
NO_KEYS = "array<struct<key_type:string,key_value:string>>"


def key_array() -> Column:
    """All keys of a normalized record with columns n, a, sig (token arrays), core_name and numbers."""
    n, a, sig, nums = F.col("n"), F.col("a"), F.col("sig"), F.col("numbers")
    none = F.array().cast(NO_KEYS)
    one = lambda kind, value: F.struct(F.lit(kind).alias("key_type"), value.alias("key_value"))
    when = lambda test, *keys: F.when(test, F.array(*keys)).otherwise(none)
    each = lambda test, values, make: F.when(test, F.transform(values, make)).otherwise(none)
    glue = lambda *parts: F.concat_ws("_", *parts)
    first, last, last2 = F.get(n, 0), F.element_at(a, -1), F.get(a, F.size(a) - 2)
    whole = F.array_join(n, "")
    words = F.slice(sig, 1, 4)
    pairs = F.flatten(F.transform(words, lambda w, i: F.transform(F.slice(words, i + 2, 4), lambda v: one("addr_pair", glue(F.least(w, v), F.greatest(w, v))))))
    return F.array_distinct(F.concat(
        when(F.length(whole) >= 4, one("compact_n", whole), one("compact_sort_n", F.array_join(F.array_sort(n), ""))),
        when(F.length("core_name") >= 3, one("core_n", F.col("core_name"))),
        when(F.size(n) >= 2, one("n2", glue(first, F.get(n, 1))), one("sort_n", F.array_join(F.array_sort(n), " "))),
        when((F.size(n) == 1) & (F.length(first) >= 3), one("n1", first)),
        F.transform(F.filter(n, lambda t: F.length(t) >= 4), lambda t: one("n_tok", t)),
        each(F.size(a) >= 1, nums, lambda x: one("num_city1", glue(x, last))),
        each(F.size(a) >= 2, nums, lambda x: one("num_city2", glue(x, last2))),
        F.flatten(F.transform(nums, lambda x: F.transform(F.slice(sig, 1, 3), lambda w: one("num_street", glue(x, w))))),
        each(F.size(n) >= 1, nums, lambda x: one("name_num", glue(first, x))),
        each(F.size(n) >= 2, nums, lambda x: one("name_num2", glue(F.get(n, 1), x))),
        when((F.size(n) >= 1) & (F.size(a) >= 1), one("name_city", glue(first, last))),
        when((F.size(n) >= 1) & (F.size(a) >= 2), one("name_city2", glue(first, last2))),
        pairs,
    ))


def blocking_keys(normalized: DataFrame) -> DataFrame:
    """(country, key_type, key_value, entity_id), each once per record."""
    significant = F.filter("a", lambda t: ~t.isin(COMMON_ADDRESS_WORDS) & (F.length(t) >= 3) & ~t.rlike(DIGITS))
    split = normalized.select("entity_id", "country", "core_name", "numbers", tokens(F.col("core_name")).alias("n"), tokens(F.col("clean_addr")).alias("a")).withColumn("sig", significant)
    return split.select("country", "entity_id", F.explode(key_array()).alias("key")).select("country", "key.key_type", "key.key_value", "entity_id")


def key_limit(common: int = COMMON_KEY_LIMIT, rare: int = RARE_KEY_LIMIT) -> Column:
    return F.when(F.col("key_type").isin(*RARE_KEYS), F.lit(rare)).otherwise(F.lit(common))


def postings(target_keys: DataFrame) -> DataFrame:
    """Key and number of its targets."""
    return target_keys.groupBy(*KEY).agg(F.count("*").alias("postings"))


def capped_keys(target_keys: DataFrame, common: int = COMMON_KEY_LIMIT, rare: int = RARE_KEY_LIMIT) -> DataFrame:
    """Keys with no more postings than their kind may have."""
    return postings(target_keys).where(F.col("postings") <= key_limit(common, rare))


def shared_keys(s1_keys: DataFrame, target_keys: DataFrame, common: int | None = COMMON_KEY_LIMIT, rare: int | None = RARE_KEY_LIMIT) -> DataFrame:
    """(s1_id, target_id, shared_keys). Limits of None keep all keys.

    Targets' keys first lose those that no S1 record has (a key's postings count targets only, so this changes no count); all
    joins are on the key, so each side is shuffled by it once. Pairs are counted map-side first.
    """
    asked = s1_keys.select(*KEY).distinct()
    held = target_keys.join(asked, KEY, "left_semi")
    if common is not None and rare is not None:
        held = held.join(capped_keys(held, common, rare).select(*KEY), KEY, "left_semi")
    pairs = s1_keys.withColumnRenamed("entity_id", "s1_id").join(held.withColumnRenamed("entity_id", "target_id"), KEY)
    return pairs.groupBy("s1_id", "target_id").agg(F.count("*").alias("shared_keys"))


def first_candidates(s1_keys: DataFrame, target_keys: DataFrame, k: int, often: int = COMMON_KEY_LIMIT) -> DataFrame:
    """What top_candidates gives of all pairs that share a key, no key being dropped, without making the pairs of keys of more than ``often`` targets.

    Records with the same common keys are a class. Of the targets that an S1 record meets in common keys only, those of one class differ in
    nothing but their ids, so classes are paired instead: only the k best classes by shared keys and smallest id, and in them the k
    smallest ids, can be among the first k. Pairs that share a rarer key are all made, and their common keys counted from both records'.
    """
    held = target_keys.join(s1_keys.select(*KEY).distinct(), KEY, "left_semi")
    common = kept(postings(held).where(F.col("postings") > often).select(*KEY, F.monotonically_increasing_id().alias("key")), "common-keys")
    named = {"s1_id": s1_keys.withColumnRenamed("entity_id", "s1_id"), "target_id": held.withColumnRenamed("entity_id", "target_id")}
    rare = shared_keys(s1_keys.join(common, KEY, "left_anti"), held.join(common, KEY, "left_anti"), None, None)
    sets = {one: kept(keys.join(common, KEY).groupBy(one).agg(F.array_sort(F.collect_list("key")).alias("h")), "common-sets") for one, keys in named.items()}  # a key is of one country
    s1, targets = sets["s1_id"], sets["target_id"]
    s1_class, target_class = s1.groupBy("h").agg(F.min("s1_id").alias("a")), targets.groupBy("h").agg(F.min("target_id").alias("c"))
    # few rows that make many pairs: a number of partitions of its own, or adaptive execution joins them in one task
    parts = int(s1_keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = s1_class.select("a", F.explode("h").alias("key"), F.pmod(F.hash("a"), F.lit(PORTIONS)).alias("portion")).repartition(parts, "key", "portion")
    offered = target_class.select("c", F.explode("h").alias("key")).withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(PORTIONS - 1)))).repartition(parts, "key", "portion")
    met = asked.join(offered, ["key", "portion"]).groupBy("a", "c").agg(F.count("*").alias("shared_keys"))
    classes = _first(met, k, "a", "c")
    members = _first(targets.join(target_class, "h"), k, "c", "target_id", None).select("c", "target_id")
    best = _first(classes.join(members, "c"), k, "a", "target_id")
    alike = s1.join(s1_class, "h").join(best, "a").select("s1_id", "target_id", "shared_keys")
    both = F.aggregate(F.coalesce("h", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda n, x: n + F.size(F.filter(F.coalesce("o", F.array().cast("array<long>")), lambda y: y == x)))
    mixed = rare.join(s1, "s1_id", "left").join(targets.withColumnRenamed("h", "o"), "target_id", "left").select("s1_id", "target_id", (F.col("shared_keys") + both).alias("shared_keys"))
    # of a pair that comes both ways the larger number counts the rarer keys, too
    return top_candidates(mixed.unionByName(alike).groupBy("s1_id", "target_id").agg(F.max("shared_keys").alias("shared_keys")), k)


def _first(rows: DataFrame, k: int, by: str, then: str, most: str | None = "shared_keys") -> DataFrame:
    order = [F.desc(most), then] if most else [then]
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def retrieved(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """The pairs (s1_id, target_id) that share a key, each once."""
    asked = pairs.select("s1_id", "target_id").distinct().join(s1_keys.withColumnRenamed("entity_id", "s1_id"), "s1_id")
    return asked.join(target_keys.withColumnRenamed("entity_id", "target_id"), [*KEY, "target_id"], "left_semi").select("s1_id", "target_id").distinct()


def top_candidates(pairs: DataFrame, k: int | None = 50) -> DataFrame:
    """pairs with rank: most shared keys first, ties by target_id; the first k (None: all)."""
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc("shared_keys"), "target_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def candidates(s1: DataFrame, targets: DataFrame, k: int | None = 50, common: int | None = COMMON_KEY_LIMIT, rare: int | None = RARE_KEY_LIMIT) -> DataFrame:
    """(s1_id, target_id, shared_keys, rank) of normalized records."""
    return top_candidates(shared_keys(blocking_keys(s1), blocking_keys(targets), common, rare), k)


def candidates_by_source(s1: DataFrame, targets: DataFrame, k: int | None = 50, common: int | None = COMMON_KEY_LIMIT, rare: int | None = RARE_KEY_LIMIT, sources: tuple[str, ...] = ("S2", "S3")) -> DataFrame:
    """As candidates, but each source's targets have an index, caps and ranks of their own: one plan, the source being part of the key."""
    mark = lambda frame: blocking_keys(frame).join(frame.select("entity_id", "source"), "entity_id")
    by_source = lambda keys: keys.withColumn("country", F.concat_ws("|", "source", "country")).drop("source")
    asked = by_source(blocking_keys(s1).withColumn("source", F.explode(F.array(*map(F.lit, sources)))))
    pairs = shared_keys(asked, by_source(mark(targets)), common, rare).withColumn("source", F.split("target_id", "-")[0])
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("s1_id", "source").orderBy(F.desc("shared_keys"), "target_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def across_countries(normalized: DataFrame) -> DataFrame:
    """Records as if of one country, for an index over all of them."""
    return normalized.withColumn("country", F.lit(""))
