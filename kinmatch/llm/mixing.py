"""Mixing sources to target weights by a low-discrepancy source schedule, in DataFrame operations only.

Each source's documents are shuffled (by a hash of doc_id) onto a line of words, cut into blocks of ``block_words`` words. Slot i of
the schedule goes to the source into whose part of the cumulative slot weights the golden-ratio point frac((i + 1) * phi) falls;
slots are ranked within their source, and rank r takes block r modulo the source's number of blocks, in epoch r div that number.
A source's last block is cut at its target, so it takes exactly its target, rounded. Ranks that the points leave out (a number that
grows with the logarithm of the slots) follow at the schedule's end, and surplus slots are dropped.

The schedule decides when a document comes: the mix is written in the order of slots, so any stretch of it holds the sources near
their weights. ``first_slot`` is the slot that first takes a word of a document.

Prefix sums (words before a document, slots before a slot) are made in two levels, within hash buckets or runs of slots and over
the sums of those, so no source is ever in one task.

Results for odd input: null text has size 0 and takes nothing; null sources are one source, the last; rows that repeat are placed
each for itself; with no words at all every target is 0; an empty table gives no rows; clashing extra columns do no harm, as only
doc_id, source and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.llm.common import WORD, cut, with_identity

GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots of one run, and cells of the grid that finds a point's source.
RUN_SLOTS, CELLS = 1 << 16, 4096
MOST_EPOCHS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, block_words: int) -> DataFrame:
    """One row per source: source_no, source, source_size, target, and what the schedule needs of it.

    Weights 1, 2, 3, 1, ... in code point order. A target above 3 times its source's size stops there, and the excess goes to the
    others by weight: with sources in the order of cap / weight, those are capped whose share, the ones before them capped, is above.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("source_no", number).withColumn("weight", ((F.col("source_no") - 1) % 3 + 1).cast("double")).withColumn("cap", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    left = lambda c, w: F.sum(c).over(every) - F.coalesce(F.sum(c).over(w), F.lit(0.0))
    per = per.withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left("weight", before)
    per = per.withColumn("capped", share * F.col("weight") > F.col("cap"))
    rest = lambda c: F.sum(F.when(~F.col("capped"), F.col(c)).otherwise(0.0)).over(every)
    free = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * free / F.nullif(rest("weight"), F.lit(0.0)))))
    whole = F.least(F.round("target").cast("long"), MOST_EPOCHS * F.col("source_size"))
    size = F.nullif("source_size", F.lit(0).cast("long"))
    per = per.withColumn("words", whole).withColumn("full_epochs", F.coalesce(F.floor(F.col("words") / size).cast("long"), F.lit(0).cast("long")))
    per = per.withColumn("rest_words", F.col("words") - F.col("full_epochs") * F.col("source_size")).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    per = per.withColumn("slots", F.col("full_epochs") * F.col("blocks") + F.ceil(F.col("rest_words") / block_words).cast("long"))
    order = W.orderBy("source_no")
    high = F.sum("slots").over(order)
    per = per.withColumns({"all_slots": F.sum("slots").over(every), "slots_to": high, "slots_from": high - F.col("slots")})
    return per.select("source_no", "source", "source_size", "target", "words", "full_epochs", "rest_words", "blocks", "slots", "slots_from", "slots_to", "all_slots")


def placed(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """sized with source_no and pos, the words of its source before it in shuffled order."""
    buckets = math.isqrt(rows) + 1  # buckets of a source and rows of a bucket both grow with the root
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("long")
    # every source's rows meet its one row of the (bounded) source table by a null-safe equi-join
    named = sized.join(sources.select("source_no", F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", bucket)
    sums = named.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(W.partitionBy("source_no").orderBy("bucket")) - F.col("in_bucket")
    sums = sums.select("source_no", "bucket", before.alias("before"))
    own = W.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size", "_v").rowsBetween(W.unboundedPreceding, 0)
    return named.withColumn("within", F.sum("size").over(own) - F.col("size")).join(sums, ["source_no", "bucket"]).withColumn("pos", F.col("before") + F.col("within")).drop("bucket", "before", "within", "key")


def schedule(sources: DataFrame, n: int) -> DataFrame:
    """slot, source_no, rank: which source each slot goes to, and how many of its slots came before."""
    spark = sources.sparkSession
    high, low = F.floor(F.col("id") / (1 << 20)), F.col("id") % (1 << 20) + 1  # keeps the fraction exact for large ids
    point = F.pmod(high * ((GOLDEN * (1 << 20)) % 1.0) + low * GOLDEN, F.lit(1.0))
    slots = spark.range(n).select(F.col("id").alias("slot"), (point * n).alias("x")).withColumn("cell", F.floor(F.col("x") / max(n, 1) * CELLS))
    cells = sources.where("slots > 0").select("source_no", "slots_from", "slots_to", F.explode(F.sequence(F.floor(F.col("slots_from") / n * CELLS), F.floor(F.col("slots_to") / n * CELLS))).alias("cell"))
    dealt = slots.join(cells, "cell").where("x >= slots_from and x < slots_to").select("slot", "source_no", F.floor(F.col("slot") / RUN_SLOTS).alias("run"))
    dealt = cut(dealt)
    counts = dealt.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("source_no").orderBy("run"))
    counts = counts.select("source_no", "run", (upto - F.col("n")).alias("before"), "n")
    rank = F.col("before") + F.row_number().over(W.partitionBy("source_no", "run").orderBy("slot")) - 1
    ranked = dealt.join(counts.drop("n"), ["source_no", "run"]).select("slot", "source_no", rank.alias("rank"))
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    late = sources.where("slots > 0").join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    late = late.select("source_no", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(late.select((F.lit(n) + F.col("rank") * (1 << 20) + F.col("source_no")).alias("slot"), "source_no", "rank"))


def identified(docs: DataFrame) -> DataFrame:
    """As ``with_identity``, but rows that repeat a doc_id share an identity only if all their columns agree."""
    value = lambda c, kind: F.to_json(F.struct(c)) if "map<" in kind else F.col(c)
    own = [x for c, kind in docs.dtypes for x in (F.col(c).isNull(), value(c, kind))]
    known = with_identity(docs)
    return known.withColumn("_v", F.when(F.col("_v") == 0, F.col("_v")).otherwise(F.xxhash64(*own)))


def mix(docs: DataFrame, block_words: int = 8192, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents placed, pieces taken) of the mix.

    placed: doc_id, source, size, source_no, source_size, target, pos and the row's identity.
    pieces: source_no, pos, slot, epoch, first_word, n_words: in slot order the mix's words.
    """
    known = identified(docs)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = cut(known.select("_k", "_v", "doc_id", "source", word_count().alias("size"), key.alias("key")))
    sources = cut(source_targets(sized, block_words))
    first = sources.select("all_slots").first()
    n = int(first.all_slots or 0) if first else 0
    where = cut(placed(sized, sources, sized.count()))
    if not n:
        empty = where.limit(0).select("source_no", "pos", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words"))
        return where, empty
    plan = schedule(sources, n).join(sources.drop("source", "target", "slots_from", "slots_to", "all_slots"), "source_no").where("rank < slots")
    epoch, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    plan = plan.select("source_no", "slot", epoch.alias("epoch"), block.alias("block"), (block * block_words).alias("from_word"), F.least((block + 1) * block_words, F.when(epoch >= F.col("full_epochs"), F.col("rest_words")).otherwise(F.col("source_size"))).alias("to_word"))
    spans = where.where("size > 0").select("source_no", "pos", "size", F.explode(F.sequence(F.floor(F.col("pos") / block_words), F.floor((F.col("pos") + F.col("size") - 1) / block_words))).alias("block"))
    begin, end = F.greatest("pos", "from_word"), F.least(F.col("pos") + F.col("size"), F.col("to_word"))
    pieces = spans.join(plan, ["source_no", "block"]).select("source_no", "pos", "slot", "epoch", (begin - F.col("pos")).alias("first_word"), (end - begin).alias("n_words")).where("n_words > 0")
    return where, pieces


def taken_words(docs: DataFrame, block_words: int = 8192, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot (null if nothing is taken)."""
    where, pieces = mix(docs, block_words, seed)
    taken = pieces.groupBy("source_no", F.col("pos").alias("_pos")).agg(F.sum("n_words").alias("_taken"), F.min("slot").alias("first_slot"))
    rows = where.withColumn("_pos", F.when(F.col("size") > 0, F.col("pos")))
    return rows.join(taken, ["source_no", "_pos"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, block_words: int = 8192, seed: int = 1) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch that takes a document, in the order of its first slot there.

    Rows are dealt out by ranges of slots and sorted within, so written files hold the schedule's order, and a document's epochs lie
    apart. The document at a source's target is cut after the last word taken (n_chars, if there, follows the text).
    """
    columns = docs.columns
    where, pieces = mix(docs, block_words, seed)
    epochs = pieces.groupBy("source_no", "pos", "epoch").agg(F.sum("n_words").alias("_words"), F.min("slot").alias("_slot"))
    epochs = epochs.join(where.where("size > 0").select("source_no", "pos", "_k", "_v", F.col("size").alias("_size")), ["source_no", "pos"]).select("_k", "_v", "_words", "_size", "_slot", F.col("pos").alias("_pos"))
    texts = identified(docs)
    if _repeats(where):
        texts = texts.dropDuplicates(["_k", "_v"])
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("_words").cast("int")), "")
    out = texts.join(epochs, ["_k", "_v"]).withColumn("text", F.when(F.col("_words") < F.col("_size"), head).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_words") < F.col("_size"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    order = ("_slot", "_pos", "_k", "_v")
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)


def _repeats(where: DataFrame) -> bool:
    return where.where("_v <> 0").limit(1).count() > 0
