"""Line dedup: repeated runs of three lines, in DataFrame operations only.

Every three consecutive lines of a text are hashed (two 64-bit hashes). Over all documents, the first occurrence of a hash in the
order of doc_id and position stays; each later one is marked, and the lines that marked windows cover, merged into runs, go.
Windows of blank lines only (spaces, tabs, carriage returns) don't count.

The first occurrences come from a partial aggregation, and only hashes that repeat go on; they are written to shared storage, so both
sides of the join back are plain exchanges, whose hot hashes (a line that a third of all documents share) adaptive execution splits.
Text moves once, to meet its runs.

Results for odd input: null text stays null, fewer than three lines stay as they are; rows that share a doc_id are documents of their
own, in the order of a hash of their texts (a null doc_id sorts as 0), and of rows that repeat in doc_id and text the copies are later
occurrences; an occurrence overlapping the one before it is later too (of five equal lines the first stays); lines end at line feeds
only; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import WORD, with_identity, written

WINDOW = 3


def each_row(docs: DataFrame) -> DataFrame:
    """docs with ``_k, _h, _v``, which tell all rows apart and order them: doc_id, and where rows share one a hash of the text and a number.

    Numbers are given once and written, as only a table on storage gives its rows the same ones again.
    """
    known = with_identity(docs).withColumnRenamed("_v", "_h")
    if known.where("_h <> 0").limit(1).count():
        return written(known.withColumn("_v", F.monotonically_increasing_id()), "numbered")
    return known.withColumn("_v", F.lit(0).cast("long"))


def marked_windows(docs: DataFrame) -> DataFrame:
    """_k, _h, _v, pos of every window that occurs earlier; docs have _k, _h, _v and text."""
    lines = docs.where(F.col("text").contains("\n")).select("_k", "_h", "_v", F.split("text", "\n").alias("lines")).where(F.size("lines") >= WINDOW)
    triple = lambda x, i: (x, F.get("lines", i + 1), F.get("lines", i + 2))
    blank = lambda *own: ~F.concat(*own).rlike(WORD)
    hashed = F.transform(F.slice("lines", 1, F.size("lines") - (WINDOW - 1)), lambda x, i: F.when(~blank(*triple(x, i)), F.struct(F.xxhash64(*triple(x, i)).alias("h1"), F.xxhash64(F.lit(1), *triple(x, i)).alias("h2"))))
    windows = lines.select("_k", "_h", "_v", F.posexplode(hashed).alias("pos", "h")).where("h is not null").select("_k", "_h", "_v", "pos", "h.h1", "h.h2")
    place = F.struct("_k", "_h", "_v", "pos")
    first = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first"), "first-windows")
    return windows.join(first, ["h1", "h2"]).where(place != F.col("first")).select("_k", "_h", "_v", "pos")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without the marked lines, and n_lines, n_removed, removed (runs of line numbers: first, end)."""
    known = each_row(docs.drop("n_lines", "n_removed", "removed"))
    starts = marked_windows(known).groupBy("_k", "_h", "_v").agg(F.sort_array(F.collect_set("pos")).alias("_p"))
    # neighbours within a window's length are one run
    firsts = F.filter("_p", lambda x, i: (i == 0) | (x - F.get("_p", i - 1) > WINDOW))
    ends = F.transform(F.filter("_p", lambda x, i: (i == F.size("_p") - 1) | (F.get("_p", i + 1) - x > WINDOW)), lambda x: x + WINDOW)
    runs = starts.select("_k", "_h", "_v", F.zip_with(firsts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("end"))).alias("removed"))
    joined = known.join(runs, ["_k", "_h", "_v"], "left").withColumn("_lines", F.split("text", "\n"))
    begin = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["end"]))
    stop = F.concat(F.transform("removed", lambda r: r["first"]), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(begin, stop, lambda a, b: F.slice("_lines", a + 1, b - a)))
    gone = F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["first"])
    empty = F.array().cast("array<struct<first:int,end:int>>")
    columns = [c for c in known.columns if c not in ("_k", "_h", "_v")]
    out = joined.withColumns({"text": F.when(F.col("removed").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")), "n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "n_removed": F.coalesce(gone, F.lit(0))})
    out = out.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("removed").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*columns, "n_lines", "n_removed", F.coalesce("removed", empty).alias("removed"))
