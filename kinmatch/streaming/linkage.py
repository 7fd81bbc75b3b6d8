"""New S1 records, as a file stream, against a table of targets.

Candidates and scores of an S1 record depend on nothing but the targets, so each micro-batch adds them to a table. Exclusivity compares
all S1 records of a target and isn't append-only: links are decided over the whole table whenever they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinmatch.functions.text import normalize
from kinmatch.operators import blocking, decide
from kinmatch.plans.linkage import Config, Scorer, linear, score_candidates
from kinmatch.sources.shared import kept

RECORD = "entity_id string, business_name string, business_address string, country string, ordinal long, source string"


def link_stream(spark: SparkSession, arrivals: str, targets: DataFrame, scores: str, checkpoint: str, scorer: Scorer = linear, config: Config = Config(), **trigger) -> StreamingQuery:  # noqa: B008
    """Scores the Parquet records that arrive in a folder into the table ``scores``; an interrupted batch is written again, not twice.

    The targets are normalized, keyed and their keys capped once, when the stream starts.
    """
    known = kept(normalize(targets), "stream-targets")
    keys = blocking.blocking_keys(known)
    keys = kept(keys.join(blocking.capped_keys(keys, config.common_limit, config.rare_limit).select(*blocking.KEY), blocking.KEY, "left_semi"), "stream-keys")

    def score(batch: DataFrame, number: int) -> None:
        s1 = normalize(batch)
        pairs = blocking.top_candidates(blocking.shared_keys(blocking.blocking_keys(s1), keys, None, None), config.top_k)
        score_candidates(s1, known, pairs, scorer).write.mode("overwrite").parquet(f"{scores}/batch={number}")

    stream = spark.readStream.schema(RECORD).parquet(arrivals)
    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_links(spark: SparkSession, scores: str, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Links of all that has arrived, each target with one owner."""
    return decide.decide(spark.read.parquet(scores), config.s2_threshold, config.s3_threshold)
