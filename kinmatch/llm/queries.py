"""The operators applied to their whole tables, with the columns their contracts name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import ann, cover_tree, line_dedup, mixing, near_dedup, packing, suffix_dedup, token_files, toxicity, url_rules
from kinmatch.llm.encoding import default_tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, default_tokenizer(), token_files.token_folder(spark), end_id=0)
    return token_files.read_token_files(manifest, with_ids=False)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, url_rules.default_rules())
    site = F.col("rule").isin(*(spec for _, spec in url_rules.SITE_RULES))
    return judged.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.when(~site, F.col("rule")).alias("pattern"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.is_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ann, op2_near_dedup, op3_token_files, op4_url_rules, op5_packing, op6_line_dedup, op7_suffix_dedup, op8_toxicity, op9_cover_tree, op10_mixing)}

NAMES = {name: ", ".join(f"'{w}'" for w in words) for name, words in (("blocked", url_rules.BLOCKED_WORDS), ("paired", url_rules.PAIRED), ("companions", url_rules.COMPANIONS))}

OP4_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS site,
    regexp_extract_all(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+|[^a-z0-9]+') AS l FROM parts),
tokens AS (SELECT row, unnest(l) AS a, unnest(list_append(l[2:], NULL)) AS sep, unnest(list_append(list_append(l[3:], NULL), NULL)) AS b FROM ruled WHERE site IS NULL),
fits AS (
  SELECT row, 'word:' || a AS name FROM tokens WHERE a IN ({NAMES["blocked"]})
  UNION ALL
  SELECT row, 'pair:' || a || '-' || b FROM tokens
  WHERE sep IN ('-', '_', '.') AND (a IN ({NAMES["paired"]}) AND b IN ({NAMES["companions"]}) OR a IN ({NAMES["companions"]}) AND b IN ({NAMES["paired"]}))),
won AS (SELECT row, min(name) AS pattern FROM fits GROUP BY row)
SELECT page_id, host, path, site AS rule, pattern,
       CASE WHEN site IN ('net/', 'example.com/de/') THEN 'block' WHEN site IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN won USING (row)
"""

OP6_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos, len(l) AS n FROM split),
triples AS (
  SELECT doc_id, pos, n, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM triples
  WHERE pos + 2 < n AND regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (VALUES (0), (1), (2)) v(d) WHERE k > 1),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT s.doc_id, CAST(COALESCE(len(l), 0) AS INTEGER) AS n_lines, CAST(COALESCE(len(l), 0) - COALESCE(n_kept, 0) AS INTEGER) AS n_removed,
       CASE WHEN s.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text
FROM split s LEFT JOIN kept k USING (doc_id)
"""

BLOCK = 8192

OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('1:' || doc_id) AS key FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source),
shares AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, 3.0::DOUBLE * source_size AS cap,
         COALESCE(sum(3.0::DOUBLE * source_size) OVER b, 0) AS caps_before, sum(w) OVER () - COALESCE(sum(w) OVER b, 0) AS w_left FROM per
  WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (total - caps_before) / w_left * w > cap AS stopped FROM shares),
targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap ELSE least(cap, w * (total - COALESCE(sum(cap) FILTER (WHERE stopped) OVER (), 0)) / nullif(sum(w) FILTER (WHERE NOT stopped) OVER (), 0)) END AS target
  FROM capped),
worded AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no, least(CAST(round(target) AS BIGINT), 3 * source_size) AS words FROM targets),
slotted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * ceil(source_size / {BLOCK}) + ceil(words % source_size / {BLOCK}) END AS slots FROM worded),
sched AS (SELECT *, sum(slots) OVER (ORDER BY source_no) AS slots_to, sum(slots) OVER () AS n FROM slotted),
points AS (
  SELECT i, ((i // 1048576) * {(mixing.GOLDEN * (1 << 20)) % 1.0!r}e0 + (i % 1048576 + 1) * {mixing.GOLDEN!r}e0) % 1.0 * n AS x
  FROM (SELECT n, unnest(range(CAST(n AS BIGINT))) AS i FROM (SELECT max(n) AS n FROM sched))),
dealt AS (
  SELECT source_no, slots, i AS slot, row_number() OVER (PARTITION BY source_no ORDER BY i) - 1 AS rank
  FROM points JOIN sched ON x >= slots_to - slots AND x < slots_to),
late AS (
  SELECT source_no, n, unnest(range(COALESCE(got, 0), CAST(slots AS BIGINT))) AS rank
  FROM sched LEFT JOIN (SELECT source_no, count(*) AS got FROM dealt GROUP BY source_no) USING (source_no)),
ranked AS (
  SELECT source_no, rank, slot FROM dealt WHERE rank < slots
  UNION ALL SELECT source_no, rank, CAST(n AS BIGINT) + rank * 1048576 + source_no FROM late),
placed AS (
  SELECT s.*, t.source_no, t.source_size, t.target, t.words, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id) - size AS BIGINT) AS pos
  FROM sized s JOIN sched t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST((words // source_size) * size + greatest(0, least(size, words % source_size - pos)) AS BIGINT) END AS taken
  FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM taking LEFT JOIN ranked ON taking.source_no = ranked.source_no AND rank = pos // {BLOCK}
"""

SQL: dict[str, str] = {"op4_url_rules": OP4_SQL, "op6_line_dedup": OP6_SQL, "op10_mixing": OP10_SQL}
