"""One query per linkage operator over the benchmark tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import text
from kinmatch.functions.tables import COMMON_ADDRESS_WORDS, LEGAL_SUFFIXES, expansions
from kinmatch.operators import blocking, decide, evaluate, features, model, quality
from kinmatch.plans import linkage
from kinmatch.plans.views import RECORDS_SQL, TRUTH_SQL, doc_records, doc_truth, doc_words, table
from kinmatch.sources import scans
from kinmatch.sources.shared import kept, release

Query = Callable[[SparkSession, str], DataFrame]

#: Production caps; thresholds on the scale of the linear scorer, which isn't a probability.
CONFIG = linkage.Config(s2_threshold=0.45, s3_threshold=0.40)
DIGITS = 6


def rounded(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes])


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "country", "ordinal")


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return linkage.retrieve(doc_records(spark, sf_dir), CONFIG)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir)[2]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.score_candidates(*_retrieved(spark, sf_dir)).withColumn("p", F.round("p", 9))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(_scored(spark, sf_dir), CONFIG.s2_threshold, CONFIG.s3_threshold)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_records(spark, sf_dir)


def truth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_truth(spark, sf_dir)


def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = text.normalize(doc_records(spark, sf_dir))
    return known.select("entity_id", "clean_name", "core_name", "clean_addr", F.array_join(F.array_sort("numbers"), ",").alias("numbers"), "sorted_name", "sorted_addr")


def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean(F.col("url")).alias("clean_name"))


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key, column: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(key).alias("id"), text.clean(F.col(column)).alias("clean_name"))
    return one("customer", "c_custkey", "c_name").unionByName(one("supplier", "s_suppkey", "s_name")).unionByName(one("part", "p_partkey", "p_name"))


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = text.normalize(doc_records(spark, sf_dir))
    return known.select("entity_id", F.array_join(F.array_sort(text.char_ngrams(F.col("core_name"))), "|").alias("grams"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.countries(doc_records(spark, sf_dir))


def last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), "o_totalprice", F.col("o_orderkey").alias("ordinal"))
    return scans.last_of_each(orders)


def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.blocking_keys(text.normalize(doc_records(spark, sf_dir)))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = text.normalize(doc_records(spark, sf_dir))
    return blocking.postings(blocking.blocking_keys(known.where("source <> 'S1'")))


def capped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.capped_keys(blocking.blocking_keys(text.normalize(doc_records(spark, sf_dir)).where("source <> 'S1'")), CONFIG.common_limit, CONFIG.rare_limit)


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = text.normalize(doc_records(spark, sf_dir))
    return blocking.shared_keys(blocking.blocking_keys(known.where("source = 'S1'")), blocking.blocking_keys(known.where("source <> 'S1'")), CONFIG.common_limit, CONFIG.rare_limit)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


def native_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, targets, pairs = _retrieved(spark, sf_dir)
    return rounded(features.native_features(features.with_texts(pairs, s1, targets)).select("s1_id", "target_id", *features.NATIVE))


def fuzzy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, targets, pairs = _retrieved(spark, sf_dir)
    return rounded(features.pair_features(pairs, s1, targets).select("s1_id", "target_id", "name_token_sort", "addr_token_sort", "name_token_set", "cross_prod", "cross_sum", "cross_max", "cross_min"))


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, targets, pairs = _retrieved(spark, sf_dir)
    return rounded(features.pair_features(pairs, s1, targets).select("s1_id", "target_id", *features.NAMES))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("s1_id", "target_id", F.round("p", DIGITS).alias("p"))


def exclusive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("s1_id", "target_id", F.round("p", DIGITS).alias("p"))


def matched_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.matched_lists(_spine(spark, sf_dir), _links(spark, sf_dir), "ids")
    return out.select("s1_id", F.array_join("ids", ",").alias("ids"))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.entity_counts(_spine(spark, sf_dir), doc_truth(spark, sf_dir), _links(spark, sf_dir)))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics(evaluate.entity_counts(_spine(spark, sf_dir), doc_truth(spark, sf_dir), _links(spark, sf_dir))))


def metrics_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics(evaluate.entity_counts(_spine(spark, sf_dir), doc_truth(spark, sf_dir), _links(spark, sf_dir), "country"), "country"))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.source_report(_spine(spark, sf_dir), doc_truth(spark, sf_dir), _links(spark, sf_dir), _candidates(spark, sf_dir)))


def link_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.link_metrics(doc_truth(spark, sf_dir), _links(spark, sf_dir)))


def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.candidate_recall(doc_truth(spark, sf_dir), _candidates(spark, sf_dir), _spine(spark, sf_dir)))


def candidate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidate_histogram(evaluate.per_entity(_spine(spark, sf_dir), _candidates(spark, sf_dir)))


def candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.candidate_statistics(evaluate.per_entity(_spine(spark, sf_dir), _candidates(spark, sf_dir))))


def restricted_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    oracle = evaluate.restricted_oracle(doc_truth(spark, sf_dir), _candidates(spark, sf_dir))
    out = evaluate.metrics(evaluate.entity_counts(_spine(spark, sf_dir), doc_truth(spark, sf_dir), oracle))
    return rounded(out.withColumn("recommendation", evaluate.recommendation(F.col("macro_f05"))))


def error_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.decompose_errors(doc_truth(spark, sf_dir), _scored(spark, sf_dir), CONFIG.s2_threshold, CONFIG.s3_threshold)


def source_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decide.search_source_thresholds(_spine(spark, sf_dir), doc_truth(spark, sf_dir), _scored(spark, sf_dir)))


def global_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decide.search_global_threshold(_spine(spark, sf_dir), doc_truth(spark, sf_dir), _scored(spark, sf_dir)))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, targets, pairs = _retrieved(spark, sf_dir)
    return model.training_pairs(s1.select(F.col("entity_id").alias("s1_id")), doc_truth(spark, sf_dir), pairs, targets).select("s1_id", "target_id", "shared_keys", "label")


def reduced_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = doc_records(spark, sf_dir).where("source <> 'S1'")
    return model.reduced_pool(targets, doc_truth(spark, sf_dir)).select("entity_id", "source", "ordinal")


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are parsed once; training and scoring read records and truth many times
    words = kept(doc_words(spark, sf_dir), "words")
    known, truth = kept(text.normalize(doc_records(spark, sf_dir, words)), "records"), kept(doc_truth(spark, sf_dir, words), "truth")
    fitted = linkage.train(known, truth, known.where("source = 'S1'").select(F.col("entity_id").alias("s1_id")), config=CONFIG)
    s1, targets, pairs = linkage.retrieve(known, CONFIG)
    pairs = kept(pairs, "candidates")
    release(spark)
    scored = linkage.score_candidates(s1, targets, pairs, linkage.trained(fitted))
    return scored.select("s1_id", "target_id", F.round("p", 4).alias("p"))


def candidate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidate_hashes(_candidates(spark, sf_dir))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.density(doc_records(spark, sf_dir)))


def _study(truth: DataFrame, s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    capped = evaluate.blocking_study(truth, s1_keys, target_keys, CONFIG.common_limit, CONFIG.rare_limit).withColumn("caps", F.lit(True))
    return capped.unionByName(evaluate.blocking_study(truth, s1_keys, target_keys, None, None).withColumn("caps", F.lit(False)))


def _study_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth, S1's keys, targets' keys), which the study reads many times."""
    keys = kept(blocking.blocking_keys(text.normalize(doc_records(spark, sf_dir))), "keys")
    own = F.col("entity_id").startswith("S1-")
    return kept(doc_truth(spark, sf_dir), "truth"), keys.where(own), keys.where(~own)


def blocking_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(*_study_tables(spark, sf_dir))


def blocking_study_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As blocking_study, each source's targets with an index and caps of their own."""
    truth, s1_keys, target_keys = _study_tables(spark, sf_dir)
    of = lambda rows, column, source: rows.where(F.col(column).startswith(f"{source}-"))
    found = [_study(of(truth, "target_id", s), s1_keys, of(target_keys, "entity_id", s)).withColumn("source", F.lit(s)) for s in ("S2", "S3")]
    return found[0].unionByName(found[1]).select("links", "hit_all", "hit_20", "hit_50", "source", "caps")


def candidates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = text.normalize(doc_records(spark, sf_dir))
    return blocking.candidates_by_source(known.where("source = 'S1'"), known.where("source <> 'S1'"), CONFIG.top_k, CONFIG.common_limit, CONFIG.rare_limit)


def candidates_across_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = blocking.across_countries(text.normalize(doc_records(spark, sf_dir)))
    return blocking.candidates(known.where("source = 'S1'"), known.where("source <> 'S1'"), CONFIG.top_k, CONFIG.common_limit, CONFIG.rare_limit)


def target_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy(F.substring("target_id", 1, 2).alias("source")).agg(F.count("*").alias("pairs"), F.count_distinct("target_id").alias("targets"))


def retrieval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an index over all countries, within the first 20."""
    return evaluate.retrieval_categories(doc_truth(spark, sf_dir), candidates_across_countries(spark, sf_dir), 20)


def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_spine(spark, sf_dir), _links(spark, sf_dir))


def rule_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result rows of the links, each kind of fault planted by doc_id."""
    lists = decide.matched_lists(_spine(spark, sf_dir), doc_truth(spark, sf_dir), "ids")
    n = F.col("ordinal")
    ids = F.array_join("ids", ",")
    line = F.when(n % 11 == 0, F.col("s1_id")).when(n % 13 == 0, F.concat("s1_id", F.lit("\tS1-1,S4-2"))).when(n % 17 == 0, F.concat("s1_id", F.lit("\tS2-1,S2-1"))).otherwise(F.concat("s1_id", F.lit("\t"), ids))
    lines = lists.where(n % 19 > 0).select(line.alias("value"), "ordinal")
    extra = lists.where(n % 23 == 0).select(F.concat("s1_id", F.lit("x\tS2-0")).alias("value"), "ordinal")
    rows = quality.result_rows(lines.unionByName(extra).unionByName(extra))
    known = doc_records(spark, sf_dir).where("source <> 'S1'").select(F.col("entity_id").alias("target_id"))
    return quality.findings(quality.offenders(rows, _spine(spark, sf_dir), known)).select("rule", "offenders", F.array_join("examples", ",").alias("examples"))


def outside_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = _spine(spark, sf_dir)
    rows = lambda links: decide.matched_lists(spine, links, "ids").select("s1_id", "ids", "ordinal")
    return quality.outside_candidates(rows(doc_truth(spark, sf_dir)), rows(_candidates(spark, sf_dir)))


def select_and_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, truth = doc_records(spark, sf_dir), doc_truth(spark, sf_dir)
    ids = truth.select(F.col("target_id").alias("entity_id")).distinct()
    inside = known.join(ids, "entity_id", "left_semi").select("entity_id", F.lit("selected").alias("kind"))
    return inside.unionByName(known.where("source <> 'S1'").join(ids, "entity_id", "left_anti").select("entity_id", F.lit("excluded").alias("kind")))


_FUNCTIONS = (
    records, truth_links, normalize_records, normalize_urls, normalize_names, char_ngrams, countries, last_of_each, blocking_keys, postings, capped_keys, shared_keys,
    candidates, native_features, fuzzy_features, all_features, scored_pairs, exclusive_links, matched_lists, entity_scores, metrics, metrics_by_country, source_report,
    link_metrics, candidate_recall, candidate_histogram, candidate_statistics, restricted_oracle, error_decomposition, source_threshold_grid, global_threshold_grid,
    training_pairs, reduced_pool, boosted_scores, candidate_hashes, density, blocking_study, blocking_study_by_source, candidates_by_source, candidates_across_countries, target_universe, retrieval_categories, link_summary, rule_offenders, outside_candidates, select_and_exclude,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _FUNCTIONS}


# ---------------------------------------------------------------- the same in SQL

def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _clean(x: str) -> str:
    plain = f"regexp_replace(strip_accents(replace(CASE WHEN {x} IS NULL OR {x} = 'null' THEN '' ELSE {x} END, 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')"
    bare = f"regexp_replace(lower({plain}), 'https?://(?:www\\.)?', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({bare}, '\\.(com|org|net|in|co|io|fr)\\b', ' ', 'g'), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


_EXPANSIONS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(expansions().items())) + "}"

NORMALIZED_SQL = f"""{RECORDS_SQL},
cleaned AS (SELECT *, {_clean('business_name')} AS clean_name, {_clean('business_address')} AS a0 FROM records),
tokened AS (SELECT *, {_tokens('clean_name')} AS ntk, {_tokens('a0')} AS atk FROM cleaned),
cored AS (SELECT *, list_filter(ntk, lambda t: NOT list_contains({_list(LEGAL_SUFFIXES)}, t)) AS ct FROM tokened),
normalized AS (
  SELECT entity_id, country, source, ordinal, clean_name, array_to_string(CASE WHEN len(ct) = 0 THEN ntk ELSE ct END, ' ') AS core_name,
         array_to_string(list_transform(atk, lambda t: COALESCE({_EXPANSIONS}[t], t)), ' ') AS clean_addr,
         list_distinct(list_filter(atk, lambda t: regexp_matches(t, '^[0-9]+$'))) AS numbers, array_to_string(list_sort(ntk), ' ') AS sorted_name FROM cored)"""

KEYS_SQL = f"""{NORMALIZED_SQL},
parts AS (SELECT *, {_tokens('core_name')} AS n, {_tokens('clean_addr')} AS a FROM normalized),
signed AS (SELECT *, list_filter(a, lambda t: NOT list_contains({_list(COMMON_ADDRESS_WORDS)}, t) AND length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')) AS sig FROM parts),
keyed AS (
  SELECT entity_id, country, source, unnest(list_distinct(flatten([
    CASE WHEN length(array_to_string(n, '')) >= 4 THEN ['compact_n|' || array_to_string(n, ''), 'compact_sort_n|' || array_to_string(list_sort(n), '')] ELSE [] END,
    CASE WHEN length(core_name) >= 3 THEN ['core_n|' || core_name] ELSE [] END,
    CASE WHEN len(n) >= 2 THEN ['n2|' || n[1] || '_' || n[2], 'sort_n|' || array_to_string(list_sort(n), ' ')] ELSE [] END,
    CASE WHEN len(n) = 1 AND length(n[1]) >= 3 THEN ['n1|' || n[1]] ELSE [] END,
    list_transform(list_filter(n, lambda t: length(t) >= 4), lambda t: 'n_tok|' || t),
    CASE WHEN len(a) >= 1 THEN list_transform(numbers, lambda x: 'num_city1|' || x || '_' || a[-1]) ELSE [] END,
    CASE WHEN len(a) >= 2 THEN list_transform(numbers, lambda x: 'num_city2|' || x || '_' || a[-2]) ELSE [] END,
    flatten(list_transform(numbers, lambda x: list_transform(sig[1:3], lambda w: 'num_street|' || x || '_' || w))),
    CASE WHEN len(n) >= 1 THEN list_transform(numbers, lambda x: 'name_num|' || n[1] || '_' || x) ELSE [] END,
    CASE WHEN len(n) >= 2 THEN list_transform(numbers, lambda x: 'name_num2|' || n[2] || '_' || x) ELSE [] END,
    CASE WHEN len(n) >= 1 AND len(a) >= 1 THEN ['name_city|' || n[1] || '_' || a[-1]] ELSE [] END,
    CASE WHEN len(n) >= 1 AND len(a) >= 2 THEN ['name_city2|' || n[1] || '_' || a[-2]] ELSE [] END,
    flatten(list_transform(range(1, least(len(sig), 4) + 1), lambda i: list_transform(range(i + 1, least(len(sig), 4) + 1), lambda j: 'addr_pair|' || least(sig[i], sig[j]) || '_' || greatest(sig[i], sig[j]))))
  ]))) AS k FROM signed),
keys AS (SELECT country, split_part(k, '|', 1) AS key_type, split_part(k, '|', 2) AS key_value, entity_id, source FROM keyed),
posted AS (SELECT country, key_type, key_value, count(*) AS postings FROM keys WHERE source <> 'S1' GROUP BY ALL),
capped AS (SELECT * FROM posted WHERE postings <= CASE WHEN key_type IN ('sort_n', 'addr_pair') THEN {CONFIG.rare_limit} ELSE {CONFIG.common_limit} END)"""

PAIRS_SQL = f"""{KEYS_SQL},
paired AS (
  SELECT s.entity_id AS s1_id, t.entity_id AS target_id, count(*) AS shared_keys FROM keys s JOIN capped c USING (country, key_type, key_value) JOIN keys t USING (country, key_type, key_value)
  WHERE s.source = 'S1' AND t.source <> 'S1' GROUP BY ALL)"""

CANDIDATES_SQL = f"""{PAIRS_SQL},
candidates AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY shared_keys DESC, target_id) AS INTEGER) AS rank FROM paired) WHERE rank <= {CONFIG.top_k})"""


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) ELSE 0.0 END"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"


def _addr(x: str) -> str:
    return f"CASE WHEN sa <> '' AND ta <> '' THEN {x} ELSE 0.0 END"


FEATURES_SQL = f"""{CANDIDATES_SQL},
texts AS (
  SELECT c.*, s.clean_name AS sn, t.clean_name AS tn, s.core_name AS sc, t.core_name AS tc, s.clean_addr AS sa, t.clean_addr AS ta, s.numbers AS su, t.numbers AS tu, s.sorted_name AS ss, t.sorted_name AS ts,
         list_distinct({_tokens('s.core_name')}) AS sk, list_distinct({_tokens('t.core_name')}) AS tk, list_distinct({_tokens('s.clean_addr')}) AS sak, list_distinct({_tokens('t.clean_addr')}) AS tak,
         COALESCE(({_tokens('s.core_name')})[1], '') AS s1, COALESCE(({_tokens('t.core_name')})[1], '') AS t1, s.ordinal AS s1_ordinal
  FROM candidates c JOIN normalized s ON s.entity_id = s1_id JOIN normalized t ON t.entity_id = target_id),
features AS (
  SELECT *, {_flag("sn = tn AND sn <> ''")} AS name_exact_clean, {_flag("sc = tc AND sc <> ''")} AS name_exact_core, {_lev('sn', 'tn')} AS name_lev_sim,
    {_jac('sk', 'tk')} AS name_token_jaccard, CASE WHEN len(sk) > 0 AND len(tk) > 0 THEN len(list_intersect(sk, tk)) / least(len(sk), len(tk)) ELSE 0.0 END AS name_token_overlap,
    CAST(abs(length(sn) - length(tn)) AS DOUBLE) AS name_len_diff, CASE WHEN greatest(length(sn), length(tn)) > 0 THEN least(length(sn), length(tn)) / greatest(length(sn), length(tn)) ELSE 0.0 END AS name_len_ratio,
    {_flag("length(sc) >= 4 AND length(tc) >= 4 AND left(sc, 4) = left(tc, 4)")} AS name_prefix_match, {_jac(f"({_grams('sc')})", f"({_grams('tc')})")} AS name_char_3gram,
    {_flag(f"len(sk) > 0 AND len(tk) > 0 AND ({_lev('s1', 't1')}) >= 0.8")} AS name_first_token_match, {_flag(f"len(sk) > 0 AND len(tk) > 0 AND ({_lev('s1', 't1')}) < 0.5")} AS name_first_token_conflict,
    {_flag("ta <> ''")} AS addr_has_val, {_addr(_flag('sa = ta'))} AS addr_exact_clean, {_addr(_lev('sa', 'ta'))} AS addr_lev_sim, {_addr(_jac('sak', 'tak'))} AS addr_token_jaccard,
    {_addr('CAST(len(list_intersect(su, tu)) AS DOUBLE)')} AS num_common_count, {_addr(_flag('len(list_intersect(su, tu)) > 0'))} AS num_has_match,
    {_addr(_flag('len(su) > 0 AND len(tu) > 0 AND len(list_intersect(su, tu)) = 0'))} AS num_has_mismatch, {_flag("sc = tc AND sc <> '' AND ta = ''")} AS exact_core_no_addr,
    {_flag("starts_with(target_id, 'S2-')")} AS is_source2, {_flag("starts_with(target_id, 'S3-')")} AS is_source3, CAST(shared_keys AS DOUBLE) AS shared_keys_count
  FROM texts),
scored AS (
  SELECT s1_id, target_id, s1_ordinal, rank, round(0.25 * name_lev_sim + 0.25 * name_token_jaccard + 0.15 * name_char_3gram + 0.2 * addr_token_jaccard + 0.1 * addr_lev_sim + 0.05 * num_has_match, 9) AS p FROM features),
accepted AS (SELECT * FROM scored WHERE p >= CASE WHEN starts_with(target_id, 'S2-') THEN {CONFIG.s2_threshold} ELSE {CONFIG.s3_threshold} END),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, s1_ordinal) AS r FROM accepted) WHERE r = 1),
spine AS (SELECT entity_id AS s1_id, country, ordinal FROM records WHERE source = 'S1')"""


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence by its table, a row at a time."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[-1]) END), [0])"
    return f"list_reduce(range(1, length({a}) + 1), lambda prev, i: {row}, list_transform(range(0, length({b}) + 1), lambda j: 0))[-1]"


def _f05(tp: str, true: str, pred: str) -> str:
    return f"CASE WHEN {true} = 0 AND {pred} = 0 THEN 1.0 WHEN {true} = 0 OR {pred} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25 * ({tp} / {pred}) * ({tp} / {true}) / (0.25 * ({tp} / {pred}) + {tp} / {true}) END"


def _counts(links: str, where: str = "TRUE") -> str:
    return f"""SELECT s.s1_id, s.country, count(t.target_id) AS n_true, count(l.target_id) AS n_pred, count(CASE WHEN t.target_id IS NOT NULL AND l.target_id IS NOT NULL THEN 1 END) AS tp
  FROM spine s LEFT JOIN (SELECT s1_id, target_id FROM truth WHERE {where} UNION SELECT s1_id, target_id FROM {links} WHERE {where}) u ON u.s1_id = s.s1_id
  LEFT JOIN truth t ON t.s1_id = u.s1_id AND t.target_id = u.target_id LEFT JOIN {links} l ON l.s1_id = u.s1_id AND l.target_id = u.target_id GROUP BY ALL"""


def _metrics(counts: str, by: str = "", more: str = "") -> str:
    return f"""SELECT {by} count(*) AS entities, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred) - sum(tp) AS BIGINT) AS fp, CAST(sum(n_true) - sum(tp) AS BIGINT) AS fn, CAST(sum(n_pred) AS BIGINT) AS pred_links, CAST(sum(n_true) AS BIGINT) AS true_links,
  round(CASE WHEN sum(n_pred) > 0 THEN sum(tp) / sum(n_pred) ELSE 1.0 END, 6) AS precision, round(CASE WHEN sum(n_true) > 0 THEN sum(tp) / sum(n_true) ELSE 0.0 END, 6) AS recall,
  round(avg({_f05('tp', 'n_true', 'n_pred')}), 6) AS macro_f05, round(COALESCE(avg(CASE WHEN n_true > 0 THEN CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (n_true + n_pred) END END), 0.0), 6) AS macro_f1_linked,
  count(CASE WHEN n_true = 0 THEN 1 END) AS singletons, count(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1 END) AS singletons_right,
  round(COALESCE(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS singleton_accuracy {more} FROM ({counts}) GROUP BY {by.rstrip(', ') or '()'}"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_ALL = f"{FEATURES_SQL},{TRUTH_SQL}"
_RANKED = f"{CANDIDATES_SQL},{TRUTH_SQL}, spine AS (SELECT entity_id AS s1_id, country, ordinal FROM records WHERE source = 'S1')"
_ACROSS = CANDIDATES_SQL.replace("SELECT country, split_part", "SELECT '' AS country, split_part")
_PER = "SELECT s.s1_id, count(c.target_id) AS n FROM spine s LEFT JOIN candidates c USING (s1_id) GROUP BY ALL"
_SOURCE = lambda p: f"""SELECT m.*, '{p}' AS source, (SELECT count(*) FROM candidates WHERE starts_with(target_id, '{p}')) AS candidate_pairs,
  (SELECT count(*) FROM truth JOIN candidates USING (s1_id, target_id) WHERE starts_with(target_id, '{p}')) AS retrieved,
  round(CASE WHEN true_links > 0 THEN (SELECT count(*) FROM truth JOIN candidates USING (s1_id, target_id) WHERE starts_with(target_id, '{p}')) / true_links ELSE 0.0 END, 6) AS candidate_recall
  FROM ({_metrics(_counts('links', f"starts_with(target_id, '{p}')"))}) m"""  # noqa: E731


def _token_set(w: str) -> str:
    x, y, c, ox, oy, lx, ly, k, g = (f"{n}_{w}" for n in ("x", "y", "c", "ox", "oy", "lx", "ly", "k", "g"))
    return f"""CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 WHEN len({c}) > 0 AND (len({ox}) = 0 OR len({oy}) = 0) THEN 1.0 ELSE greatest(
  1 - (length({lx}) + length({ly}) - 2 * {_lcs(lx, ly)}) / (2 * ({k} + {g}) + length({lx}) + length({ly})), CASE WHEN {k} > 0 THEN 2 * {k} / (2 * {k} + {g} + length({lx})) ELSE 0 END, CASE WHEN {k} > 0 THEN 2 * {k} / (2 * {k} + {g} + length({ly})) ELSE 0 END) END"""


FUZZY_SQL = f"""{FEATURES_SQL},
fuzzy AS (
  SELECT s1_id, target_id, f3 AS name_jw_sim, f17 AS addr_jw_sim, f4 AS name_token_sort, f18 AS addr_token_sort, f5 AS name_token_set, f19 AS addr_token_set, f4 * e AS cross_prod, f4 + e AS cross_sum, greatest(f4, e) AS cross_max, least(f4, e) AS cross_min
  FROM (SELECT *, CASE WHEN ta <> '' THEN f18 ELSE f4 END AS e FROM (
    SELECT s1_id, target_id, ta, CASE WHEN sn <> '' AND tn <> '' THEN jaro_winkler_similarity(sn, tn) ELSE 0.0 END AS f3, CASE WHEN sa <> '' AND ta <> '' THEN jaro_winkler_similarity(sa, ta) ELSE 0.0 END AS f17,
      CASE WHEN sn <> '' AND tn <> '' THEN 2 * {_lcs('ss', 'ts')} / (length(ss) + length(ts)) ELSE 0.0 END AS f4,
      CASE WHEN sa <> '' AND ta <> '' THEN 2 * {_lcs('sas', 'tas')} / (length(sas) + length(tas)) ELSE 0.0 END AS f18, {_token_set('n')} AS f5, {_token_set('a')} AS f19
    FROM (SELECT *, {', '.join(f"array_to_string(list_sort(ox_{w}), ' ') AS lx_{w}, array_to_string(list_sort(oy_{w}), ' ') AS ly_{w}, length(array_to_string(c_{w}, ' ')) AS k_{w}, CASE WHEN len(c_{w}) > 0 THEN 1 ELSE 0 END AS g_{w}" for w in 'na')}
      FROM (SELECT *, {', '.join(f"list_intersect(x_{w}, y_{w}) AS c_{w}, list_filter(x_{w}, lambda t: NOT list_contains(y_{w}, t)) AS ox_{w}, list_filter(y_{w}, lambda t: NOT list_contains(x_{w}, t)) AS oy_{w}" for w in 'na')}
        FROM (SELECT *, {', '.join(f"list_distinct({_tokens('s' + w)}) AS x_{w}, list_distinct({_tokens('t' + w)}) AS y_{w}" for w in 'na')}, array_to_string(list_sort({_tokens('sa')}), ' ') AS sas, array_to_string(list_sort({_tokens('ta')}), ' ') AS tas FROM texts))))))"""

SQL: dict[str, str] = {
    "records": _with(RECORDS_SQL, "SELECT * FROM records"),
    "truth_links": _with(f"{RECORDS_SQL},{TRUTH_SQL}", "SELECT * FROM truth"),
    "normalize_records": _with(NORMALIZED_SQL, f"SELECT entity_id, clean_name, core_name, clean_addr, array_to_string(list_sort(numbers), ',') AS numbers, sorted_name, array_to_string(list_sort({_tokens('clean_addr')}), ' ') AS sorted_addr FROM normalized"),
    "normalize_urls": f"SELECT page_id, {_clean('url')} AS clean_name FROM pages",
    "normalize_names": f"SELECT 'customer' AS kind, c_custkey AS id, {_clean('c_name')} AS clean_name FROM customer UNION ALL SELECT 'supplier', s_suppkey, {_clean('s_name')} FROM supplier UNION ALL SELECT 'part', p_partkey, {_clean('p_name')} FROM part",
    "char_ngrams": _with(NORMALIZED_SQL, f"SELECT entity_id, array_to_string(list_sort({_grams('core_name')}), '|') AS grams FROM normalized"),
    "countries": _with(RECORDS_SQL, "SELECT DISTINCT country FROM records WHERE country <> ''"),
    "last_of_each": "SELECT o_custkey AS entity_id, arg_max(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderkey) AS ordinal FROM orders GROUP BY o_custkey",
    "blocking_keys": _with(KEYS_SQL, "SELECT country, key_type, key_value, entity_id FROM keys"),
    "postings": _with(KEYS_SQL, "SELECT * FROM posted"),
    "capped_keys": _with(KEYS_SQL, "SELECT * FROM capped"),
    "shared_keys": _with(PAIRS_SQL, "SELECT * FROM paired"),
    "candidates": _with(CANDIDATES_SQL, "SELECT * FROM candidates"),
    "native_features": _with(FEATURES_SQL, "SELECT s1_id, target_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in features.NATIVE) + " FROM features"),
    "fuzzy_features": _with(FUZZY_SQL, "SELECT s1_id, target_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in ("name_token_sort", "addr_token_sort", "name_token_set", "cross_prod", "cross_sum", "cross_max", "cross_min")) + " FROM fuzzy"),
    "all_features": _with(FUZZY_SQL, "SELECT s1_id, target_id, " + ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in features.NAMES) + " FROM fuzzy JOIN features USING (s1_id, target_id)"),
    "scored_pairs": _with(FEATURES_SQL, "SELECT s1_id, target_id, round(p, 6) AS p FROM scored"),
    "exclusive_links": _with(FEATURES_SQL, "SELECT s1_id, target_id, round(p, 6) AS p FROM links"),
    "matched_lists": _with(FEATURES_SQL, "SELECT s.s1_id, COALESCE(string_agg(target_id, ',' ORDER BY target_id), '') AS ids FROM spine s LEFT JOIN links USING (s1_id) GROUP BY s.s1_id"),
    "entity_scores": _with(_ALL, f"SELECT s1_id, n_true, n_pred, tp, round({_f05('tp', 'n_true', 'n_pred')}, 6) AS f05, round(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (n_true + n_pred) END, 6) AS f1 FROM ({_counts('links')})"),
    "metrics": _with(_ALL, _metrics(_counts("links"))),
    "metrics_by_country": _with(_ALL, _metrics(_counts("links"), "country, ")),
    "source_report": _with(_ALL, f"{_SOURCE('S2-')} UNION ALL {_SOURCE('S3-')}"),
    "link_metrics": _with(_ALL, """SELECT source, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall
FROM (SELECT left(COALESCE(t.target_id, l.target_id), 2) AS source, count(CASE WHEN t.target_id IS NOT NULL AND l.target_id IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN t.target_id IS NULL THEN 1 END) AS fp, count(CASE WHEN l.target_id IS NULL THEN 1 END) AS fn
  FROM truth t FULL JOIN links l ON t.s1_id = l.s1_id AND t.target_id = l.target_id GROUP BY 1)"""),
    "candidate_recall": _with(_RANKED, "SELECT source, country, count(*) AS links, " + ", ".join(f"count(CASE WHEN rank <= {k} THEN 1 END) AS hit_{k}" for k in evaluate.CUTOFFS) + ", count(rank) AS hit_all, " + ", ".join(f"round(count(CASE WHEN rank <= {k} THEN 1 END) / count(*), 6) AS recall_{k}" for k in evaluate.CUTOFFS) + ", round(count(rank) / count(*), 6) AS recall_all FROM (SELECT t.*, c.rank, s.country, left(t.target_id, 2) AS source FROM truth t JOIN spine s USING (s1_id) LEFT JOIN candidates c ON c.s1_id = t.s1_id AND c.target_id = t.target_id) GROUP BY GROUPING SETS ((), (source), (country), (country, source))"),
    "candidate_histogram": _with(_RANKED, f"SELECT bucket, count(n) AS entities FROM (VALUES ('0', 0, 0), ('1', 1, 1), ('2-5', 2, 5), ('6-20', 6, 20), ('21-50', 21, 50), ('>50', 51, 1000000000)) b(bucket, low, high) LEFT JOIN ({_PER}) ON n BETWEEN low AND high GROUP BY bucket"),
    "candidate_statistics": _with(f"{_RANKED}, per AS ({_PER})", "SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS mean, max(n) AS largest, count(CASE WHEN n = 0 THEN 1 END) AS without, round(median(n), 6) AS median, round(quantile_cont(n, 0.95), 6) AS interpolated_p95, " + ", ".join(f"list_sort(list(n))[CAST(round_even((count(*) - 1) * {q}, 0) AS BIGINT) + 1] AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM per"),
    "restricted_oracle": _with(f"{_RANKED}, oracle AS (SELECT t.* FROM truth t JOIN candidates USING (s1_id, target_id))", f"SELECT *, CASE WHEN macro_f05 < 0.985 THEN 'A' WHEN macro_f05 < 0.995 THEN 'B' ELSE 'C' END AS recommendation FROM ({_metrics(_counts('oracle'))})"),
    "error_decomposition": _with(_ALL, """SELECT b.kind, b.category, count(e.kind) AS links FROM (VALUES ('fn', 'not_retrieved'), ('fn', 'below_threshold'), ('fn', 'lost_by_uniqueness'), ('fp', 'near_tie'), ('fp', 'non_ambiguous'), ('fp', 'other')) b(kind, category) LEFT JOIN (
  SELECT 'fn' AS kind, CASE WHEN s.p IS NULL THEN 'not_retrieved' WHEN a.p IS NULL THEN 'below_threshold' ELSE 'lost_by_uniqueness' END AS category
  FROM truth t LEFT JOIN scored s ON s.s1_id = t.s1_id AND s.target_id = t.target_id LEFT JOIN accepted a ON a.s1_id = t.s1_id AND a.target_id = t.target_id ANTI JOIN links l ON l.s1_id = t.s1_id AND l.target_id = t.target_id
  UNION ALL SELECT 'fp', CASE WHEN g.top[1] - g.top[2] <= 0.05 THEN 'near_tie' ELSE 'non_ambiguous' END FROM links l JOIN (SELECT target_id, list_reverse_sort(list(p)) AS top FROM accepted GROUP BY 1) g USING (target_id) ANTI JOIN truth t ON l.s1_id = t.s1_id AND l.target_id = t.target_id
) e ON e.kind = b.kind AND e.category = b.category GROUP BY ALL"""),
    "source_threshold_grid": _with(_ALL, f"""SELECT t2, t3, round(avg({_f05('tp', 'n_true', 'n_pred')}), 6) AS macro_f05 FROM (
  SELECT t2, t3, s.s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = s.s1_id) AS n_true, count(p) AS n_pred, count(CASE WHEN p IS NOT NULL AND hit THEN 1 END) AS tp
  FROM spine s CROSS JOIN (SELECT unnest({list(decide.SOURCE_GRID)})::DOUBLE AS t2) CROSS JOIN (SELECT unnest({list(decide.SOURCE_GRID)})::DOUBLE AS t3)
  LEFT JOIN (SELECT c.s1_id, c.target_id, p, t.s1_id IS NOT NULL AS hit FROM scored c LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.target_id = c.target_id) x ON x.s1_id = s.s1_id AND p >= CASE WHEN starts_with(target_id, 'S2-') THEN t2 ELSE t3 END GROUP BY ALL) GROUP BY t2, t3"""),
    "global_threshold_grid": _with(_ALL, f"""SELECT threshold, round(avg({_f05('tp', 'n_true', 'n_pred')}), 6) AS macro_f05 FROM (
  SELECT threshold, s.s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = s.s1_id) AS n_true, count(p) AS n_pred, count(CASE WHEN p IS NOT NULL AND hit THEN 1 END) AS tp
  FROM spine s CROSS JOIN (SELECT unnest({list(decide.GLOBAL_GRID)})::DOUBLE AS threshold)
  LEFT JOIN (SELECT c.s1_id, c.target_id, p, t.s1_id IS NOT NULL AS hit FROM scored c LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.target_id = c.target_id) x ON x.s1_id = s.s1_id AND p >= threshold GROUP BY ALL) GROUP BY threshold"""),
    "training_pairs": _with(_RANKED, """SELECT t.s1_id, t.target_id, COALESCE(c.shared_keys, 1) AS shared_keys, 1 AS label FROM truth t LEFT JOIN candidates c USING (s1_id, target_id)
UNION ALL SELECT s1_id, target_id, shared_keys, 0 FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.s1_id ORDER BY rank) AS k, COALESCE(n, 0) AS n FROM candidates c LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) USING (s1_id) ANTI JOIN truth t ON t.s1_id = c.s1_id AND t.target_id = c.target_id) WHERE k <= greatest(2, 2 * n)"""),
    "reduced_pool": _with(f"{RECORDS_SQL},{TRUTH_SQL}", """SELECT entity_id, source, ordinal FROM records WHERE source <> 'S1' AND entity_id IN (SELECT target_id FROM truth)
UNION ALL SELECT entity_id, source, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ordinal) AS k FROM records WHERE source <> 'S1' AND entity_id NOT IN (SELECT target_id FROM truth)) WHERE k <= 50000"""),
    "candidate_hashes": _with(CANDIDATES_SQL, "SELECT s1_id, sha256(string_agg(s1_id || '|' || target_id || '|' || rank || '|' || shared_keys || chr(10), '' ORDER BY rank)) AS hash FROM candidates GROUP BY s1_id"),
    "density": _with(RECORDS_SQL, "SELECT source, country, count(*) AS records, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS percent FROM records GROUP BY source, country"),
    "blocking_study": _with(f"""{_RANKED}, free AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared_keys DESC, target_id) AS rank FROM (
  SELECT s.entity_id AS s1_id, t.entity_id AS target_id, count(*) AS shared_keys FROM keys s JOIN keys t USING (country, key_type, key_value) WHERE s.source = 'S1' AND t.source <> 'S1' GROUP BY ALL)),
  held AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared_keys DESC, target_id) AS rank FROM paired)""", "SELECT count(*) AS links, count(rank) AS hit_all, count(CASE WHEN rank <= 20 THEN 1 END) AS hit_20, count(CASE WHEN rank <= 50 THEN 1 END) AS hit_50, true AS caps FROM truth LEFT JOIN held USING (s1_id, target_id) UNION ALL SELECT count(*), count(rank), count(CASE WHEN rank <= 20 THEN 1 END), count(CASE WHEN rank <= 50 THEN 1 END), false FROM truth LEFT JOIN free USING (s1_id, target_id)"),
    "blocking_study_by_source": _with(f"""{KEYS_SQL},{TRUTH_SQL},
by_source AS (SELECT source, country, key_type, key_value, count(*) <= CASE WHEN key_type IN ('sort_n', 'addr_pair') THEN {CONFIG.rare_limit} ELSE {CONFIG.common_limit} END AS within FROM keys WHERE source <> 'S1' GROUP BY source, country, key_type, key_value),
free AS (SELECT s.entity_id AS s1_id, t.entity_id AS target_id, t.source, count(*) AS every, count(CASE WHEN within THEN 1 END) AS held FROM keys s JOIN keys t USING (country, key_type, key_value)
  JOIN by_source b ON b.source = t.source AND b.country = t.country AND b.key_type = t.key_type AND b.key_value = t.key_value WHERE s.source = 'S1' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY every DESC, target_id) AS r0, row_number() OVER (PARTITION BY s1_id, source ORDER BY held DESC, target_id) AS r1 FROM free),
both_caps AS (SELECT s1_id, target_id, false AS caps, r0 AS rank FROM ranked UNION ALL SELECT s1_id, target_id, true, r1 FROM ranked WHERE held > 0)""", """SELECT left(t.target_id, 2) AS source, c.caps, count(*) AS links, count(rank) AS hit_all, count(CASE WHEN rank <= 20 THEN 1 END) AS hit_20, count(CASE WHEN rank <= 50 THEN 1 END) AS hit_50
FROM truth t CROSS JOIN (VALUES (true), (false)) c(caps) LEFT JOIN both_caps b ON b.s1_id = t.s1_id AND b.target_id = t.target_id AND b.caps = c.caps GROUP BY ALL"""),
    "candidates_by_source": _with(f"""{KEYS_SQL},
by_source AS (SELECT source, country, key_type, key_value FROM keys WHERE source <> 'S1' GROUP BY ALL HAVING count(*) <= CASE WHEN key_type IN ('sort_n', 'addr_pair') THEN {CONFIG.rare_limit} ELSE {CONFIG.common_limit} END),
pairs AS (SELECT s.entity_id AS s1_id, t.entity_id AS target_id, t.source, count(*) AS shared_keys FROM keys s JOIN keys t USING (country, key_type, key_value) JOIN by_source b ON b.source = t.source AND b.country = t.country AND b.key_type = t.key_type AND b.key_value = t.key_value
  WHERE s.source = 'S1' GROUP BY ALL)""", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id, source ORDER BY shared_keys DESC, target_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= {CONFIG.top_k}"),
    "candidates_across_countries": _with(_ACROSS, "SELECT * FROM candidates"),
    "target_universe": _with(CANDIDATES_SQL, "SELECT left(target_id, 2) AS source, count(*) AS pairs, count(DISTINCT target_id) AS targets FROM candidates GROUP BY 1"),
    "retrieval_categories": _with(f"{_ACROSS},{TRUTH_SQL}", "SELECT CASE WHEN rank <= 20 THEN 'within_k' WHEN rank IS NOT NULL THEN 'retrieved' ELSE 'not_retrieved' END AS category, count(*) AS links FROM truth LEFT JOIN candidates USING (s1_id, target_id) GROUP BY 1"),
    "link_summary": _with(_ALL, "SELECT count(*) AS entities, count(CASE WHEN n = 0 THEN 1 END) AS singletons, count(CASE WHEN n > 0 THEN 1 END) AS matched, CAST(sum(n2) AS BIGINT) AS s2_links, CAST(sum(n) - sum(n2) AS BIGINT) AS s3_links FROM (SELECT s.s1_id, count(target_id) AS n, count(CASE WHEN starts_with(target_id, 'S2-') THEN 1 END) AS n2 FROM spine s LEFT JOIN links USING (s1_id) GROUP BY 1)"),
    "outside_candidates": _with(_RANKED, "SELECT DISTINCT s1_id FROM truth t ANTI JOIN candidates c USING (s1_id, target_id)"),
    "select_and_exclude": _with(f"{RECORDS_SQL},{TRUTH_SQL}", "SELECT entity_id, CASE WHEN entity_id IN (SELECT target_id FROM truth) THEN 'selected' ELSE 'excluded' END AS kind FROM records WHERE source <> 'S1'"),
    "rule_offenders": _with(f"""{RECORDS_SQL},{TRUTH_SQL}, spine AS (SELECT entity_id AS s1_id, ordinal AS n FROM records WHERE source = 'S1'),
  lists AS (SELECT s1_id, n, COALESCE(list(target_id) FILTER (target_id IS NOT NULL), []) AS ids FROM spine LEFT JOIN truth USING (s1_id) GROUP BY ALL),
  rows AS (SELECT s1_id, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN ['S1-1', 'S4-2'] WHEN n % 17 = 0 THEN ['S2-1', 'S2-1'] ELSE ids END AS ids FROM lists WHERE n % 19 > 0
    UNION ALL SELECT s1_id || 'x', ['S2-0'] FROM lists, (VALUES (1), (2)) WHERE n % 23 = 0),
  listed AS (SELECT DISTINCT unnest(ids) AS id FROM rows),
  found AS (SELECT 'malformed_row' AS rule, s1_id AS offender FROM rows WHERE ids IS NULL
    UNION SELECT 'duplicate_s1', s1_id FROM rows WHERE ids IS NOT NULL GROUP BY s1_id HAVING count(*) > 1
    UNION SELECT 'repeated_id', s1_id FROM rows WHERE len(ids) <> len(list_distinct(ids))
    UNION SELECT 'self_match', id FROM listed WHERE starts_with(id, 'S1-')
    UNION SELECT 'wrong_prefix', id FROM listed WHERE NOT regexp_matches(id, '^S[123]-')
    UNION SELECT 'unknown_id', id FROM listed WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM records WHERE source <> 'S1')
    UNION SELECT 'missing_s1', s1_id FROM spine WHERE s1_id NOT IN (SELECT s1_id FROM rows WHERE ids IS NOT NULL)
    UNION SELECT 'unexpected_s1', s1_id FROM rows WHERE ids IS NOT NULL AND s1_id NOT IN (SELECT s1_id FROM spine))""", "SELECT rule, count(*) AS offenders, array_to_string(list_sort(list(offender))[1:5], ',') AS examples FROM found GROUP BY rule"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to links in one plan."""
    return linkage.link(doc_records(spark, sf_dir), config=CONFIG).select("s1_id", F.array_join("matched_ids", ",").alias("matched_ids"))
