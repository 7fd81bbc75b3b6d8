"""The 32 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.similarity import fuzzy, jaccard, levenshtein_similarity, overlap
from kinmatch.functions.text import char_ngrams, tokens

# --- fixed values: names and order of the features ---
NAMES = """
name_exact_clean name_exact_core name_lev_sim name_jw_sim name_token_sort name_token_set name_token_jaccard name_token_overlap
name_len_diff name_len_ratio name_prefix_match name_char_3gram name_first_token_match name_first_token_conflict
addr_has_val addr_exact_clean addr_lev_sim addr_jw_sim addr_token_sort addr_token_set addr_token_jaccard
num_common_count num_has_match num_has_mismatch exact_core_no_addr cross_prod cross_sum cross_max cross_min
is_source2 is_source3 shared_keys_count
""".split()
#: Features that need the Arrow kernel.
FUZZY = ("name_jw_sim", "name_token_sort", "name_token_set", "addr_jw_sim", "addr_token_sort", "addr_token_set", "cross_prod", "cross_sum", "cross_max", "cross_min")
NATIVE = [n for n in NAMES if n not in FUZZY]
TEXTS = ("clean_name", "core_name", "clean_addr", "sorted_name", "sorted_addr", "numbers")


def with_texts(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate ids meet their normalized texts only now, after the top k."""
    side = lambda frame, key, mark: frame.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in TEXTS])
    return pairs.join(side(s1, "s1_id", "s"), "s1_id").join(side(targets, "target_id", "t"), "target_id")


def _flag(test: Column) -> Column:
    return test.cast("double")


def native_features(pairs: DataFrame) -> DataFrame:
    """The features that Catalyst expresses, added to pairs with texts."""
    s, t = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"t_{c}"))
    zero = F.lit(0.0)
    sized = pairs.withColumns({"_sn": F.array_distinct(tokens(s("core_name"))), "_tn": F.array_distinct(tokens(t("core_name"))), "_sa": F.array_distinct(tokens(s("clean_addr"))), "_ta": F.array_distinct(tokens(t("clean_addr"))), "_sg": char_ngrams(s("core_name")), "_tg": char_ngrams(t("core_name"))})
    # what several features or branches read is a column, or it would be computed for each
    sized = sized.withColumns({"_both_addr": (s("clean_addr") != "") & (t("clean_addr") != ""), "_ls": F.length(s("clean_name")), "_lt": F.length(t("clean_name"))})
    sized = sized.withColumns({f"_{c}": F.size(F.array_intersect(f"_s{c}", f"_t{c}")) for c in "nag"})
    sized = sized.withColumns({"_first": levenshtein_similarity(F.coalesce(F.get("_sn", 0), F.lit("")), F.coalesce(F.get("_tn", 0), F.lit(""))), "_common": F.size(F.array_intersect(s("numbers"), t("numbers")))})
    both_addr = F.col("_both_addr")
    addr = lambda value: F.when(both_addr, value).otherwise(zero)
    first, common = F.col("_first"), F.col("_common")
    named = (F.size("_sn") > 0) & (F.size("_tn") > 0)
    core = (s("core_name") == t("core_name")) & (s("core_name") != "")
    out = {
        "name_exact_clean": _flag((s("clean_name") == t("clean_name")) & (s("clean_name") != "")),
        "name_exact_core": _flag(core),
        "name_lev_sim": levenshtein_similarity(s("clean_name"), t("clean_name")),
        "name_token_jaccard": jaccard(F.col("_sn"), F.col("_tn"), F.col("_n")),
        "name_token_overlap": overlap(F.col("_sn"), F.col("_tn"), F.col("_n")),
        "name_len_diff": F.abs(F.col("_ls") - F.col("_lt")).cast("double"),
        "name_len_ratio": F.when(F.greatest("_ls", "_lt") > 0, F.least("_ls", "_lt") / F.greatest("_ls", "_lt")).otherwise(zero),
        "name_prefix_match": _flag((F.length(s("core_name")) >= 4) & (F.length(t("core_name")) >= 4) & (F.substring(s("core_name"), 1, 4) == F.substring(t("core_name"), 1, 4))),
        "name_char_3gram": jaccard(F.col("_sg"), F.col("_tg"), F.col("_g")),
        "name_first_token_match": _flag(named & (first >= 0.8)),
        "name_first_token_conflict": _flag(named & (first < 0.5)),
        "addr_has_val": _flag(t("clean_addr") != ""),
        "addr_exact_clean": addr(_flag(s("clean_addr") == t("clean_addr"))),
        "addr_lev_sim": addr(levenshtein_similarity(s("clean_addr"), t("clean_addr"))),
        "addr_token_jaccard": addr(jaccard(F.col("_sa"), F.col("_ta"), F.col("_a"))),
        "num_common_count": addr(common.cast("double")),
        "num_has_match": addr(_flag(common > 0)),
        "num_has_mismatch": addr(_flag((F.size(s("numbers")) > 0) & (F.size(t("numbers")) > 0) & (common == 0))),
        "exact_core_no_addr": _flag(core & (t("clean_addr") == "")),
        "is_source2": _flag(F.col("target_id").startswith("S2-")),
        "is_source3": _flag(F.col("target_id").startswith("S3-")),
        "shared_keys_count": F.col("shared_keys").cast("double"),
    }
    return sized.withColumns(out).drop("_sn", "_tn", "_sa", "_ta", "_sg", "_tg", "_n", "_a", "_g", "_first", "_common", "_ls", "_lt")


def fuzzy_features(pairs: DataFrame) -> DataFrame:
    """The kernel's features and those crossed from them; pairs have texts and the address guard."""
    run = pairs.withColumns({"_n": fuzzy("s_clean_name", "t_clean_name", "s_sorted_name", "t_sorted_name"), "_a": fuzzy("s_clean_addr", "t_clean_addr", "s_sorted_addr", "t_sorted_addr")})
    out = {f"name_{k}": F.col(f"_n.{v}") for k, v in (("jw_sim", "jw"), ("token_sort", "token_sort"), ("token_set", "token_set"))}
    out |= {f"addr_{k}": F.when(F.col("_both_addr"), F.col(f"_a.{v}")).otherwise(0.0) for k, v in (("jw_sim", "jw"), ("token_sort", "token_sort"), ("token_set", "token_set"))}
    run = run.withColumns(out)
    other = F.when(F.col("t_clean_addr") != "", F.col("addr_token_sort")).otherwise(F.col("name_token_sort"))
    name = F.col("name_token_sort")
    return run.withColumns({"cross_prod": name * other, "cross_sum": name + other, "cross_max": F.greatest(name, other), "cross_min": F.least(name, other)}).drop("_n", "_a")


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1_id, target_id, shared_keys, rank, 32 features)."""
    return fuzzy_features(native_features(with_texts(pairs, s1, targets))).select("s1_id", "target_id", "shared_keys", "rank", *NAMES)


def check_schema(columns: list[str]) -> None:
    """The model's inputs are exactly the features, in order."""
    if list(columns) != NAMES:
        raise ValueError(f"expected the {len(NAMES)} features in their order, got {columns}")
