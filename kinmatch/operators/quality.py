"""Rules that result files must keep, each a query for its offenders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.sources.files import exists, first_line

S1_COLUMN = "source1_entity_id"
EXAMPLES = 5

#: Rule, and what it finds, in the order of the report.
RULES = {
    "malformed_row": "rows without a tab",
    "duplicate_s1": "S1 ids with more than one row",
    "repeated_id": "S1 ids whose list repeats an id",
    "self_match": "S1 ids in a list",
    "wrong_prefix": "ids without an S2- or S3- prefix",
    "unknown_id": "ids that aren't in the S2 or S3 files",
    "missing_s1": "required S1 ids without a row",
    "unexpected_s1": "rows of S1 ids that aren't required",
}


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return not self.errors

    def text(self) -> str:
        lines = [*(f"ERROR {e}" for e in self.errors), *(f"WARNING {w}" for w in self.warnings)]
        return "\n".join([*lines, "PASS" if self.passed else "FAIL"])


def result_rows(lines: DataFrame) -> DataFrame:
    """Text lines without the header to s1_id, ids (array), ordinal; lines without a tab have null ids, blank ones are left out."""
    value = F.col("value")
    rest = F.regexp_extract(value, r"(?s)^[^\t]*\t(.*)$", 1)
    ids = F.when(~value.contains("\t"), F.lit(None)).when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return lines.where((F.trim("value") != "") | value.contains("\t")).select(F.split(value, "\t")[0].alias("s1_id"), ids.alias("ids"), "ordinal")


def offenders(rows: DataFrame, required: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(rule, offender), each once. required: s1_id; known: target_id."""
    good = rows.where("ids is not null")
    listed = good.select("s1_id", F.explode("ids").alias("id")).distinct()
    prefixed = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    found = [
        rows.where("ids is null").select(F.lit("malformed_row").alias("rule"), F.col("s1_id").alias("offender")),
        good.groupBy("s1_id").count().where("count > 1").select(F.lit("duplicate_s1"), "s1_id"),
        good.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.lit("repeated_id"), "s1_id"),
        listed.where(F.col("id").startswith("S1-")).select(F.lit("self_match"), "id"),
        listed.where(~prefixed & ~F.col("id").startswith("S1-")).select(F.lit("wrong_prefix"), "id"),
    ]
    if known is not None:
        found.append(listed.where(prefixed).join(known.select(F.col("target_id").alias("id")), "id", "left_anti").select(F.lit("unknown_id"), "id"))
    if required is not None:
        found.append(required.select("s1_id").join(good.select("s1_id"), "s1_id", "left_anti").select(F.lit("missing_s1"), "s1_id"))
        found.append(good.select("s1_id").join(required.select("s1_id"), "s1_id", "left_anti").select(F.lit("unexpected_s1"), "s1_id"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def findings(offending: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """rule, offenders, examples (the first few in order)."""
    from pyspark.sql.window import Window as W

    ranked = offending.withColumn("k", F.row_number().over(W.partitionBy("rule").orderBy("offender")))
    counts = offending.groupBy("rule").agg(F.count("*").alias("offenders"))
    few = ranked.where(F.col("k") <= examples).groupBy("rule").agg(F.array_sort(F.collect_list("offender")).alias("examples"))
    return counts.join(few, "rule")


def outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """S1 ids with a matched id that isn't among their candidates (rows: s1_id, ids; the last row of an S1 counts)."""
    last = lambda rows: rows.where("ids is not null").groupBy("s1_id").agg(F.max_by("ids", "ordinal").alias("ids"))
    both = last(matched).join(last(candidates).withColumnRenamed("ids", "allowed"), "s1_id", "left")
    return both.where(F.size(F.array_except("ids", F.coalesce("allowed", F.array().cast("array<string>")))) > 0).select("s1_id")


def validate_file(spark: SparkSession, path: str, id_column: str, required: DataFrame, known: DataFrame | None, report: Report) -> DataFrame | None:
    """Adds what is wrong with one file to the report; its rows, or None if it can't be read as such a file."""
    if not exists(spark, path):
        report.errors.append(f"{path}: not found")
        return None
    header = first_line(spark, path)
    if header is None:
        report.errors.append(f"{path}: empty")
        return None
    if "\t" not in header and "," in header:
        report.errors.append(f"{path}: the header has commas and no tab; columns are separated by tabs")
        return None
    columns = [c.strip().lower() for c in header.split("\t")]
    if columns != [S1_COLUMN, id_column]:
        report.errors.append(f"{path}: header {columns}, expected {[S1_COLUMN, id_column]}")
        return None
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).where("ordinal > 0")
    if lines.where("not is_valid_utf8(value)").limit(1).count():
        report.errors.append(f"{path}: not UTF-8")
        return None
    rows = result_rows(lines)
    totals = rows.where("ids is not null").agg(F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empty")).first()
    report.counts[path] = {"rows": totals.rows, "empty": totals.empty, "filled": totals.rows - totals.empty}
    found = {r.rule: r for r in findings(offenders(rows, required, known)).collect()}  # a row per rule
    report.errors += [f"{path}: {found[r].offenders} {what}, such as {', '.join(found[r].examples)}" for r, what in RULES.items() if r in found]
    return rows


def validate(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, known: DataFrame | None = None) -> Report:
    """Both files. required: s1_id of every S1; known: target_id of all targets, or None to skip that rule."""
    report = Report()
    if known is None:
        report.warnings.append("whether ids exist isn't checked")
    matched = validate_file(spark, matching, "matched_entity_ids", required, known, report)
    if candidate and exists(spark, candidate):
        pairs = validate_file(spark, candidate, "candidate_entity_ids", required, known, report)
        if matched is not None and pairs is not None:
            n = outside_candidates(matched, pairs).count()
            if n:
                report.warnings.append(f"{n} S1 ids have matches that aren't among their candidates")
    elif candidate:
        report.warnings.append(f"{candidate}: not found, its rules are skipped")
    return report


def candidate_faults(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(fault, s1_id) of candidate rows: repeated targets, ranks that aren't 1 to n, S1 ids that weren't asked for."""
    per = candidates.groupBy("s1_id").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("d"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("r"))
    faults = [
        per.where("n <> d").select(F.lit("repeated_target").alias("fault"), "s1_id"),
        per.where("low <> 1 or high <> n or r <> n").select(F.lit("ranks"), "s1_id"),
        per.select("s1_id").join(expected.select("s1_id"), "s1_id", "left_anti").select(F.lit("unexpected"), "s1_id"),
    ]
    return faults[0].union(faults[1]).union(faults[2])


def link_faults(links: DataFrame, spine: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fault, s1_id) of links: S1 ids outside the spine, targets of another namespace, links that weren't candidates."""
    key = ["s1_id", "target_id"]
    named = F.col("target_id").startswith("S2-") | F.col("target_id").startswith("S3-")
    faults = [
        links.select("s1_id").join(spine.select("s1_id"), "s1_id", "left_anti").select(F.lit("unexpected").alias("fault"), "s1_id"),
        links.where(~named).select(F.lit("namespace"), "s1_id"),
        links.select(*key).join(candidates.select(*key), key, "left_anti").select(F.lit("not_a_candidate"), "s1_id"),
    ]
    return faults[0].union(faults[1]).union(faults[2]).distinct()
