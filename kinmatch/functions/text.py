"""Text, name and address normalization as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.tables import LEGAL_SUFFIXES, expansions

# --- fixed values: patterns of what goes from names and addresses, and of numbers ---
URL, DOMAIN = r"https?://(?:www\.)?", r"\.(com|org|net|in|co|io|fr)\b"
OTHER, BLANKS = r"[^a-zA-Z0-9\s]", r"\s+"
DIGITS = "^[0-9]+$"

# --- fixed values: ASCII for characters that don't decompose into ASCII and a mark ---
SPECIAL = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "«": "<<", "»": ">>", " ": " ",
    "€": "EUR", "£": "PS", "¥": "Y=", "¢": "C/", "©": "(c)", "®": "(r)", "™": "(tm)", "§": "SS", "¶": "P", "°": "deg", "µ": "u", "×": "x", "÷": "/", "±": "+-",
    "½": "1/2", "¼": "1/4", "¾": "3/4", "²": "2", "³": "3", "¹": "1", "ª": "a", "º": "o",
}


def ascii_of(character: str) -> str | None:
    """ASCII for one character by its decomposition, or None."""
    if character in SPECIAL:
        return SPECIAL[character]
    plain = "".join(c for c in unicodedata.normalize("NFKD", character) if ord(c) < 128)
    return plain or None


def latin_table() -> dict[str, str]:
    """Latin letters with marks and common punctuation, by rule."""
    ranges = (range(0x80, 0x250), range(0x1E00, 0x1F00), range(0x2000, 0x2070))
    return {chr(p): a for r in ranges for p in r if (a := ascii_of(chr(p))) is not None} | SPECIAL


def observed_table(frame: DataFrame, *columns: str) -> dict[str, str]:
    """A table for the characters that occur (their number is bounded by Unicode): decomposition, then ICU's romanization."""
    spark = frame.sparkSession
    text = F.regexp_replace(F.concat_ws("", *columns), r"[\x00-\x7f]", "")
    found = [r.c for r in frame.where(text != "").select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").distinct().collect()]
    return {c: a for c in found if (a := ascii_of(c)) is not None} | romanized(spark, [c for c in found if ascii_of(c) is None])


def romanized(spark: SparkSession, characters: Iterable[str]) -> dict[str, str]:
    """By the ICU library that comes with Spark; characters it leaves alone are left out."""
    characters = list(characters)
    if not characters:
        return {}
    icu = spark._jvm.com.ibm.icu.text.Transliterator
    rules = icu.getInstance("Any-Latin; Latin-ASCII")
    got = {c: rules.transliterate(c) for c in characters}
    return {c: a for c, a in got.items() if a.isascii()}


def transliterate(c: Column, table: dict[str, str] | None = None) -> Column:
    """ASCII for every character that the table knows; the others go. ASCII text passes untouched.

    The usual letters are replaced by native functions. A table of one's own may have thousands of characters, more than a plan can
    nest; it goes to an Arrow function, which only text beyond ASCII enters.
    """
    beyond = c.rlike(r"[^\x00-\x7f]")
    if table is not None:
        own = {ord(k): v for k, v in table.items()}

        @F.pandas_udf("string")
        def replaced(text: pd.Series) -> pd.Series:
            return text.map(lambda t: None if t is None else t.translate(own))

        return F.when(beyond, F.regexp_replace(replaced(F.when(beyond, c)), r"[^\x00-\x7f]", "")).otherwise(c)
    known = latin_table()
    single = {k: v for k, v in known.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in known.items():
        if k not in single:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(beyond, F.regexp_replace(out, r"[^\x00-\x7f]", "")).otherwise(c)


def clean(c: Column, table: dict[str, str] | None = None) -> Column:
    """Null and the whole text 'null' are empty; ASCII, lower case, no URL scheme, domain ending or punctuation, single blanks."""
    out = F.when(c.isNull() | (c == "null"), F.lit("")).otherwise(c)
    out = F.regexp_replace(F.lower(transliterate(out, table)), URL, "")
    out = F.regexp_replace(F.regexp_replace(out, DOMAIN, " "), OTHER, " ")
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def core_tokens(name_tokens: Column) -> Column:
    """Without legal suffixes, unless nothing else is there."""
    core = F.filter(name_tokens, lambda t: ~t.isin(LEGAL_SUFFIXES))
    return F.when(F.size(core) == 0, name_tokens).otherwise(core)


def expand_address(address_tokens: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in sorted(expansions().items()) for x in pair])
    return F.transform(address_tokens, lambda t: F.coalesce(F.element_at(known, t), t))


def numbers(address_tokens: Column) -> Column:
    return F.array_distinct(F.filter(address_tokens, lambda t: t.rlike(DIGITS)))


def normalize(records: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """records (entity_id, business_name, business_address, country, ...) with clean_name, core_name, clean_addr, numbers.

    Each step is a projection of its own, so nothing is computed twice. The sorted forms of names and addresses are there too.
    """
    cleaned = records.withColumns({"clean_name": clean(F.col("business_name"), table), "_addr": clean(F.col("business_address"), table)})
    split = cleaned.withColumns({"_name": tokens(F.col("clean_name")), "_addr": tokens(F.col("_addr"))})
    done = split.withColumns({
        "core_name": F.array_join(core_tokens(F.col("_name")), " "),
        "clean_addr": F.array_join(expand_address(F.col("_addr")), " "),
        "numbers": numbers(F.col("_addr")),
        "sorted_name": F.array_join(F.array_sort("_name"), " "),
    })
    return done.withColumn("sorted_addr", F.array_join(F.array_sort(tokens(F.col("clean_addr"))), " ")).drop("_name", "_addr")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The distinct n-grams of a text; of a shorter one itself; of an empty one none."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(grams))
