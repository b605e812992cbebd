"""Text normalisation as column functions.

All of them take and give strings, null counting as ''. Only Unicode normal forms need Python: values in ASCII never
leave the JVM, the others go through a pandas UDF in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import rules

NON_WORD = r"[^\p{L}\p{N}\p{M}]+"
NUMBER = r"\p{Nd}+"
#: Zeros of the decimal digits of scripts other than ASCII, for turning them into ASCII digits.
_ZEROS = [c for c in range(0x80, 0x1FBFA) if unicodedata.decimal(chr(c), None) == 0]
_DIGITS = "".join(chr(z + d) for z in _ZEROS for d in range(10))


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _beyond_ascii(value: Column, plain: Column, udf) -> Column:
    ascii_ = ~value.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_, plain).otherwise(udf(F.when(~ascii_, value)))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    marks = re.compile("[̀-ͯ]")

    def one(v):
        if v is None:
            return None
        v = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", v).casefold())
        return unicodedata.normalize("NFC", marks.sub("", v))

    return s.map(one)


@F.pandas_udf(StringType())
def _bare(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        out = []
        for c in unicodedata.normalize("NFKD", v):
            if c.isascii():
                out.append(c)
            elif not unicodedata.combining(c):  # a letter's name ends with its sound, as in DEVANAGARI LETTER KA
                name = unicodedata.name(c, "")
                out.append(name.rpartition(" ")[2].lower() if " LETTER " in name or " SIGN " in name else "")
        return "".join(out)

    return s.map(one)


def nfkc(value: Column) -> Column:
    """Unicode NFKC."""
    value = as_text(value)
    return _beyond_ascii(value, value, _nfkc)


def fold_text(value: Column) -> Column:
    """NFKC, case folding, removal of the combining marks U+0300 to U+036F, NFC."""
    value = as_text(value)
    return _beyond_ascii(value, F.lower(value), _fold)


def street_fold(value: Column) -> Column:
    """Case folding and removal of every combining character."""
    value = as_text(value)
    return _beyond_ascii(value, F.lower(value), _bare)


def transliterated(value: Column) -> Column:
    """ASCII rendering of any script: accents are stripped, other letters are spelt by their Unicode names."""
    value = as_text(value)
    return F.lower(_beyond_ascii(value, value, _ascii))


def whitespace_normalize(value: Column) -> Column:
    return F.trim(F.regexp_replace(as_text(value), r"\s+", " "))


def punctuation_to_space(value: Column) -> Column:
    return F.regexp_replace(as_text(value), NON_WORD, " ")


def basic(value: Column) -> Column:
    """Folded words, one space between them."""
    return whitespace_normalize(punctuation_to_space(fold_text(value)))


def tokens(value: Column) -> Column:
    """Words of a normalised text; none of ''."""
    return F.filter(F.split(as_text(value), " "), lambda t: t != "")


def joined(values: Column) -> Column:
    return F.array_join(values, " ")


def compact(value: Column) -> Column:
    return F.replace(as_text(value), F.lit(" "), F.lit(""))


def fingerprint(value: Column) -> Column:
    """Distinct words in order of their code points."""
    return joined(F.array_sort(F.array_distinct(tokens(value))))


def drop_tokens(value: Column, drop: Column) -> Column:
    return joined(F.filter(tokens(value), lambda t: ~F.array_contains(drop, t)))


def keep_tokens(value: Column, keep: Column) -> Column:
    return joined(F.filter(tokens(value), lambda t: F.array_contains(keep, t)))


def country_key(value: Column) -> Column:
    return F.trim(fold_case(value))


def fold_case(value: Column) -> Column:
    return F.lower(F.regexp_replace(as_text(value), "ß", "ss"))


def content(value: Column, country: Column) -> Column:
    """Without legal forms, connectors and web tokens of the country; the whole text where nothing is left."""
    kept = drop_tokens(value, rules.noise_tokens(country))
    return F.when(kept == "", as_text(value)).otherwise(kept)


def content_fallback(value: Column, country: Column) -> Column:
    return (drop_tokens(value, rules.noise_tokens(country)) == "") & (as_text(value) != "")


def canonical_numbers(value: Column) -> Column:
    """Runs of digits of any script as ASCII numbers without leading zeros, in order."""
    runs = F.regexp_extract_all(as_text(value), F.lit(NUMBER), F.lit(0))
    return joined(F.transform(runs, lambda n: F.regexp_replace(F.translate(n, _DIGITS, "0123456789" * len(_ZEROS)), "^0+(?=.)", "")))


def script_counts(value: Column) -> Column:
    return F.array(*(F.regexp_count(as_text(value), F.lit(rf"\p{{Is{s}}}")) for s in rules.SCRIPTS))


def dominant_script(value: Column) -> Column:
    """The script with most letters (the first of equals), ``other`` or ``none``."""
    n = script_counts(value)
    names = rules.literal(rules.SCRIPTS)
    letters = as_text(value).rlike(r"\p{L}")
    return F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))).when(letters, "other").otherwise("none")


def script_mixed(value: Column) -> Column:
    return F.size(F.filter(script_counts(value), lambda n: n > 0)) >= 2


def without_placeholders(value: Column) -> Column:
    """Components between commas that only hold a placeholder are dropped."""
    return F.array_join(F.filter(F.split(as_text(value), ","), lambda p: ~F.array_contains(rules.literal(rules.PLACEHOLDERS), F.trim(p))), ",")


def has_placeholder(value: Column) -> Column:
    return F.exists(F.split(as_text(value), ","), lambda p: F.array_contains(rules.literal(rules.PLACEHOLDERS), F.trim(p)))


def deleet(value: Column) -> Column:
    """Digits that stand for letters, in words of four characters or more with both."""
    mixed = lambda t: (F.length(t) >= 4) & t.rlike(r"\p{Nd}") & t.rlike(r"\p{L}")
    return joined(F.transform(tokens(value), lambda t: F.when(mixed(t), F.translate(t, rules.LEET_FROM, rules.LEET_TO)).otherwise(t)))


def translated(value: Column, dictionary: Column) -> Column:
    """The words, then the translation (a map) of each that has one."""
    words = tokens(value)
    return joined(F.concat(words, F.filter(F.transform(words, lambda t: F.try_element_at(dictionary, t)), lambda t: t.isNotNull())))


def initials(value: Column) -> Column:
    """First characters of two words or more."""
    return F.when(F.size(tokens(value)) >= 2, F.array_join(F.transform(tokens(value), lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def legal_tokens(value: Column, country: Column) -> Column:
    return keep_tokens(value, rules.legal_forms(country))


def first_token(value: Column) -> Column:
    return F.coalesce(F.get(tokens(value), F.lit(0)), F.lit(""))


def long_numbers(value: Column, digits: int = 4) -> Column:
    return joined(F.filter(tokens(value), lambda t: F.length(t) >= digits))


def _words(part: Column) -> Column:
    return tokens(F.regexp_replace(part, "[^0-9a-z]+", " "))


def street_core(address: Column) -> Column:
    """Name of the street: of the first component between commas with a number, or else with a kind of street."""
    parts = F.transform(F.split(street_fold(address), ","), _words)
    numbered = F.get(F.filter(parts, lambda w: F.exists(w, lambda t: t.rlike("[0-9]"))), F.lit(0))
    kinds = rules.literal(rules.STREET_TYPES)
    typed = F.get(F.filter(parts, lambda w: F.arrays_overlap(w, kinds)), F.lit(0))
    drop = rules.literal(rules.STREET_TYPES + rules.PARTICLES)
    core = F.filter(F.coalesce(numbered, typed), lambda t: ~t.rlike("[0-9]") & ~F.array_contains(drop, t))
    return F.coalesce(joined(core), F.lit(""))


def first_number(address: Column) -> Column:
    """Leading digits of the first word that starts with one, without leading zeros."""
    n = F.regexp_extract(joined(_words(street_fold(address))), r"(?:^| )([0-9]+)", 1)
    return F.regexp_replace(n, "^0+(?=.)", "")


def dotted_legal(name: Column, country: Column) -> Column:
    """Legal forms, those written with dots too, sorted."""
    text = joined(_words(street_fold(name)))
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^ ])[0-9a-z](?: [0-9a-z])+(?![^ ])"), F.lit(0)), lambda r: F.replace(r, F.lit(" "), F.lit("")))
    forms = rules.legal_forms(country)
    long_words = F.filter(F.split(text, " "), lambda t: F.length(t) > 1)
    return joined(F.array_sort(F.array_distinct(F.filter(F.concat(long_words, runs), lambda t: F.array_contains(forms, t)))))


def skeleton(value: Column) -> Column:
    """Without vowels, repeated characters once."""
    return F.regexp_replace(F.translate(as_text(value), "aeiouy", ""), r"(.)\1+", "$1")


def char_ngrams(value: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is one itself, '' has none."""
    value = as_text(value)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - n + 1), lambda i: value.substr(i, F.lit(n))))
    return F.when(value == "", F.array().cast("array<string>")).when(F.length(value) < n, F.array(value)).otherwise(grams)


def name_views(df: DataFrame, name: str = "business_name", country: str = "country_key") -> DataFrame:
    """Adds the twelve views of a name. The folded text is made once, before what is built on it."""
    raw = as_text(F.col(name))
    df = df.withColumns({"name_raw": raw, "name_nfkc": whitespace_normalize(nfkc(F.col(name))), "name_basic": basic(F.col(name))})
    b, c = F.col("name_basic"), F.col(country)
    df = df.withColumns({
        "name_missing": b == "", "name_compact": compact(b), "name_fingerprint": fingerprint(b), "name_content": content(b, c),
        "name_content_fallback": content_fallback(b, c), "name_numbers": canonical_numbers(b), "name_script": dominant_script(b), "name_script_mixed": script_mixed(b),
    })
    return df.withColumn("name_content_compact", compact(F.col("name_content")))


def address_views(df: DataFrame, address: str = "business_address") -> DataFrame:
    """Adds the ten views of an address."""
    raw = as_text(F.col(address))
    df = df.withColumns({"address_raw": raw, "address_nfkc": whitespace_normalize(nfkc(F.col(address))), "__folded": whitespace_normalize(fold_text(F.col(address)))})
    df = df.withColumns({"address_placeholder_removed": has_placeholder(F.col("__folded")), "address_basic": whitespace_normalize(punctuation_to_space(without_placeholders(F.col("__folded"))))})
    b = F.col("address_basic")
    return df.withColumns({
        "address_missing": b == "", "address_compact": compact(b), "address_fingerprint": fingerprint(b), "address_numbers": canonical_numbers(b),
        "address_script": dominant_script(b), "address_script_mixed": script_mixed(b),
    }).drop("__folded")


def normalized(records: DataFrame) -> DataFrame:
    """entity_id, business_name, business_address, country: all views of every record."""
    keyed = records.withColumns({"country_raw": as_text(F.col("country")), "country_key": country_key(F.col("country"))})
    return address_views(name_views(keyed)).drop("business_name", "business_address", "country")


def normalized_record(spark: SparkSession, record: Mapping[str, str | None]) -> dict:
    """All views of one record (entity_id, business_name, business_address, country), as normalized() gives them."""
    names = ("entity_id", "business_name", "business_address", "country")
    row = spark.createDataFrame([tuple(record.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
    return normalized(row).first().asDict()


def street_views(df: DataFrame) -> DataFrame:
    """Adds street_core, street_number and legal_dotted to normalised records."""
    a = F.col("address_nfkc")
    return df.withColumns({"street_core": street_core(a), "street_number": first_number(a), "legal_dotted": dotted_legal(F.col("name_nfkc"), F.col("country_key"))})
