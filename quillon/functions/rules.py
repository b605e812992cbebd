"""Vocabularies of the normalisation rules, and column literals made from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists being exactly as they are.
LEGAL_FORMS = {
    "us": ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "llp", "lp", "pllc", "pc"),
    "india": ("pvt", "private", "ltd", "limited", "llp", "opc", "co", "company", "corp", "corporation", "inc"),
    "france": ("sarl", "sas", "sasu", "eurl", "sci", "sa", "snc", "scop", "selarl", "ltd", "inc", "llc"),
}
CONNECTORS = {"us": ("and",), "india": ("and",), "france": ("et",)}
WEB_TOKENS = ("www", "com", "net", "org")
PLACEHOLDERS = ("null", "n/a", "na", "n.a.", "nan", "none", "nil", "unknown", "-", "--", ".")
SCRIPTS = ("Latin", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic")
LEET_FROM, LEET_TO = "01568", "olsgb"
STREET_TYPES = (
    "rue", "r", "avenue", "av", "ave", "bd", "boulevard", "blvd", "cours", "crs", "allee", "all", "quai", "q", "impasse", "imp",
    "place", "pl", "chemin", "ch", "che", "passage", "pass", "square", "sq", "route", "rte", "voie", "residence", "res",
    "lotissement", "lot", "faubourg", "fbg", "cite", "esplanade", "promenade", "parvis", "rond", "point", "sentier", "hameau",
    "zone", "za", "zi",
    "road", "rd", "street", "st", "str", "lane", "ln", "drive", "dr", "court", "ct", "circle", "cir", "way", "parkway", "pkwy",
    "highway", "hwy", "terrace", "ter", "trail", "trl", "plaza", "plz", "alley", "aly", "loop", "path", "pike", "run", "row",
    "walk", "crescent", "cres", "close", "unit", "suite", "ste", "apt", "no", "n", "hno", "sno", "h", "house", "plot", "p",
    "floor", "shop", "bis", "po", "box", "door", "flat", "building", "bldg",
    "marg", "nagar", "main", "cross", "colony", "sector", "block", "phase", "layout", "near", "opp",
)
PARTICLES = ("de", "du", "des", "la", "le", "les", "l", "d", "of", "the", "a", "b", "c", "et", "and")


def literal(values: Iterable[str]) -> Column:
    """The distinct values as an array literal."""
    return F.array(*map(F.lit, dict.fromkeys(values)))


def _by_country(table: dict[str, tuple[str, ...]], country: Column, extra: tuple[str, ...] = ()) -> Column:
    """The list of the record's country; an unknown country has all of them."""
    out = literal([*(v for own in table.values() for v in own), *extra])
    for name, values in table.items():
        out = F.when(country == name, literal(values + extra)).otherwise(out)
    return out


def legal_forms(country: Column) -> Column:
    return _by_country(LEGAL_FORMS, country)


def noise_tokens(country: Column) -> Column:
    """Legal forms, connectors and web tokens."""
    return _by_country({k: v + CONNECTORS[k] for k, v in LEGAL_FORMS.items()}, country, WEB_TOKENS)
