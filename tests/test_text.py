import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx


@pytest.fixture(scope="module")
def views(spark):
    rows = [
        ("fullwidth", "ＡＢＣ Ltd", "", "us"), ("ligature", "ﬁne Foods", "", "us"), ("eszett", "Straße Cafe", "", ""), ("caps", "STRASSE CAFE", "", ""), ("composed", "Café Élan", "", "france"), ("decomposed", "Café Élan", "", "france"),
        ("devanagari", "आनंद", "", "india"), ("mixed", "आनंद Ventures", "", "india"), ("pvt", "ABC Pvt. Ltd.", "", "India "), ("acme", "ACME LTD", "", "us"), ("acme2000", "ACME 2000 LTD", "", "us"), ("fallback", "Company Limited", "", "us"),
        ("amp", "Keys & Co", "", "us"), ("and", "KEYS and CO", "", "us"), ("domain", "fortunefinance.com", "", "india"), ("plain", "Fortune Finance Pvt Ltd", "", "india"), ("order1", "Coastal Co Avalanche", "", "us"), ("order2", "Coastal Avalanche Co", "", "us"),
        ("sarl_fr", "Nantes Sport SARL", "", "france"), ("sarl_unknown", "Nantes Sport SARL", "", "xx"), ("sarl_us", "Nantes Sport SARL", "", "us"), ("na", "NA", "Na Road, Indore", "us"), ("dashes", "---", "NULL", "us"),
        ("placeholder", "x", "3800, NULL, CLEARFIELD, UT", "us"), ("zeros", "x", "00930 PARK CENTRAL DR", "us"), ("digits", "x", "मकान १२३, Delhi", "india"), ("hyphen", "x", "76, Cathedral Road, Madras-86.76", "india"), ("street", "x", "12 Main Street", "us"), ("nulls", None, None, None),
        ("padded", "  A  b ", " c ", None), ("tamil1", "கொ", "", "india"), ("tamil2", "கொ", "", "india"), ("allzero", "x", "000 Road", "us"),
    ]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return {r.entity_id: r for r in tx.street_views(tx.normalized(df)).collect()}


def test_names(views):
    v = lambda k, c="name_basic": views[k][c]
    assert v("fullwidth") == "abc ltd" and v("ligature") == "fine foods" and v("eszett") == v("caps")
    assert v("composed") == v("decomposed") == "cafe elan" and v("tamil1") == v("tamil2")
    assert v("devanagari") == "आनंद" and v("devanagari", "name_script") == "Devanagari" and v("mixed", "name_script_mixed")
    assert (v("pvt"), v("pvt", "name_content"), v("pvt", "name_compact")) == ("abc pvt ltd", "abc", "abcpvtltd")
    assert all(v("acme", c) != v("acme2000", c) for c in ("name_basic", "name_compact", "name_content", "name_fingerprint")) and v("acme2000", "name_numbers") == "2000"
    assert v("fallback", "name_content") == "company limited" and v("fallback", "name_content_fallback") and not v("pvt", "name_content_fallback")
    assert v("amp", "name_content") == v("and", "name_content") and v("domain", "name_content_compact") == v("plain", "name_content_compact")
    assert v("order1", "name_fingerprint") == v("order2", "name_fingerprint") and v("order1") != v("order2")
    assert [v(k, "name_content") for k in ("sarl_fr", "sarl_unknown", "sarl_us")] == ["nantes sport", "nantes sport", "nantes sport sarl"]
    assert v("na") == "na" and not v("na", "name_missing") and v("dashes", "name_missing")


def test_addresses(views):
    v = lambda k, c="address_basic": views[k][c]
    assert v("placeholder") == "3800 clearfield ut" and v("placeholder", "address_placeholder_removed") and v("dashes", "address_missing")
    assert v("na") == "na road indore" and v("zeros", "address_numbers") == "930" and v("digits", "address_numbers") == "123" and v("hyphen", "address_numbers") == "76 86 76"
    assert v("street") == "12 main street" and v("allzero", "address_numbers") == "0"
    assert views["nulls"].name_missing and views["nulls"].address_missing and views["nulls"].country_key == ""
    assert views["padded"].name_raw == "  A  b " and views["padded"].address_raw == " c "


def test_street_views(views):
    assert views["street"].street_core == "" and views["street"].street_number == "12"  # main and street are kinds of streets
    assert views["zeros"].street_core == "park central" and views["hyphen"].street_core == ""
    assert views["allzero"].street_number == "0" and views["sarl_fr"].legal_dotted == "sarl" and views["nulls"].street_core == ""


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(tx.deleet(lit("g00gle 123 ab1 m1cr0soft"))) == "google 123 ab1 mlcrosoft"
    assert one(tx.street_core(lit("12 Land and Sea Road"))) == "land sea" and one(tx.street_core(lit("3 rue de la Paix et du Lac"))) == "paix lac"
    assert one(tx.initials(lit("big blue sky"))) == "bbs" and one(tx.initials(lit("one"))) == ""
    assert one(tx.translated(lit("rue du lac"), F.create_map(lit("rue"), lit("street")))) == "rue du lac street"
    assert one(tx.dotted_legal(lit("Foo S.A.R.L. Ltd"), lit("france"))) == "ltd sarl"
    assert one(tx.skeleton(lit("bookkeeper"))) == "bkpr" and one(tx.transliterated(lit("Élan"))) == "elan"
    assert one(tx.char_ngrams(lit("ab"))) == ["ab"] and one(tx.char_ngrams(lit(""))) == [] and sorted(one(tx.char_ngrams(lit("aaaa")))) == ["aaa"]
    assert one(tx.canonical_numbers(lit("٠٠٧ and 12345678901234567890"))) == "7 12345678901234567890"
    assert one(tx.first_number(lit("apt b, 0012bis rue x"))) == "12"


def test_normalising_twice_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(tx.basic(F.col("text")).alias("b"))
    assert docs.where(F.col("b") != tx.basic(F.col("b"))).count() == 0


def test_one_record_has_the_views_of_the_table(spark):
    record = {"entity_id": "S2-1", "business_name": "Ünited Inc", "business_address": None, "country": " US "}
    got = tx.normalized_record(spark, record)
    assert got["name_content"] == "united" and got["address_missing"] and got["country_key"] == "us" and got["name_raw"] == "Ünited Inc"
