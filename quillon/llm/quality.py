"""Quality rules whose cutoffs come with a guarantee, by DataFrame functions alone.

Every rule compares a figure of the text, in thousandths, with a cutoff. Labelled documents of good quality are the
holdout: for each stratum (language), rule and cutoff of ``GRID`` the number that would be rejected is counted. A cutoff is
certified where the exact binomial test refutes a false rejection rate of ``RATE`` / number of rules:

    P(X <= rejected | good, RATE / rules) <= DELTA / (strata * rules)

The bound over strata and rules is Bonferroni's; the cutoffs of one rule are tested from the laxest on, and the first
that fails ends the sequence, which needs no further correction. With probability 1 - DELTA, so, no stratum loses more than
``RATE`` of its good documents to the rules. Of the certified cutoffs the one is used that rejects most labelled bad
documents, each good one lost counting ``COST`` times; without one the rule is off in that stratum.

Defined results: null texts have no words and fail the base. A null language is a stratum of its own. Label rows with a
null id or mark, or without a document, count nothing; repeated label rows count once. Rows that share an id are judged
each on its own. Other columns are ignored.
"""

from __future__ import annotations

from math import log, log1p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common

SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("symbols", "dup_lines", "repeats", "capitals")
GRID = (900, 700, 500, 400, 300, 250, 200, 150, 100, 75, 50)
RATE, DELTA, COST = 0.04, 0.05, 4
LEAST_WORDS, SPAN, MOST_REPEATED = 10, 5, 20


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every row."""
    text = F.coalesce("text", F.lit(""))
    length = F.length(text)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("(null)")).alias("stratum"), F.col("text"), common.words("text").alias("w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.SPACES.replace("[", "[^"))).alias("lines"))
    word = [lambda i, k=k: F.get(F.col("w"), i + k) for k in range(SPAN)]
    windows = F.when(F.size("w") >= SPAN, F.transform(F.sequence(F.lit(0), F.size("w") - SPAN), lambda i: F.xxhash64(*(f(i) for f in word)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "stratum", "w", F.size("w").cast("long").alias("n_words"), windows.alias("h"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.translate(text, BREAKS, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"),
    )
    # texts whose windows' hashes all differ have no window twice; for the others the words themselves are compared
    again = F.size(F.array_distinct("h")) < F.size("h")
    named = F.transform(F.sequence(F.lit(0), F.size("w") - SPAN), lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.lit(SPAN)), " ").alias("g"), i.alias("i")))
    rest = ("doc_id", "stratum", "n_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_capitals")
    rows = rows.select(*rest, F.when(again, F.array_sort(named)).alias("s"))
    at = lambda j: F.get(F.col("s"), j)["g"]
    twice = F.filter("s", lambda x, j: (x["g"].eqNullSafe(at(j - 1))) | (x["g"].eqNullSafe(at(j + 1))))
    rows = rows.select(*rest, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("m"))
    covered = F.transform("m", lambda x, j: F.least(F.lit(SPAN), F.coalesce(F.get(F.col("m"), j + 1) - x, F.lit(SPAN))).cast("long"))
    return rows.select(*rest, F.coalesce(_total(covered), F.lit(0)).alias("n_repeat_words"))


def rates(rows: DataFrame) -> DataFrame:
    """Adds the rules' figures, in thousandths, and base_failed."""
    part = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumns({"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "capitals": part("n_capitals", "word_chars"), "base_failed": failed})


def _log_gamma(x: Column) -> Column:
    """For x >= 1: Stirling's series, eight places further up."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def refuted(k: Column, n: Column, rate: float, delta: Column) -> Column:
    """Whether P(X <= k | n, rate) <= delta, exactly: the tail is summed downwards from k as multiples of its largest term."""
    k_, n_ = k.cast("double"), n.cast("double")
    top = _log_gamma(n_ + 1) - _log_gamma(k_ + 1) - _log_gamma(n_ - k_ + 1) + k_ * log(rate) + (n_ - k_) * log1p(-rate)
    steps = F.least(k, F.ceil(40 * F.sqrt(n_ * (rate * (1 - rate))) + 50)).cast("int")  # what lies further down is below 1e-300 of it
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (k_ - i) / (n_ - k_ + i + 1) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), start, add)["sum"]
    return F.when((n <= 0) | (k_ >= n_ * rate), F.lit(False)).otherwise(top + F.log(total) <= F.log(delta))


def cutoffs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, and for each rule its cutoff (null: off)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rows.where(~F.col("base_failed")).join(marks, "doc_id").select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES))).alias("x"))
    # one row for each figure that occurs, then the counts beyond each cutoff
    over = F.explode(F.filter(F.array(*map(F.lit, GRID)), lambda c: F.col("value") > c)).alias("cutoff")
    tally = held.groupBy("stratum", F.col("x.rule").alias("rule"), F.least(F.col("x.value"), F.lit(1001)).alias("value")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    beyond = tally.select("stratum", "rule", "good", "bad", over).groupBy("stratum", "rule", "cutoff").agg(F.sum("good").alias("lost"), F.sum("bad").alias("caught"))
    strata = tally.where(F.col("rule") == RULES[0]).groupBy("stratum").agg(F.sum("good").alias("good")).withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))
    grid = strata.select("*", F.explode(F.array(*map(F.lit, RULES))).alias("rule")).select("*", F.explode(F.array(*map(F.lit, GRID))).alias("cutoff"))
    tests = grid.join(beyond, ["stratum", "rule", "cutoff"], "left").fillna(0, ["lost", "caught"])
    tests = tests.withColumn("passed", refuted(F.col("lost"), F.col("good"), RATE / len(RULES), F.lit(DELTA) / (F.col("strata") * len(RULES))))
    sequence = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    tests = tests.withColumn("certified", F.min("passed").over(sequence)).where(F.col("certified") & (F.col("caught") > COST * F.col("lost")))
    best = tests.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("caught") - COST * F.col("lost"), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and the rules that rejected each row."""
    rows = common.table(rates(figures(docs)), "figures")
    cuts = cutoffs(rows, labels)
    broken = F.filter(F.array(*(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    out = rows.join(cuts, "stratum", "left").withColumn("broken", broken)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir).select("doc_id", "text", "lang"), common.documents(spark, sf_dir, "labels"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), g AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)
), m AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM m) GROUP BY r
), f AS (
  SELECT s.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN rep ON s.r = rep.r
), v AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    [1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
     1000 * n_repeat_words // greatest(n_words, 1), 1000 * n_capitals // greatest(word_chars, 1)] AS figure FROM f
), l AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), h AS (SELECT stratum, quality, figure FROM v JOIN l USING (doc_id) WHERE NOT base_failed
), st AS (SELECT stratum, count(*) FILTER (quality = 1) AS good, count(*) OVER () AS strata FROM h GROUP BY stratum
), x AS (
  SELECT st.stratum, rule, cutoff, any_value(good) AS good, any_value(strata) AS strata,
    count(*) FILTER (figure[rule] > cutoff AND quality = 1) AS lost, count(*) FILTER (figure[rule] > cutoff AND quality <> 1) AS caught
  FROM st JOIN h USING (stratum), range(1, {len(RULES) + 1}) AS k(rule), (SELECT unnest({list(GRID)}) AS cutoff) GROUP BY ALL
), p AS (
  SELECT *, good > 0 AND list_sum(list_transform(range(0, lost + 1), lambda j: exp(lgamma(good + 1.0) - lgamma(j + 1.0) - lgamma(good - j + 1.0)
    + j * ln({RATE / len(RULES)}) + (good - j) * ln(1 - {RATE / len(RULES)})))) <= {DELTA} / (strata * {len(RULES)}) AS passed FROM x
), c AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS certified FROM p
), b AS (
  SELECT stratum, rule, arg_max(cutoff, 10000.0 * (caught - {COST} * lost) + cutoff) AS cutoff FROM c WHERE certified AND caught > {COST} * lost GROUP BY stratum, rule
), bad AS (SELECT DISTINCT v.r FROM v JOIN b USING (stratum) WHERE figure[rule] > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.r IS NULL AS kept FROM v LEFT JOIN bad ON v.r = bad.r
"""
