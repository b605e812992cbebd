"""URL filter: listed rules first, then logistic regression on hashed character n-grams of host and path.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, fits no rule and is judged by
the model like any other. Rows with a null page_id are judged too; repeated rows get equal verdicts; URLs of any length are
read whole; an empty table gives no rows; other columns are ignored.

The labelled table has no host of ``pages``, so all of these are hosts that the model wasn't shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: (host and path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: Sites to block, by the categories of public blocklists, and ordinary ones: their names, of which no host of ``pages`` is one.
BLOCKED = """
online-pharmacy discount-pharmacy buy-pills-online cheap-meds no-prescription-pills herbal-viagra diet-pills-shop cheap-viagra
online-casino casino-royale-bonus casino-jackpot lucky-slots slots-win poker-bonus sports-betting bet-now best-bets free-spins
win-jackpot big-win-lottery free-poker-chips
adult-videos adult-chat adult-cams xxx-cams xxx-movies porn-tube free-porn hot-dating adult-dating escort-girls
ad-server ads-exchange banner-ads popup-ads click-ads ad-tracker ads-click track-clicks pixel-track click-tracker user-tracking
malware-download free-codec-update fake-antivirus trojan-host spyware-removal-free
phishing-login verify-account secure-update-login bank-login-alert account-verify-now
warez-cracks keygen-serials torrent-movies free-mp3-downloads crack-download
payday-loans fast-cash-loans easy-credit make-money-fast free-money work-from-home-cash crypto-doubler cheap-loans
link-farm content-farm seo-spam seo-backlinks cheap-backlinks spam-mailer bulk-spam spam-links replica-watches cheap-watches
fake-handbags free-gift-cards free-iphone free-prizes-win
""".split()
KEPT = """
weather city-library national-museum recipes daily-news science-journal university travel-guide history-society
garden-club public-school music-theory open-maps health-service sports-report art-gallery film-review football-results
tax-office town-council bike-repair coffee-house book-shop language-course chess-club train-times farm-museum
linkmark adler harbour bridge winter castle marathon lantern orchard thistle theorem thornton tionella therapon
leather brother northern other-voices motion nation-today relation thread thirteen ether-wave
pillar-stone seoul-guide betony windmill freedom-history spanish-grammar cashmere-goat
then-and-there theatre thesaurus thatcher thunder method athens pathology authority mathematics earth-hour southern
station national international fashion question attention edition pension mission fiction
table cable noble marble humble vegetable responsible
anderson henderson eastern western inner outer-banks dinner winner-circle singing morning evening spring
handmade island thousand england forest interest harvest modest priest restoration
reading writing running engineering building cooking learning the-herald thermal another together
""".split()
PATHS = ("/", "/en/12", "/de/340.html", "/fr/7?page=2", "/es/index#top", "", "/en/2020/01/story")
#: The labelled URLs: pages to block (1) and to keep (0), each name under one of the endings and paths in turn.
LABELLED = tuple(
    (f"http{'s' * (n % 2)}://{('', 'www.', 'm.', 'blog.')[n % 4]}{name}.example.{('com', 'net', 'org')[n % 3]}{PATHS[n % len(PATHS)]}", label)
    for label, names in ((1, BLOCKED), (0, KEPT))
    for n, name in enumerate(names)
)

BITS = 16
SIZES = (3, 4, 5)
#: The best of twelve settings by five folds of the labelled table.
STEPS, RATE, RIDGE = 1500, 4.0, 1e-4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (null where none does)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def grams(values: pa.Array, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each string with its ends marked, and where each string's start."""
    o, b = common.buffers(values)
    n = len(values)
    size = np.diff(o)
    padded = np.full(len(b) + 2 * n, 1, np.uint64)
    begin = o[:-1] + 2 * np.arange(n)
    padded[common.gather(begin + 1, size)] = b
    out, of = [], []
    for k in SIZES:
        each = np.maximum(size + 2 - k + 1, 0)
        at = common.gather(begin, each)
        h = np.full(len(at), np.uint64(k + 16 * part))
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[at + i]
        out.append((common.mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(np.repeat(np.arange(n), each))
    buckets, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return buckets[order], np.searchsorted(of[order], np.arange(n + 1))


def score(hosts: pa.Array, paths: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probabilities that the model gives for blocking."""
    total = np.full(len(hosts), weights[-1])
    for part, values in enumerate((hosts, paths)):
        buckets, at = grams(values, part)
        total += common.segment_sum(weights[buckets], at) / np.sqrt(np.maximum(np.diff(at), 1))
    return 1 / (1 + np.exp(-total))


def parts(urls: DataFrame) -> DataFrame:
    """All columns of urls (url and others) with host and path; the only parser, of pages and labelled URLs alike."""
    return urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


def fit(hosts: pa.Array, paths: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Weights of the hashed n-grams, and last the intercept."""
    y = np.asarray(labels, float)
    weights = np.zeros((1 << BITS) + 1)
    own = [grams(v, k) for k, v in enumerate((hosts, paths))]
    for _ in range(STEPS):
        error = (score(hosts, paths, weights) - y) / len(y)
        step = RIDGE * weights
        step[-1] = error.sum()
        for buckets, at in own:
            n = np.diff(at)
            step[:-1] += np.bincount(buckets, np.repeat(error / np.sqrt(np.maximum(n, 1)), n), 1 << BITS)
        weights -= RATE * step
    return weights


def table(spark: SparkSession, labelled=LABELLED) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Hosts, paths and labels of the labelled URLs (a table of about a hundred rows)."""
    t = parts(spark.createDataFrame([(n, u, y) for n, (u, y) in enumerate(labelled)], "n int, url string, label int")).orderBy("n").toArrow()
    return common.strings(t["host"]), common.strings(t["path"]), t["label"].to_numpy()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row."""
    sent = common.broadcast_value(pages.sparkSession, fit(*table(pages.sparkSession, labelled)))
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).drop("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for b in common.lean(batches):
            p = score(common.strings(b["host"]), common.strings(b["path"]), weights)
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], pa.array(p)], ["page_id", "host", "path", "p_block"])

    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"page_id {kind}, host string, path string, p_block double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir, "pages").select("page_id", "url"))
