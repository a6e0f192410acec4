"""URL filters: allow and block rules first, then a logistic regression.

The regression runs on hashed character n-grams of host and path and is
trained from a small labelled URL table (at most ``MOST_LABELLED`` rows of it,
first by hash).  Rules fit a host and its subdomains and a path prefix; the
longest fitting rule wins and the model judges what no rule fits.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged by the model's intercept; null page_ids come back as null; repeated
rows are judged each; urls are judged whole, however long; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import table, tune

#: (host, path, verdict), as the contract gives them.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MOST_LABELLED = 10_000
DIMENSIONS = 1 << 16
#: Of the model's probability: the least at which no wanted host of the labelled table was blocked while its host was held out.
THRESHOLD = 0.7
#: Words of hosts and paths that are unwanted, and of others; words that go with either.
UNWANTED = (
    "casino", "poker", "roulette", "blackjack", "jackpot", "slots", "bingo", "betting", "bookmaker", "wager", "gambling", "lottery",
    "viagra", "cialis", "pills", "pharmacy", "steroids", "tramadol", "painkiller", "slimming", "porn", "xxx", "adult", "escort", "camgirl",
    "hookup", "nude", "erotic", "fetish", "replica", "counterfeit", "payday", "quickloan", "getrich", "pyramid", "moneymaker", "cryptodouble",
    "warez", "keygen", "serialcrack", "torrent", "cheats", "popunder", "adserver", "adclick", "tracker", "clickbait", "linkfarm", "backlinks",
    "spam", "spammer", "doorway", "scraper", "phishing", "malware", "giveaway", "freeprize", "bets",
)
WANTED = (
    "library", "museum", "science", "physics", "biology", "chemistry", "history", "archive", "school", "college", "university", "teacher",
    "weather", "garden", "recipes", "cooking", "bakery", "travel", "railway", "hiking", "camping", "cycling", "football", "tennis", "chess",
    "music", "orchestra", "theatre", "cinema", "gallery", "painting", "poetry", "novels", "bookshop", "reading", "language", "grammar",
    "software", "python", "database", "compiler", "network", "hardware", "electronics", "astronomy", "geology", "maps", "council", "parliament",
    "newspaper", "magazine", "radio", "hospital", "nursing", "charity", "wildlife", "birds", "farming", "woodwork", "genealogy",
)
EITHER = ("club", "online", "world", "central", "today", "guide", "zone", "place", "home", "info", "direct", "plus", "north", "river", "city", "group")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.substring_index(url, "://", 1)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(has, F.substr(url, F.length(rest) + 4)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Hashed 3- to 5-grams of the host, 2- to 4-grams of the path, each with its ends marked."""
    out = [0]
    for kind, text, sizes in (("h", f"^{host}$", (3, 4, 5)), ("p", f"^{path}$", (2, 3, 4))):
        out += [zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % DIMENSIONS for n in sizes for i in range(len(text) - n + 1)]
    return np.unique(np.array(out, dtype=np.int64))


def fit(labelled: list[tuple[str, str, int]], rounds: int = 1500, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights by full-batch gradient descent, features scaled to unit length; weight 0 is the intercept."""
    rows = [grams(h, p) for h, p, _ in labelled]
    y = np.array([v for *_, v in labelled], dtype=np.float64)
    at, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    value = np.where(col == 0, 1.0, (1 / np.sqrt([len(r) for r in rows]))[at])
    w = np.zeros(DIMENSIONS)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(at, w[col] * value, len(rows))))
        w -= rate * (np.bincount(col, ((p - y) * balance)[at] * value, DIMENSIONS) / len(rows) * 10 + l2 * w)
    return w


def labelled_rows() -> list[tuple[str, int]]:
    """(url, label): every word with some of the words that go with either, in host and path.  No host of a given table is among them."""
    rows = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for i, w in enumerate(words):
            for j in range(6):
                more, other = EITHER[(3 * i + 5 * j) % len(EITHER)], words[(i + 7 * j + 1) % len(words)]
                host = (f"{w}-{more}", f"{more}{w}", f"{w}{more}", f"{more}-{w}", f"{w}.{more}", w)[j]
                top, sub = ("com", "net", "org", "info", "de", "fr")[(i + j) % 6], ("", "www.", "m.", "blog.")[(i + 2 * j) % 4]
                path = ("", f"{other}/", f"{other}-{more}.html", f"en/{w}", f"{more}/{other}", f"{i * 37 + j * 11}")[(i + j) % 6]
                rows.append((f"https://{sub}{host}.{top}/{path}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled URL table (url, label): written by rule from the word lists above, as no given table labels URLs."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def url_filter(
    pages: DataFrame,
    labelled: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the model's probability of unwanted)."""
    spark = pages.sparkSession
    tune(spark)
    host, path = split_url(F.col("url"))
    sample = labelled.where("label is not null").select(host.alias("host"), path.alias("path"), "label").orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(MOST_LABELLED)
    known = [(r[0], r[1], int(r[2])) for r in sample.collect()]
    weights = fit(known) if known else np.zeros(DIMENSIONS)
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            out = []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                g = grams(h, p)
                z = float(w[0] + w[g[g > 0]].sum() / np.sqrt(len(g)))
                out.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    host, path = split_url(F.col("_url"))
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("_url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    d = d.mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return d.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), labelled_urls(spark))
