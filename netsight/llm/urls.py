"""URL filter: rules for hosts and paths, and logistic regression on hashed character n-grams for the rest.

DataFrame functions and the JVM's own learners only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.llm.common import LOWER, UPPER

#: A small labelled table: hosts that a corpus of prose does not want, and ordinary ones. Both kinds come
#: below the same names and with the same paths, so that only what the hosts are called tells them apart.
BLOCKED = (
    "cheap-meds", "online-pills", "viagra-shop", "pills-store", "cheap-viagra", "best-casino", "casino-online", "casino-bonus",
    "win-jackpot", "casino-royal", "sports-bets", "bets-now", "free-bet", "poker-bets", "adult-video", "adult-chat",
    "xxx-adult", "hot-porn", "ads-server", "track-ads", "ads-click", "ad-tracker", "spam-links", "link-farm",
    "spam-mail", "seo-farm", "payday-loans", "replica-watches", "free-warez", "crypto-win",
)
WANTED = (
    "library", "city-news", "garden", "weather", "old-tools", "museum", "school", "cooking",
    "history", "travel", "science", "music", "books", "health", "theatre", "forum",
    "university", "river", "stories", "archive", "mountain", "kitchen", "language", "harbour",
    "planet", "letters", "gardens", "painting", "north-sea", "the-island", "chatham", "manhattan",
    "nation", "station", "other-things", "reading", "winter", "tradition", "evening", "english",
    "shoreline", "brother", "father", "thinker", "thousand", "earth", "northern", "authors",
)
BELOW = ("", "www.", "blog.", "m.")
PATHS = ("/en/12", "/de/2048/", "/fr/310.html", "/es/77?page=2", "/", "/about")
SIZES = (3, 4, 5)
FEATURES = 1 << 16


@dataclass(frozen=True)
class Rule:
    """A verdict for the paths that start with `path` on `host` and all its subdomains."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        same = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return same & F.startswith(path, F.lit(self.path))


RULES = (
    Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ://, up to the next / ? # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, with a mark at either end; digits are alike."""
    name = F.concat(F.lit("^"), F.regexp_replace(F.concat(host, path), "[0-9]+", "0"), F.lit("$"))

    def pieces(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1)))
        return F.transform(places, lambda at: F.substring(name, at, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(pieces, SIZES))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the small table that the filter learns from unless it is given another one."""
    rows = [
        (f"https://{below}{host}.example{path}", label)
        for label, hosts in ((1, BLOCKED), (0, WANTED))
        for host in hosts
        for below in BELOW
        for path in PATHS[len(host) % 2 :: 2]
    ]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {b})" for u, b in rows) + " AS t (url, blocked)")


def train(labelled: DataFrame, url: str = "url", label: str = "blocked") -> LogisticRegressionModel:
    rows = labelled.select(grams(host_of(F.col(url)), path_of(F.col(url))).alias("grams"), F.col(label).cast("double").alias("label"))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows)
    return LogisticRegression(regParam=0.01, standardization=False, maxIter=100).fit(hashed.select("features", "label"))


def url_verdicts(
    pages: DataFrame,
    model: LogisticRegressionModel,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """(key, host, path, rule, verdict, blocked_chance) of every row.

    Of the rules that fit, the longest wins (of equally long ones the last given); without one the
    verdict is the model's. A null url, or one without ://, has an empty host and path, which no rule
    fits and the model judges as such. Every row gives a row, whatever its key.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rows = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows).drop("grams")
    scored = model.transform(hashed).withColumn("blocked_chance", vector_to_array("probability")[1])
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("blocked_chance") >= threshold, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest comes last, and so first in the chain
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return scored.select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "blocked_chance"
    )
