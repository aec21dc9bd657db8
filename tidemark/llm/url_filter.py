"""URL filters (operator 1): block and allow rules, and a logistic regression for the rest, in DataFrame functions only.

The regression's features are hashed character n-grams of a URL's host and path. It is trained on a small labelled table
by stochastic gradient descent inside one aggregate expression; only its weights reach the driver, and they become a
literal in the plan that scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_name

BUCKETS = 2048
HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (4,)
#: Most rows of a labelled table, more are refused; most rules that are tried as a literal, more are joined.
LABELLED, RULES = 2000, 1000
EPOCHS, RATE, DECAY = 40, 1.0, 1e-4

#: A small labelled table: URLs that a text corpus leaves out (1) and ordinary ones (0).
LABELLED_URLS = [
    *((f"https://{host}", 1) for host in """
    www.best-casino.test/slots/en  m.casino-royal.test/de/bonus  casino-win.test/play  online-casino.test/fr/jackpot  blog.spin-casino.test/es/77
    free-bets.test/tips  m.sports-bets.test/en/odds  www.bets-now.test/de/live  bets-free.test/fr/231
    cheap-pills.test/buy  www.pills-online.test/en/order  cheap-meds.test/es/cart  m.diet-pills.test/de/90
    adult-x.test/video  www.adult-cams.test/en/live  m.xxx-adult.test/fr/1  hot-adult-x.test/es/22
    spam-farm.test/links  www.link-farm.test/en/seo  spam-list.test/de/mail  m.seo-spam.test/fr/17
    ads-track.test/pixel  m.track-ads.test/en/click  www.ads-server.test/de/banner  click-track.test/fr/4  ads.popunder.test/es/1
    blog.adult-zone.test/de/6  blog.cheap-pharma-pills.test/en/2  blog.ads-click.test/es/31  blog.bets-win.test/fr/8  blog.spam-mail.test/en/405
    """.split()),
    *((f"https://{host}", 0) for host in """
    www.library.test/en/books/12  m.library.test/de/55  history.museum.test/fr/731  blog.gardening.test/en/roses  kitchen.test/es/bread
    news.test/en/2021/04/city-council  www.weather.test/de/24541  river.test/fr/20334.html  mountains.test/en/9931/  m.villages.test/es/4312
    www.university.test/en/physics/notes  school.test/de/mathe/3  docs.software.test/en/manual.html  blog.travels.test/fr/lyon  music.test/es/guitar
    thermal.test/en/31102  m.threads.test/de/4410  stations.test/fr/87  www.nations.test/en/672  blog.motion.test/es/91
    tables.test/en/31  other.test/de/112.html  m.theory.test/fr/5  www.thesis.test/en/2004  institution.test/es/6  health.test/en/sleep
    than.test/fr/881  thread.test/en/12450  weather.test/fr/3  father.test/de/71  rather.test/es/6204  other-things.test/en/55.html  theatre.test/fr/120
    country.test/en/9  couleur.test/fr/41  www.thoughts.test/en/8  www.author.test/de/91  www.thunder.test/fr/62  winter.test/en/77  entry.test/es/18
    """.split()),
]


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` what lies under ``rule``: a host, then the start of a path."""

    action: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without it, or null: empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, action) of the longest rule that fits: its host is the URL's or a parent domain of it, and the
    URL's path starts with its path; null if none fits. Equal lengths: the alphabetically last."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,action:string>")
    table = F.array(*(F.struct(F.lit(len(r.rule)).alias("n"), F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules))
    fits = F.filter(table, lambda r: F.endswith(F.concat(F.lit("."), host), F.concat(F.lit("."), r["host"])) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))


def _grams(text: Column, n: int, mark: str) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(whole, i, F.lit(n))))


def features(host: Column, path: Column) -> Column:
    """Buckets (from 1) of the distinct n-grams of host and path."""
    grams = F.concat(*(_grams(host, n, "h") for n in HOST_GRAMS), *(_grams(path, n, "p") for n in PATH_GRAMS))
    return F.array_distinct(F.transform(grams, lambda g: (F.pmod(F.xxhash64(g), F.lit(BUCKETS)) + 1).cast("int")))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets and, last, the intercept, from labelled (url, label: 1 block, 0 keep) of at most LABELLED
    rows; null urls or labels teach nothing. Rows are visited in the order of a hash, EPOCHS times."""
    rows = labelled.filter("url is not null and label is not null").select(F.xxhash64("url").alias("o"), "url", F.col("label").cast("double").alias("y"))
    rows = rows.select("o", "url", "y", features(host(F.col("url")), path(F.col("url"))).alias("b"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS + 1)), lambda i: F.when(F.array_contains("b", i.cast("int")) | (i == BUCKETS + 1), 1.0).otherwise(0.0))
    rows = rows.select("o", "url", (F.lit(1.0) / F.sqrt(F.size("b") + 1)).alias("s"), "y", dense.alias("x"))
    one = rows.limit(LABELLED + 1).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("o", "url", "y", F.transform("x", lambda v: v * F.col("s")).alias("x")))).alias("rows"))

    def visit(w: Column, r: Column) -> Column:
        z = F.aggregate(F.zip_with(w, r["x"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        pull = F.lit(RATE) * (_sigmoid(z) - r["y"])
        return F.transform(F.arrays_zip(F.array(F.struct(w.alias("w"), r["x"].alias("x"), pull.alias("g")))), lambda q: F.zip_with(q["0"]["w"], q["0"]["x"], lambda a, b: a * (1 - DECAY) - q["0"]["g"] * b))[0]

    zeros = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    n, weights = one.select("n", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), zeros, lambda w, _: F.aggregate("rows", w, visit))).first()
    if n > LABELLED:
        raise ValueError(f"the labelled table has more than {LABELLED} rows")
    return list(weights)


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that a URL is to be blocked."""
    w = F.array(*map(F.lit, weights))
    b = features(host, path)
    z = F.aggregate(b, F.lit(0.0), lambda acc, i: acc + F.element_at(w, i)) + weights[-1]
    return _sigmoid(z / F.sqrt(F.size(b) + 1))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(host, path, rule, action) of rules, for ``with_best_rule``."""
    rows = [(r.host, r.path, r.rule, r.action) for r in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, action string")


def with_best_rule(urls: DataFrame, host: str, path: str, rules: DataFrame, into: str) -> DataFrame:
    """urls with the struct of ``best_rule`` as ``into``, for any number of rules (host, path, rule, action): each distinct
    host's suffixes are joined with the rules of that host, the path of each distinct (host, path) that has some decides,
    and the choice is joined back. Rows without a rule keep null; hosts with very many urls cost one row each."""
    pairs = urls.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    parts = F.split(F.concat(F.lit("."), "h"), "[.]")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pairs.select("h").distinct().select("h", F.explode(F.array_distinct(suffixes)).alias("host"))
    own = hosts.join(rules.select("host", F.col("path").alias("start"), "rule", "action"), "host")
    met = pairs.join(own, "h").filter(F.startswith("p", "start"))
    best = met.groupBy("h", "p").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    best = best.select(F.col("h").alias(host), F.col("p").alias(path), F.col("best").alias(into))
    return urls.join(best, [host, path], "left")


def judge(urls: DataFrame, rules: list[Rule], weights: list[float], limit: float = 0.7) -> DataFrame:
    """urls (with a column url) with host, path, rule, block_score and verdict: the rule's action, else ``block`` if the
    score reaches ``limit``, else ``allow``. All columns stay; columns of urls with one of these names stay under that
    name with underscores behind it. Null urls and urls without ``://`` have empty host and path, which no rule fits;
    repeated rows are judged alike; an empty table gives an empty result. Up to RULES rules are tried in the row, more
    are joined."""
    added = ("host", "path", "rule", "block_score", "verdict")
    for name in added:
        if any(c.lower() == name for c in urls.columns):
            urls = urls.withColumnRenamed(name, free_name(urls, name))
    out = urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    best = free_name(out, "_best")
    if len(rules) <= RULES:
        out = out.withColumn(best, best_rule(F.col("host"), F.col("path"), rules))
    else:
        out = with_best_rule(out, "host", "path", rule_table(urls.sparkSession, rules), best)
    out = out.withColumn("block_score", score(F.col("host"), F.col("path"), weights))
    verdict = F.coalesce(F.col(best)["action"], F.when(F.col("block_score") >= limit, "block").otherwise("allow"))
    return out.withColumn("rule", F.col(best)["rule"]).withColumn("verdict", verdict).drop(best)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """LABELLED_URLS as a table."""
    assert all(re.fullmatch(r"[\w:/.-]+", u) for u, _ in LABELLED_URLS)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f"('{u}', {y})" for u, y in LABELLED_URLS)} AS t(url, label)")
