"""URL filter: host/path rules first, then logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

DataFrame functions only. The weight vector has a fixed length, so scoring is
one narrow projection over the pages: no join and no shuffle.

Defined results: a null url, or one without ``://``, has empty host and path and
gets the model's bias as its verdict; repeated rows are judged one by one; an
empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, staged, table

BUCKETS = 4096
SIZES = (3, 4, 5)

# The rules (host, path, verdict) of the query's contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The small labelled URL table (1: block).
LABELLED = [
    ("http://spam-farm.example.org/en/728", 1), ("https://spam-farm.example.net/de/3", 1),
    ("http://link-farm.example.org/fr/99", 1), ("https://www.cheap-pills.example.net/en/450", 1),
    ("http://cheap-pills.example.org/es/7?page=2", 1), ("http://cheap-meds.example.org/buy/1", 1),
    ("https://online-casino.example.org/play", 1), ("http://casino-bonus.example.net/en/5", 1),
    ("https://free-pills-now.example.org/order", 1), ("http://win-big-prize.example.org/click", 1),
    ("https://adult-cams.example.net/live/2", 1), ("http://xxx-video.example.org/watch/9", 1),
    ("http://cheap-loans.example.net/apply", 1), ("https://replica-watches.example.org/sale/8", 1),
    ("http://seo-spam.example.org/tags/22", 1), ("http://buy-followers.example.net/cheap", 1),
    ("https://torrent-free.example.org/download/4", 1), ("http://spam.example.net/en/1", 1),
    ("https://www.casino-win.example.org/de/571", 1), ("http://ads-track.example.org/en/584", 1),
    ("https://m.adult-x.example.net/en/341", 1), ("http://ads-banner.example.net/fr/12", 1),
    ("https://blog.tiontion.example.com/en/853/", 0), ("http://blog.ththan.example.net/en/960", 0),
    ("https://m.therou.example.org/en/474.html", 0), ("https://thther.example.org/en/685", 0),
    ("http://therha.example.net/de/676", 0), ("https://www.ththen.example.org/de/148.html", 0),
    ("https://news.example.org/en/2024/05/story", 0), ("http://docs.example.net/guide/intro", 0),
    ("https://wiki.example.org/wiki/History", 0), ("https://www.university.example.org/research", 0),
    ("http://library.example.net/books/77", 0), ("https://m.journal.example.org/article/12", 0),
    ("https://weather.example.net/today", 0), ("http://museum.example.org/visit", 0),
    ("https://therat.example.net/en/627/", 0), ("http://blog.tionsh.example.net/en/545", 0),
    ("https://m.thond.example.net/en/33", 0), ("http://thble.example.net/en/234", 0),
    ("https://www.erther.example.net/en/81.html", 0), ("http://therst.example.net/es/9", 0),
    ("https://blog.andhe.example.net/fr/640", 0), ("http://thering.example.net/de/402", 0),
    ("https://www.gardening.example.net/de/31", 0), ("http://ththed.example.org/en/453", 0),
    ("https://recipes.example.org/fr/soup", 0), ("https://code.example.net/project/readme.html", 0),
]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(longest):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all 3- to 5-character n-grams (with repeats). The characters
    are split once, so a long url costs in proportion to its length."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def grams(n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.hash(F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(buckets)))

    return F.concat(*[grams(n) for n in SIZES])


def margin(grams: Column, weights: list[float], bias: float) -> Column:
    """bias + sum of weights / sqrt(number of n-grams)."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # one literal, folded once
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(w, b))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def train_url_model(labelled: DataFrame, buckets: int = BUCKETS, rounds: int = 40, rate: float = 4.0,
                    l2: float = 1e-3) -> tuple[list[float], float]:
    """Full-batch gradient descent over (url, label). Each round is one
    aggregation by bucket; the driver gets at most ``buckets`` sums."""
    host, path = host_path(F.col("url"))
    grams = ngram_buckets(F.concat(F.lit("^"), host, path), buckets)
    rows = staged(labelled.select("label", grams.alias("grams")).coalesce(1), "labelled-urls")
    n = max(1, rows.count())
    weights, bias = [0.0] * buckets, 0.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-margin(F.col("grams"), weights, bias)))
        share = rows.select((p - F.col("label")).alias("r"), "grams").select(
            "r", (F.col("r") / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))).alias("g"),
            F.explode(F.concat(F.array(F.lit(-1)), "grams")).alias("bucket"))
        sums = share.groupBy("bucket").agg(F.sum("g").alias("g"), F.sum("r").alias("r")).collect()
        grad = {s["bucket"]: s for s in sums}
        bias -= rate * (grad[-1]["r"] if -1 in grad else 0.0) / n
        weights = [w - rate * ((grad[b]["g"] if b in grad else 0.0) / n + l2 * w) for b, w in enumerate(weights)]
    assert all(map(math.isfinite, weights)) and math.isfinite(bias)
    return weights, bias


def filter_urls(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] = RULES,
                url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (probability of block) and
    verdict added; input columns of those names are replaced."""
    host, path = host_path(F.col(url_col))
    keep = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "score"}]
    gram_col, by_col = fresh("grams", keep), fresh("by_rule", keep)
    parts = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    rule, by_rule = rule_match(F.col("host"), F.col("path"), rules)
    scored = (parts.withColumn("rule", rule).withColumn(by_col, by_rule)
              .withColumn(gram_col, ngram_buckets(F.concat(F.lit("^"), F.col("host"), F.col("path"))))
              .withColumn("score", 1.0 / (1.0 + F.exp(-margin(F.col(gram_col), *model)))))
    verdict = F.coalesce(F.col(by_col), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop(gram_col, by_col)


def labelled_urls(spark: SparkSession, rows: list[tuple[str, int]] = LABELLED) -> DataFrame:
    """(url, label) as an SQL table of constants, which needs no Python worker."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows])))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_url_model(labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
