"""URL filters: rules by host and path, and a logistic regression for URLs without a rule.

The features of a URL are its character n-grams, hashed to `PLACES`: those of the host and
those of the path, each with its ends marked. The model is trained from a small labelled
table by gradient descent on the logistic loss with a ridge penalty. Weights stay in the
span of the training rows, so the descent works on one coefficient for each row and the
rows' inner products; it is one expression over one row of at most `TRAINING_ROWS` entries.
Everything is DataFrame functions: training, weights and judging run in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import bounded_sample, let

SIZES = (3, 4, 5)
PLACES = 1 << 13
BIAS = PLACES
# Of the hash of an n-gram: factor and modulus, small enough for 64-bit products.
FACTOR, MODULUS = 1_000_003, 2_147_483_647
# Rows of the labelled table that are learned from, in hash order beyond that.
TRAINING_ROWS = 400
STEPS = 800
RATE = 3.0
RIDGE = 1e-4
CUT = 0.5
START, END = "\x02", "\x03"
DIGITS = "0123456789"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABELLED_SCHEMA = "url string, block int"

# A labelled table of made-up URLs, wanted and unwanted.
WANTED = """
https://www.citylibrary.example.org/en/catalogue/204
http://news.harbourpost.example.com/en/2023/18
https://blog.gardenpath.example.net/en/51.html
https://m.weatherhouse.example.com/de/77
https://physics.stoneuniversity.example.org/en/640/
http://www.mountainmuseum.example.org/fr/12
https://docs.softtools.example.net/en/311#top
https://forum.beekeepers.example.com/en/88?page=2
https://www.townhall.example.org/es/430
http://m.dailyherald.example.com/en/905?utm_source=feed
https://recipes.kitchenhome.example.net/fr/67/
https://blog.riverwalks.example.org/en/222
https://history.oldmaps.example.com/en/19.html
http://www.schoolboard.example.org/en/734
https://wiki.plants.example.net/en/560
https://healthcentre.example.org/en/41/
https://blog.thornton.example.com/en/613
https://m.southern.example.net/en/289#top
http://then.example.org/en/154
https://the-other-weather.example.com/es/836
https://www.lantern.example.net/de/390.html
https://blog.nation.example.com/fr/515/
http://station.example.org/en/27?page=2&ref=x
https://m.motherland.example.net/es/702?utm_source=feed
https://www.northland.example.com/en/148
https://theatre.example.org/en/996#top
http://blog.ration.example.net/en/333
https://www.question.example.com/en/481/
https://m.shore.example.org/fr/59.html
https://worthing.example.net/de/870
https://blog.southend.example.com/en/216?page=2&ref=x
http://www.tables.example.org/en/605
https://orchestra.example.net/en/92/
https://m.reading.example.com/es/447
https://www.whether.example.org/en/768?utm_source=feed
https://blog.holidays.example.net/en/13
http://sports.rowingclub.example.com/en/350.html
https://journal.medicine.example.org/en/829
https://www.railway-times.example.net/fr/174#top
https://m.bird-watch.example.org/en/38
https://www.photo-club.example.com/de/692/
http://open-data.example.org/en/555
https://art-school.example.net/en/281?page=2&ref=x
https://www.farmersmarket.example.com/es/407
http://that-was-then.example.com/en/63
https://m.sweethat.example.net/de/318/
https://www.athens-guide.example.org/en/747
https://blog.entrants.example.net/en/26?utm_source=feed
https://station-street.example.com/fr/529
https://m.cottage.example.org/en/811.html
http://www.bestbooks.example.net/en/190
https://arts-and-letters.example.com/en/474#top
https://m.chess-club.example.com/es/205
http://blog.fishing-farm.example.org/en/652/
https://www.starthere.example.net/en/37
https://trackrunners.example.com/en/583?page=2&ref=x
"""
UNWANTED = """
https://www.casino-royal.example.com/en/204
http://blog.online-casino.example.net/de/18
https://m.mega-casino-win.example.org/en/51.html
https://slots-jackpot.example.com/fr/77
http://www.win-big-money.example.net/en/640/
https://free-bets-now.example.com/en/12?utm_source=feed
https://m.sports-bets.example.org/es/311
http://poker-bonus.example.net/en/88#top
https://www.cheap-pills-online.example.com/en/430
http://blog.cheap-viagra.example.org/en/905
https://m.pills-discount.example.net/fr/67/
https://pharmacy-cheap-meds.example.com/en/222?page=2&ref=x
http://www.spam-mail.example.org/en/19
https://link-farm.example.net/en/734.html
https://blog.spam-links.example.com/de/560
http://seo-farm.example.org/en/41
https://ads-network.example.com/en/613/
https://m.track-ads.example.net/en/289
http://www.ad-track-click.example.org/es/154#top
https://click-tracker.example.com/en/836?utm_source=feed
https://adult-video.example.net/en/390
http://m.adult-cams.example.com/fr/515
https://www.xxx-adult.example.org/en/27/
http://hot-xxx-chat.example.net/en/702.html
https://payday-loans-fast.example.com/en/148
http://www.free-prize-winner.example.org/en/996
https://blog.warez-crack.example.net/de/333?page=2&ref=x
https://replica-watches-cheap.example.com/en/481
http://pills-shop.example.com/en/160
https://www.diet-pills.example.org/fr/94
https://blog.casino-games.example.com/en/877.html
http://m.bets-online.example.net/en/45/
https://adult-dating.example.org/en/342?page=2&ref=x
https://www.adult-xxx.example.com/es/718
https://cheap-casino.example.net/de/259
https://spam-blast.example.com/en/506
http://www.ads-click.example.net/fr/83#top
https://m.free-spins.example.org/en/961
https://get-free-money.example.com/en/124?utm_source=feed
"""


@dataclass(frozen=True)
class Rule:
    """`verdict` for the host and its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """`url, block` of the built-in labelled table."""
    rows = [(url, 0) for url in WANTED.split()] + [(url, 1) for url in UNWANTED.split()]
    return spark.createDataFrame(rows, LABELLED_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased,
    and what follows up to the next `?`, `#` or end. Both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one; of rules equally
    long the one with the longer host, then the first in order. Rules are part of the plan:
    meant for tens of them."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name), reverse=True):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = inside & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


# ------------------------------------------------------------------ features

def _grams(text: Column, kind: int) -> Column:
    """The place of each n-gram of a text with its ends marked, repeats included. Digits
    count as 0, so that page numbers tell nothing but their length."""

    def place(codes: Column, n: int):
        def at(i: Column) -> Column:
            h = F.lit(kind).cast("long")
            for k in range(n):
                h = (h * FACTOR + codes[i + k]) % MODULUS
            return (h % PLACES).cast("int")

        return at

    def places(codes: Column) -> Column:
        parts = []
        for n in SIZES:
            last = F.size(codes) - n
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, place(codes, n)))
        return F.concat(*parts)

    marked = F.concat(F.lit(START), F.translate(text, DIGITS, "0" * 10), F.lit(END))
    return let(F.transform(F.split(marked, ""), lambda c: F.ascii(c).cast("long")), places)


def grams(host: Column, path: Column) -> Column:
    return F.concat(_grams(host, 1), _grams(path, 2))


# ------------------------------------------------------------------ model

def train(labelled: DataFrame) -> DataFrame:
    """One row, `weights` of the places and of the bias after them, from `url, block` (0 or 1).
    The value of a place in a row is
    its count divided by the root of the row's n-grams. Rows with a null are left out; of
    repeated rows each counts. Without rows all weights are 0."""
    known = labelled.select("url", F.col("block").cast("int").alias("block")).dropna()
    known = bounded_sample(known, TRAINING_ROWS, known.count(), 3, "url", "block")
    rows = known.agg(F.array_sort(F.collect_list(F.struct("url", "block"))).alias("rows"))
    rows = rows.select(F.posexplode("rows").alias("i", "r")).select("i", F.col("r.block").alias("y"), grams(*host_and_path(F.col("r.url"))).alias("g"))
    values = rows.select("i", F.explode("g").alias("place"), F.sqrt(F.size("g")).alias("root"))
    values = values.groupBy("place", "i").agg((F.count(F.lit(1)) / F.first("root")).alias("x"))

    # Inner products of the rows; a constant of 1 in each is the bias.
    a, b = (values.select("place", F.col("i").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
    products = a.join(b, "place").groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 9).alias("dot"))
    last = rows.agg(F.max("i")).scalar()
    every = rows.select(F.col("i").alias("a"), F.explode(F.sequence(F.lit(0), last)).alias("b"))
    products = every.join(products, ["a", "b"], "left").select("a", "b", (F.coalesce("dot", F.lit(0.0)) + 1).alias("dot"))
    products = products.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "dot"))), lambda p: p["dot"]).alias("dots"))
    table = rows.join(products, rows["i"] == products["a"]).agg(F.array_sort(F.collect_list(F.struct("i", "y", "dots"))).alias("t"))

    def step(alpha: Column, _: Column) -> Column:
        def moved(r: Column) -> Column:
            z = F.aggregate(F.zip_with(r["dots"], alpha, lambda g, w: g * w), F.lit(0.0), lambda s, v: s + v)
            error = r["y"] - 1 / (1 + F.exp(-z))
            return alpha[r["i"]] * (1 - RATE * RIDGE) + error * RATE / F.size(F.col("t"))

        return F.transform(F.col("t"), moved)

    start = F.transform(F.col("t"), lambda r: F.lit(0.0))
    alpha = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("alpha"))
    alpha = alpha.select(F.posexplode("alpha").alias("i", "alpha"))
    summed = values.join(alpha, "i").select("place", (F.col("x") * F.col("alpha")).alias("w"))
    summed = summed.unionByName(alpha.select(F.lit(BIAS).alias("place"), F.col("alpha").alias("w")))
    summed = summed.groupBy("place").agg(F.sum("w").alias("w"))
    places = labelled.sparkSession.range(PLACES + 1).select(F.col("id").cast("int").alias("place"))
    dense = places.join(summed, "place", "left").select("place", F.coalesce("w", F.lit(0.0)).alias("w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda p: p["w"]).alias("weights"))


def with_score(found: DataFrame, model: DataFrame) -> DataFrame:
    """`found` (`host, path`) with `score`, the probability of `block`. The one row of `model`
    is read as a value, once."""

    def scored(v: Column) -> Column:
        total = F.aggregate(v["g"], F.lit(0.0), lambda s, place: s + v["w"][place])
        return 1 / (1 + F.exp(-(v["w"][BIAS] + total / F.sqrt(F.greatest(F.size(v["g"]), F.lit(1))))))

    both = found.select("*", grams(F.col("host"), F.col("path")).alias("_g"), model.scalar().alias("_w"))
    return both.select("*", let(F.struct(F.col("_g").alias("g"), F.col("_w").alias("w")), scored).alias("score")).drop("_g", "_w")


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` for each row of `pages` (`page_id, url`).
    `rule` is the longest one that fits, else null; its verdict counts, else the model's:
    `block` from a score of `CUT`. Null and empty URLs, and those without `://`, have an empty
    host and path and are judged by the model. Repeated rows stay; long URLs count whole."""
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    found = with_score(found.select("*", rule.alias("rule"), verdict.alias("ruled")), model)
    judged = F.coalesce("ruled", F.when(F.col("score") >= CUT, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", judged.alias("verdict"), F.round("score", 4).alias("score"))
