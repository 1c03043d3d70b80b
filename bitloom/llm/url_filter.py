"""URL filter: fixed host/path rules, and logistic regression on hashed character n-grams for the rest.

Everything on the path of a row is one narrow projection: parse, look up the longest rule, sum the
weights of the n-grams.  The model is a literal of ``DIMENSIONS`` numbers, whatever the input.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, small, table

DIMENSIONS = 4096
NGRAM = 3
#: Weight of the quadratic penalty.
REGULAR = 0.003
#: Up to so many rules are inlined into the projection; with more, rules are joined by host.
INLINED_RULES = 200

#: (verdict, host, path), fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: A small labelled URL table, written by hand by kinds of sites: gambling, pills, pornography, link and
#: advertisement farms, quick money, cracked software ...
UNWANTED = """
royalcasino.test/slots grand-casino-online.test/roulette?x=1 casinobonus24.test/play vegas-slots.test/spin jackpot-poker.test/join
pokerstarz-bonus.test/deposit roulette-tricks.test/system sportsbets365.test/odds betting-tips-pro.test/today bets4u.test/football/live
best-bets.test/horse lotto-winner.test/claim winbigprizes.test/claim you-win-now.test/prize win-a-phone.test/lucky
viagra-online.test/order discountpharmacy.test/pills/blue pillstore24.test/buy diet-pills-fast.test/order buy-pills.test/cart cialis-generic.test/buy
cheapmeds-rx.test/order cheap-watches-replica.test/shop cheapsoftware-oem.test/buy replica-handbags.test/cheap
adultvideos.test/watch xxx-movies.test/free adultdating.test/join sexcams-live.test/room hot-singles.test/chat porn-tube-x.test/watch
nude-pics-xxx.test/gallery adult-chat.test/login escort-girls.test/city
linkfarm.test/links/page seo-backlinks-spam.test/buy spamlinks.test/a articlespinner-spam.test/x content-farm.test/list/9 farm-of-links.test/dir
clickads.test/r?u=1 adserver-click.test/banner popunder-ads.test/show tracking-pixel.test/t.gif ads-network.test/serve adtracker.test/click
payday-loans-fast.test/apply quick-cash-loan.test/now work-from-home-riches.test/start crypto-doubler.test/send forex-signals-vip.test/join free-money.test/get
free-iphone.test/claim free-giftcards.test/survey free-ringtones.test/get cracked-games-free.test/keygen warez-download.test/serial keygen-crack.test/dl torrentz-free.test/x
""".split()
#: ... and libraries, schools, newspapers, shops, clubs, offices, blogs.
WANTED = """
citylibrary.test/catalogue dailyherald.test/2023/05/12 gardening.test/roses weather.test/forecast university.test/courses/math
museum.test/exhibitions openproject.test/guide/install recipes.test/soup/12 bookshop.test/novels/7 the-times.test/world
theory-notes.test/lecture/4 therapy-center.test/team mother-earth.test/forests weather-station.test/data theatre.test/programme anthology.test/poems
thesis-archive.test/items/328 history.test/medieval nation.test/politics education.test/primary traditions.test/songs publications.test/journal/825
science-review.test/article/77 school-district.test/calendar hospital.test/visitors source-code.test/repo/tree cooking.test/recipe/5
travel-notes.test/lisbon music-school.test/lessons football-club.test/fixtures city-council.test/minutes art-gallery.test/artists photography.test/lenses
physics-forum.test/thread/453 law-review.test/issues/88 local-news.test/traffic knitting.test/patterns transport.test/timetable/669 gazette.test/notices
philosophy.test/kant biology.test/cells/412 chess-club.test/games/471 parks.test/trails radio-station.test/schedule observatory.test/stars/960
language-lab.test/grammar carpenter.test/oak bakery.test/bread/2 veterinary.test/cats orchestra.test/season rowing.test/regatta
geology.test/rocks village-hall.test/hire choir.test/rehearsals allotment.test/seeds railway-museum.test/engines fire-brigade.test/advice
harbour.test/tides forestry.test/survey/31 mathematics.test/proofs/8 opera.test/tickets climbing.test/routes astronomy.test/en/12
dentist.test/de/7 sailing.test/fr/31 pottery.test/es/5 parish.test/en/77 botany.test/de/120 chemistry.test/fr/9
nursery.test/en/3 surgery.test/opening notary.test/contact insurance.test/claims bank.test/branches plumber.test/prices
cinema.test/en/40 winery.test/es/61 advent.test/calendar adriatic.test/ferries freedom-trail.test/map spample-sampler.test/embroidery
farmers-market.test/stalls organic-farm.test/boxes betony.test/herbs better-bread.test/flour casserole.test/oven cheapside-history.test/london
""".split()
#: What says nothing of a site.
PREFIXES, FOLDERS = ("", "www.", "m.", "blog."), ("/", "/en/", "/de/", "/fr/", "/es/")


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _slots(host: Column, path: Column) -> Column:
    """Hashed slots of the character n-grams of ``^host$`` and ``^path$``, host and path apart."""

    def grams(text: Column, kind: str) -> Column:
        s = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(s) - (NGRAM - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substr(s, i, F.lit(NGRAM))), F.lit(DIMENSIONS)).cast("int"))

    return F.concat(grams(host, "h"), grams(ascii_lower(path), "p"))


def train(labelled: DataFrame) -> list[float]:
    """labelled(url, unwanted 0/1) -> intercept and ``DIMENSIONS`` weights.

    Rows are documented to be few (a hand-labelled table); they are fitted in one partition so that
    reruns give the same numbers.  They pass through a text file of sparse vectors (slots from 1,
    counts), which Spark's reader turns into vectors without Python.
    """
    from pyspark.ml.classification import LogisticRegression

    spark = labelled.sparkSession
    host, path = parsed(F.col("url"))
    slots = F.array_sort(_slots(host, path))
    counts = F.transform(F.array_distinct("slots"), lambda x: F.concat_ws(":", x + 1, F.size(F.filter("slots", lambda y: y == x))))
    lines = labelled.select(F.col("unwanted").cast("int").alias("label"), slots.alias("slots")).select(F.concat_ws(" ", "label", counts).alias("value"))
    where = new_path(spark, "urls")
    lines.orderBy("value").coalesce(1).write.text(where)
    rows = spark.read.format("libsvm").option("numFeatures", DIMENSIONS).load(where).coalesce(1).cache()
    model = LogisticRegression(regParam=REGULAR, maxIter=100, standardization=False).fit(rows)
    rows.unpersist()
    return [float(model.intercept), *map(float, model.coefficients.toArray())]


def seed_table(spark: SparkSession) -> DataFrame:
    """url, unwanted: the labelled table, as literals; both kinds alike have the usual prefixes and folders in turn."""
    turn = lambda i, u: PREFIXES[i % len(PREFIXES)] + u.replace("/", FOLDERS[i % len(FOLDERS)], 1)
    each = [F.struct(F.lit(f"http://{turn(i, u)}").alias("url"), F.lit(k).alias("unwanted")) for k, urls in ((1, UNWANTED), (0, WANTED)) for i, u in enumerate(urls)]
    return spark.range(1).select(F.inline(F.array(*each)))


def score(host: Column, path: Column, model: list[float]) -> Column:
    """Probability that a url is unwanted; an empty host scores 0."""
    weights = F.from_json(F.lit(json.dumps(model[1:])), "array<double>")
    total = F.aggregate(_slots(host, path), F.lit(model[0]), lambda acc, i: acc + F.element_at(weights, i + 1))
    return F.when(host == "", F.lit(0.0)).otherwise(1 / (1 + F.exp(-total)))


def judge(pages: DataFrame, model: list[float], rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, inlined: int = INLINED_RULES) -> DataFrame:
    """page_id, url, host, path, rule, score, verdict for every row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    rule decides (of equally long ones, which have one host and path, the last given).  Without one,
    a score of ``threshold`` or more blocks.  Null, empty or unparsable urls have empty host and
    path, no rule, score 0 and are allowed.  Rows are judged one by one: repeated ids and rows are
    nothing special, urls of any length are read whole, other columns are ignored, and an empty
    table gives none.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("score", score(F.col("host"), F.col("path"), model))
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    if len(rules) <= inlined:
        # one CASE, the longest rule first
        which = F
        for what, h, p in sorted(reversed(list(rules)), key=lambda r: -len(r[1]) - len(r[2])):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            which = which.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(what).alias("what")))
        rows = rows.withColumn("r", F.lit(None).cast("struct<rule:string,what:string>") if which is F else which)
        return rows.select("page_id", "url", "host", "path", "r.rule", "score", F.coalesce("r.what", verdict).alias("verdict"))
    return _by_join(rows, rules, verdict)


def _by_join(rows: DataFrame, rules, verdict: Column) -> DataFrame:
    """judge with any number of rules: each distinct (host, path) looks up the rules of every suffix of its host."""
    spark = rows.sparkSession
    each = spark.createDataFrame([(h, p, what, i) for i, (what, h, p) in enumerate(rules)], "rule_host string, rule_path string, what string, i int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = urls.join(small(each), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    longest = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), "i", F.concat("rule_host", "rule_path").alias("rule"), "what")).alias("r")
    found = fits.groupBy("host", "path").agg(longest).select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "r.rule", "r.what")
    both = rows.join(found, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    return both.select("page_id", "url", "host", "path", "rule", "score", F.coalesce("what", verdict).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    model = train(seed_table(spark))
    return judge(table(spark, sf_dir, "pages"), model).select("page_id", "host", "path", "rule", "verdict", "score")
