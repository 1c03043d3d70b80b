"""Benchmark decontamination by seeds.

A seed is a fixed mask over a window of words; the words under its 1s are hashed and the others
are ignored, so a substituted word spoils only the windows that look at it.  The mask is short
enough that every overlap within the tolerance has a window it doesn't spoil.  Hashes of the
benchmark's windows and of the corpus' windows are joined, and each hit is verified along its
diagonal: words of text and item are compared place by place, substitutions allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: 1: the word counts, 0: it is ignored.  Three equal words in a row stand in every stretch of WHOLE
#: words or more of which AGREE are equal: n words less n / 4 others at most make n / 4 + 1 runs at
#: most, which with two words at most each would be n <= 8.  No wider mask reaches all of them.
MASKS = ("111",)
#: Most benchmark windows (rows) whose hash table is broadcast; beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Most contaminated ids that are broadcast when rows are filtered.
BROADCAST_IDS = 1_000_000
#: An overlap is reported from so many words on (or the whole item, if shorter) ...
LEAST_WORDS = 13
#: ... of which this share agrees.
AGREE = 0.75
#: Items of fewer words must agree in all of them.
WHOLE = 9
NOT_WORD = r"[\s\p{Punct}]+"


def hashed_words(text: Column) -> Column:
    """64-bit hashes of the lower-cased words; white space and punctuation separate."""
    flat = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.transform(F.filter(flat, lambda w: w != ""), lambda w: F.xxhash64(w))


def _window(h: Column, at: Column, mask: str, k: int) -> Column:
    """Hash of the words under the mask from place ``at`` on, null where the window doesn't fit."""
    picked = [F.get(h, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(k), *picked))


def benchmark_windows(items: DataFrame, masks=MASKS) -> DataFrame:
    """items(item_no, item) -> key, item_no, at: one row per item, mask and place.

    Items shorter than every mask have one window, all their words.
    """
    shortest = min(map(len, masks))
    at = items.select("item_no", "item", F.posexplode("item").alias("at", "w"))
    keys = [_window(F.col("item"), F.col("at"), m, k) for k, m in enumerate(masks)]
    keys += [F.when((F.size("item") == n) & (F.col("at") == 0), _window(F.col("item"), F.col("at"), "1" * n, -n)) for n in range(1, shortest)]
    return at.select("item_no", "at", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL").select("key", "item_no", "at")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, least_words: int = LEAST_WORDS, agree: float = AGREE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_match: each verified overlap of a text with an item.

    ``n_words`` are the words of the item that the text covers on that diagonal, trimmed to the
    longest stretch whose agreement holds (the first of several); ``n_match`` those that are equal.
    Items of fewer than ``WHOLE`` words are compared whole (all words must agree).  Null and empty
    texts and items have none.  Texts of one id are texts of their own, and so are items of one id;
    rows of equal id and text count once.  Long texts are looked at whole.  Extra columns are ignored.
    """
    return _verified(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, least_words, agree, broadcast_windows).drop("version")


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, masks, least_words: int, agree: float, broadcast_windows: int) -> DataFrame:
    """overlaps and version, the hash of the text that a row of doc_id is about."""
    items = benchmark.select(F.col(item_col).alias("item_id"), hashed_words(F.col(item_text_col)).alias("item")).where(F.size("item") > 0).distinct()
    items = cut(items.withColumn("item_no", F.xxhash64("item_id", "item")))
    windows = cut(benchmark_windows(items, masks))
    small = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    shortest = min(map(len, masks))
    short = [r[0] for r in items.where(F.size("item") < shortest).select(F.size("item")).distinct().collect()]  # fewer numbers than a mask has places
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"), hashed_words(F.col(text_col)).alias("h"))
    held = ["doc_id", "version", "h"] if small else ["doc_id", "version"]
    at = rows.select("doc_id", "version", "h", F.posexplode("h").alias("pos", "w"))
    keys = [_window(F.col("h"), F.col("pos"), m, k) for k, m in enumerate(masks)] + [_window(F.col("h"), F.col("pos"), "1" * n, -n) for n in short]
    at = at.select(*held, "pos", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")
    if small:
        hits = at.join(F.broadcast(windows), "key").join(F.broadcast(items), "item_no")  # no more items than windows
    else:
        # only keys and places are shuffled; texts and items come back for what was hit
        hits = at.join(windows, "key").select("doc_id", "version", "item_no", (F.col("pos") - F.col("at")).alias("pos"), F.lit(0).alias("at")).distinct()
        own = rows.select(F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"), "h").distinct()
        hits = hits.join(own, (F.col("version") == F.col("own_version")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).join(items, "item_no")
    begin = F.col("pos") - F.col("at")
    # the diagonal: from the later of both beginnings to the earlier of both ends
    skip = F.greatest(F.lit(0), -begin)
    n = F.least(F.size("item") - skip, F.size("h") - F.greatest(begin, F.lit(0)))
    # the stage that explodes and joins gives these short pieces, not whole texts: it buffers all rows
    # of a text.  The number keeps the filter behind it out of the join.
    pieces = F.slice("item", skip + 1, n).alias("theirs"), F.slice("h", F.greatest(begin, F.lit(0)) + 1, n).alias("own")
    hits = hits.select("doc_id", "version", "item_no", "item_id", begin.alias("begin"), F.size("item").alias("item_words"), *pieces, F.monotonically_increasing_id().alias("number"))
    # most hits are a few words alike: they go before the shuffle
    same = F.zip_with("theirs", "own", lambda a, b: a == b)
    least = F.ceil(agree * F.least(F.lit(least_words), F.col("item_words")) - 1e-9)
    hits = hits.where((F.col("number") >= 0) & (F.size("own") >= least))
    hits = hits.where(F.size(F.filter(same, lambda x: x)) >= least).withColumn("same", same)
    # the rows of a group are equal: one diagonal of one text and one item
    hits = hits.groupBy("doc_id", "version", "item_no", "item_id", "begin").agg(F.any_value("item_words").alias("item_words"), F.any_value("same").alias("same"))
    hits = hits.withColumn("c", _running("same"))
    hits = hits.withColumn("level", F.transform("c", lambda c, i: c - agree * i))
    low = F.aggregate("level", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.least(x, F.get(a, F.size(a) - 1)))))
    high = F.aggregate(F.reverse("level"), F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.greatest(x, F.get(a, F.size(a) - 1)))))
    hits = hits.withColumn("low", low).withColumn("high", F.reverse(high))
    longest = F.aggregate(F.sequence(F.lit(1), 2 * F.size("c")), F.struct(*[F.lit(0).alias(k) for k in ("i", "j", "b", "e")]), lambda a, _: _longer(a))
    hits = hits.withColumn("l", longest)
    step = F.struct(F.col("l.b").alias("bb"), F.col("l.e").alias("be"), (F.get("c", F.col("l.e")) - F.get("c", F.col("l.b"))).alias("bm"))
    best = hits.select("doc_id", "version", "item_id", "begin", "item_words", step.alias("r"), F.monotonically_increasing_id().alias("number"))  # again, lest the filter repeats all of the above
    found = best.select("doc_id", "version", "item_id", (F.greatest("begin", F.lit(0)) + F.col("r.bb")).alias("start_word"), (F.col("r.be") - F.col("r.bb")).alias("n_words"), F.col("r.bm").alias("n_match"), "item_words", "number")
    enough = (F.col("number") >= 0) & (F.col("n_words") >= F.least(F.lit(least_words), F.col("item_words"))) & (F.col("n_match") >= agree * F.col("n_words"))
    short = F.col("item_words") < WHOLE
    enough = enough & (~short | ((F.col("n_match") == F.col("item_words"))))
    return found.where(enough).select("doc_id", "version", "item_id", *[F.col(c).cast("long").alias(c) for c in ("start_word", "n_words", "n_match")])


def _running(same: str) -> Column:
    """Equal words before each place, and in all."""
    return F.aggregate(same, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + x.cast("int"))))


def _longer(a: Column) -> Column:
    """One step to the longest stretch from b to e whose level doesn't fall: i and j only go up,
    with ``low`` the least level up to i and ``high`` the greatest from j on."""
    fits = F.get("low", a["i"]) <= F.get("high", a["j"]) + 1e-9
    better = fits & (a["j"] - a["i"] > a["e"] - a["b"])
    up = F.coalesce((a["j"] < F.size("c")) & ~fits, F.lit(False))
    return F.struct(
        (a["i"] + up.cast("int")).alias("i"), (a["j"] + F.coalesce(fits, F.lit(False)).cast("int")).alias("j"),
        F.when(better, a["i"]).otherwise(a["b"]).alias("b"), F.when(better, a["j"]).otherwise(a["e"]).alias("e"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, least_words: int = LEAST_WORDS, agree: float = AGREE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs that no item overlaps; all columns stay.

    A row goes for its own text: another text of the same id stays.
    """
    found = _verified(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, least_words, agree, broadcast_windows)
    dirty = cut(found.select(F.col("version").alias("dirty_version")).distinct())
    few = dirty.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dirty) if few else dirty, F.xxhash64(docs[text_col].cast("string")) == dirty["dirty_version"], "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
