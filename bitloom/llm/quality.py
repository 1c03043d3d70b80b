"""Quality classifier: interpolated modified Kneser-Ney trigrams of characters.

Counts come from all trusted text (labelled good and not toxic), at every size of the corpus.
Smoothing is a handful of aggregations over the count table.  The model is cut into shards by a
trigram's middle symbol, which its context, its bigram and their back-off weights share; the
corpus' own trigram counts, packed by chunks of documents, are cut the same way, and the two are
joined shard by shard (salted, so that a common symbol is no hot key).  Each meeting gives the log
probabilities of its documents' trigrams, their sum is the document's, in whole micro-units so
that reruns agree to the last digit.

A document is rejected when its perplexity lies outside of what its language's trusted documents
have, but for a small share at either end: far above (junk, foreign or garbled text) or far below
(a few words repeated).  Thresholds are wider for shorter texts, whose perplexity varies more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, ship, table

#: Symbols: code points below DIRECT (all alphabets of letters) as they are, 0 for white space, and the
#: others (mostly ideographs) in classes.  A symbol takes PLACES bits of a key.
PLACES = 14
BASE, DIRECT = 1 << PLACES, 0x3100
CLASSES = BASE - DIRECT
SYMBOLS = DIRECT + CLASSES
SHARDS, SALTS = 8, 16
#: Characters packed together.
CHUNK = 500_000
#: Most trusted ids that are broadcast; with more, the semi-join shuffles.
BROADCAST_IDS = 1_000_000
#: Share of a language's trusted documents below the upper threshold, and above the lower one.
QUANTILE = 0.999
#: A text of n characters may deviate (SHORT + n) / n times as much from the median as a long one.
SHORT = 150
UNIT = 1e6
#: Stands for a null id.
NULL_ID = -(1 << 63)


def version(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def symbols(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    a = np.where(a < DIRECT, a, DIRECT + a % CLASSES)
    return np.where((a >= 9) & (a <= 13) | (a == 32), 0, a)


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of texts, trigram key) of every character, in chunks; two blanks stand before a text.

    Keys are (a * BASE + b) * BASE + c for the symbols a, b, c.  Long texts go through in pieces.
    """
    rows: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(texts):
        before = np.zeros(2, np.int64)
        for at in range(0, len(text), CHUNK):
            s = np.concatenate([before, symbols(text[at : at + CHUNK])])
            before = s[-2:]
            keys.append((s[:-2] * BASE + s[1:-1]) * BASE + s[2:])
            rows.append(np.full(len(s) - 2, i, np.int64))
            held += len(s) - 2
            if held >= CHUNK:
                yield np.concatenate(rows), np.concatenate(keys)
                rows, keys, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(keys)


def trigram_counts(texts: DataFrame) -> DataFrame:
    """texts(text) -> key, n over all of them; each task adds up its own before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            for _, keys in chunks([t for t in pdf["text"].tolist() if t]):
                u, n = np.unique(keys, return_counts=True)
                all_keys = np.concatenate([total[0], u])
                u, place = np.unique(all_keys, return_inverse=True)
                total = u, np.bincount(place, np.concatenate([total[1], n])).astype(np.int64)
                if len(u) > 2_000_000:
                    yield pd.DataFrame({"key": total[0], "n": total[1]})
                    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pd.DataFrame({"key": total[0], "n": total[1]})

    return texts.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, n: str) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (Chen and Goodman's estimates)."""
    c = counts.agg(*[F.count_if(F.col(n) == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    if not all(c):
        return [0.5, 0.75, 0.9]
    y = c[0] / (c[0] + 2 * c[1])
    d = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _smoothed(counts: DataFrame, n: str, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counts with the discounted share ``alpha``, context with the weight ``gamma`` left for lower orders)."""
    d = _discounts(counts, n)
    off = F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])
    by = counts.groupBy(*context).agg(F.sum(n).alias("total"), F.count_if(F.col(n) == 1).alias("k1"), F.count_if(F.col(n) == 2).alias("k2"), F.count_if(F.col(n) > 2).alias("k3"))
    by = cut(by.select(*context, "total", ((F.col("k1") * d[0] + F.col("k2") * d[1] + F.col("k3") * d[2]) / F.col("total")).alias("gamma")))
    joined = counts.join(by, context) if context else counts.crossJoin(F.broadcast(by))  # a single row
    return joined.withColumn("alpha", (F.col(n) - off) / F.col("total")), by


def train(counts: DataFrame) -> DataFrame:
    """counts(key, n) -> shard, kind, key, value: log probabilities and log back-off weights.

    kind 3: trigrams seen, 2: bigrams seen, 1: symbols (in every shard), -3: weight after two
    symbols, -2: weight after one.  Nothing is cut off or sampled.
    """
    counts = cut(counts.select("key", "n", F.shiftright("key", 2 * PLACES).alias("a"), F.shiftright("key", PLACES).bitwiseAND(F.lit(BASE - 1)).alias("b"), F.col("key").bitwiseAND(F.lit(BASE - 1)).alias("c")))
    tri, ctx3 = _smoothed(counts, "n", ["a", "b"])
    pairs = cut(counts.groupBy("b", "c").agg(F.count(F.lit(1)).alias("m")))
    bi, ctx2 = _smoothed(pairs, "m", ["b"])
    single = cut(pairs.groupBy("c").agg(F.count(F.lit(1)).alias("m")))
    uni, ctx1 = _smoothed(single.withColumn("all", F.lit(0)), "m", ["all"])
    uni = cut(uni.select("c", (F.col("alpha") + F.col("gamma") / SYMBOLS).alias("p1")))
    bi = cut(bi.join(uni, "c").select("b", "c", (F.col("alpha") + F.col("gamma") * F.col("p1")).alias("p2")))
    tri = tri.join(bi, ["b", "c"]).select("b", "key", (F.col("alpha") + F.col("gamma") * F.col("p2")).alias("p3"))
    shard = F.pmod(F.xxhash64("b"), F.lit(SHARDS)).cast("int").alias("shard")
    kinds = [
        tri.select(shard, F.lit(3).alias("kind"), "key", F.log("p3").alias("value")),
        ctx3.select(shard, F.lit(-3).alias("kind"), (F.col("a") * BASE + F.col("b")).alias("key"), F.log("gamma").alias("value")),
        bi.select(shard, F.lit(2).alias("kind"), (F.col("b") * BASE + F.col("c")).alias("key"), F.log("p2").alias("value")),
        ctx2.select(shard, F.lit(-2).alias("kind"), F.col("b").alias("key"), F.log("gamma").alias("value")),
        uni.select(F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("c").alias("key"), F.log("p1").alias("value")),
        ctx1.select(F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("key"), F.log(F.col("gamma") / SYMBOLS).alias("value")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return cut(out)


def _shard_of() -> np.ndarray:
    """Shard of each middle symbol, by the same hash as in the model table."""
    import xxhash

    h = [xxhash.xxh64_intdigest(np.int64(b).tobytes(), 42) for b in range(BASE)]
    return np.array([np.uint64(x).astype(np.int64) % SHARDS for x in h], np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte: neighbouring high bytes are equal and compress well."""
    planes = [np.diff(c.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return [np.cumsum(np.ascontiguousarray(raw[4 * n * i : 4 * n * (i + 1)].reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32) for i in range(columns)]


def salts(spark: SparkSession) -> int:
    """Copies of each shard: about one (shard, copy) for each shuffle partition, so that the parts
    of the corpus that meet a copy don't grow with the corpus."""
    return min(4096, max(SALTS, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)))


def profiles(docs: DataFrame) -> DataFrame:
    """docs(doc_id, version, lang, text) -> shard, salt, ids, n, packed: trigram counts of chunks of
    documents, shard by shard, and as shard -1 each row's (doc_id, version) with its language."""
    shard_of, copies = _shard_of(), salts(docs.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        number = 0
        for pdf in batches:
            ids = pdf[["doc_id", "version"]].to_numpy(np.int64)
            langs = [x if isinstance(x, str) else None for x in pdf["lang"].tolist()]
            yield pd.DataFrame({"shard": [-1], "salt": [0], "ids": [ids.tobytes()], "n": [0], "packed": [pickle.dumps(langs)]})
            for rows, keys in chunks([t if isinstance(t, str) else "" for t in pdf["text"].tolist()]):
                both, n = np.unique(rows << 3 * PLACES | keys, return_counts=True)
                row, key = both >> 3 * PLACES, both & ((1 << 3 * PLACES) - 1)
                shard = shard_of[(key >> PLACES) & (BASE - 1)]
                number += 1
                out = []
                for s in range(SHARDS):
                    own = np.flatnonzero(shard == s)
                    if len(own):
                        here, place = np.unique(row[own], return_inverse=True)
                        out.append((s, int(ids[here[0], 1] + number) % copies, ids[here].tobytes(), len(own), _pack(place, key[own] >> PLACES, key[own] & (BASE - 1), n[own])))
                yield pd.DataFrame(out, columns=["shard", "salt", "ids", "n", "packed"])

    return docs.mapInPandas(pack, "shard int, salt int, ids binary, n long, packed binary")


def _packed_model(model: DataFrame) -> DataFrame:
    """shard, salt, model: each shard as one row, its tables sorted by key, a copy for every salt."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        tables = {}
        for kind, part in pdf.groupby("kind"):
            part = part.sort_values("key")
            tables[int(kind)] = (part["key"].to_numpy(np.int64), part["value"].to_numpy(np.float64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "model": [pickle.dumps(tables)]})

    rows = model.groupBy("shard").applyInPandas(pack, "shard int, model binary")
    return cut(rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts(model.sparkSession) - 1))).alias("salt"), "model"))


def log_probabilities(tables: dict[int, tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """log p of trigram keys under one shard's tables, backing off where a trigram or bigram is unseen."""

    def get(kind: int, k: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        have, value = tables.get(kind, (np.zeros(1, np.int64) - 1, np.zeros(1)))
        i = np.minimum(np.searchsorted(have, k), len(have) - 1)
        hit = have[i] == k
        return np.where(hit, value[i], default), hit

    keys, place = np.unique(keys, return_inverse=True)
    out, seen = get(3, keys, 0.0)
    rest = keys[~seen]
    floor = float(tables[-1][1][0])
    p1, _ = get(1, rest & (BASE - 1), floor)
    p2, pair = get(2, rest & (BASE * BASE - 1), 0.0)
    low = np.where(pair, p2, get(-2, (rest >> PLACES) & (BASE - 1), 0.0)[0] + p1)
    out[~seen] = get(-3, rest >> PLACES, 0.0)[0] + low
    return out[place]


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, trusted, n (characters), nll (mean negative log probability, null without text).

    One row per input row.  ``trusted``: doc_id of the documents the model learns from, all of them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = cut(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(trigram_counts(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")))
    packed = _packed_model(model)

    # (doc_id, version) stands for a row wherever it goes: ids may repeat
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), version(F.col(text_col)).alias("version"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    met = profiles(keyed).join(packed, ["shard", "salt"], "left")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64).reshape(-1, 2)
                if r.shard == -1:
                    ll, n, copies, lang = 0, 0, 1, pickle.loads(r.packed)
                else:
                    place, context, symbol, n = _unpacked(r.packed, r.n, 4)
                    key = context.astype(np.int64) << PLACES | symbol
                    lp = log_probabilities(pickle.loads(r.model), key) if r.model is not None else np.zeros(len(key))
                    ll = np.bincount(place, np.rint(lp * UNIT) * n, len(ids)).astype(np.int64)
                    n, copies, lang = np.bincount(place, n, len(ids)).astype(np.int64), 0, None
                yield pd.DataFrame({"doc_id": ids[:, 0], "version": ids[:, 1], "ll": ll, "n": n, "copies": copies, "lang": lang})

    sums = met.select("shard", "ids", "n", "packed", "model").mapInPandas(score, "doc_id long, version long, ll long, n long, copies long, lang string")
    sums = sums.groupBy("doc_id", "version").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.min("lang").alias("lang"))
    # repeated rows were added up together; each gets its part back
    sums = sums.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "version", "lang", F.expr("n div copies").alias("n"), F.try_divide(-F.col("ll") / UNIT, F.col("n")).alias("nll"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    flags = ids.withColumn("trusted", F.lit(True))
    out = sums.join(F.broadcast(flags) if few else flags, "doc_id", "left")
    return out.select("doc_id", "version", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "n", "nll")


def verdicts(scored: DataFrame, quantile: float = QUANTILE, short: float = SHORT) -> DataFrame:
    """+ perplexity, lowest, threshold, keep: whether lowest <= perplexity <= threshold.

    Per language, deviations of trusted documents' mean log probability from its median, times n /
    (n + short) for n characters, have a quantile at either end.  The thresholds for a text of n
    characters are what lies at those, times (n + short) / n.  A language without any trusted
    document goes by the quantiles of all.  Documents without text are kept, and so is everything
    where nothing is trusted.
    """
    scored = cut(scored)
    good = scored.where("trusted AND nll IS NOT NULL")
    every = F.lit(None).cast("string")
    # a language's documents, and under null those of all languages; a document without one is under 'of all' only
    both = good.where("lang IS NOT NULL").select("lang", "nll", "n").union(good.select(every, "nll", "n"))
    exact = 100_000
    mid = cut(both.groupBy("lang").agg(F.percentile_approx("nll", 0.5, exact).alias("mid")).withColumnRenamed("lang", "of"))
    small = mid.limit(10_001).count() <= 10_000
    hint = F.broadcast if small else (lambda df: df)
    dev = (F.col("nll") - F.col("mid")) * F.col("n") / (F.col("n") + short)
    ends = F.percentile_approx(dev, F.array(F.lit(1 - quantile), F.lit(quantile)), exact)
    edge = both.join(hint(mid), F.col("lang").eqNullSafe(F.col("of"))).groupBy("of", "mid").agg(ends.alias("ends"))
    edge = cut(edge.select("of", "mid", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")))
    overall = edge.where("of IS NULL").first()
    nothing = F.lit(None).cast("double")
    if overall is None:
        return scored.select("*", F.exp("nll").alias("perplexity"), nothing.alias("lowest"), nothing.alias("threshold"), F.lit(True).alias("keep"))
    out = scored.join(hint(edge.where("of IS NOT NULL")), F.col("lang") == F.col("of"), "left")
    wide = F.try_divide(F.col("n") + short, F.col("n"))
    at = lambda end: F.coalesce("mid", F.lit(overall["mid"])) + F.coalesce(end, F.lit(overall[end])) * wide
    keep = F.coalesce((F.col("nll") <= at("high") + 1e-9) & (F.col("nll") >= at("low") - 1e-9), F.lit(True))
    return out.select(*scored.columns, F.exp("nll").alias("perplexity"), F.exp(at("low")).alias("lowest"), F.exp(at("high")).alias("threshold"), keep.alias("keep"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic, and by no row otherwise."""
    fine = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    return labels.groupBy("doc_id").agg(F.min(fine).alias("fine")).where("fine").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """doc_id, version, lang, trusted, n, nll, perplexity, lowest, threshold, keep for every row of docs.

    Repeated rows are judged each, alike; rows of one id and other texts by their own text.  Null and
    empty texts have no perplexity and are kept.  Texts are scored whole, whatever their length.
    Extra columns are ignored; no rows in, no rows out.
    """
    return verdicts(perplexities(docs, trusted_ids(labels), **columns))


def filter_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    found = classify(docs, labels, id_col=id_col, text_col=text_col, **columns)
    bad = cut(found.where("NOT keep").select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct())
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # a null-safe comparison would rule out a plain hash key; null ids stand as NULL_ID on both sides
    mine = F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID))
    bad = bad.withColumn("bad_id", F.coalesce("bad_id", F.lit(NULL_ID)))
    bad = F.broadcast(bad) if few else bad
    return docs.join(bad, (mine == bad["bad_id"]) & (version(docs[text_col]) == bad["bad_version"]), "left_anti")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.where("keep").select("doc_id", "lang", "n", "perplexity", "lowest", "threshold", "keep")


ship(__name__)
