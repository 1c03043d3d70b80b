"""SimHash near-duplicates with pigeonring candidate search.

Fingerprints of 64 bits link when they differ in at most ``tau`` bits.  The bits form a ring of
``m`` segments.  By the pigeonring principle two linked fingerprints have a start on the ring from
which every chain of consecutive segments stays within its proportional budget: the first ``l``
segments differ in at most ``l * tau / m`` bits together.  The budgets of a chain's first segments
say which of them must be equal; those sets of equal segments are the join keys.  Pairs that meet
under a key must then pass the chain test, and last the full distance.

Only distinct fingerprints are joined.  Components need connectivity, not pairs, so it comes in
two steps.  First every fingerprint is compared with the pivot of each of a few coarse buckets (linear,
whatever the bucket's size).  Then only fingerprints of different components are compared, exactly
and without limits: in each large bucket all but those of its commonest component against all
others.  Hot buckets are one component after the first step and cost nothing in the second.

``near_duplicates`` links by fingerprints alone; ``similar_components`` and ``keep_one`` hold every
candidate pair's shingles against each other before they link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fresh, release, ship, small, table, union_components

BITS, SEED = 64, 42
#: Stands for a null id.
NULL_ID = -(1 << 63)
#: Rounds of pivots before the exact step, and their keys (segments that must be equal, one at a time).
PIVOTS, FAMILY_KEYS = 1, 4
#: Rounds of pivots where each pair costs a comparison of texts, and fingerprints of 64 bits in a sketch.
FAMILY_PIVOTS, SKETCH = 3, 4
#: Fingerprints that share a key by chance, more or less, and rows from which on a bucket is large.
STRANGERS, LARGE_BUCKET = 64, 512
#: Most nodes whose ids are broadcast when texts are fetched; with more, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 50_000
#: Shingles that a worker keeps of the texts it compared last.
HELD_SHINGLES = 200_000
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)
    return data.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()


def majority_bits(*hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are 1 where over half of all hashes have a 1; 0 without hashes."""
    n, over = 0, np.zeros(BITS, np.int64)
    for all_ in hashes:
        for at in range(0, len(all_), 1 << 16):  # long texts in pieces
            h = all_[at : at + (1 << 16)]
            n += len(h)
            over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * over > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash (as a signed 64-bit number) of the word shingles of a text, repeats included.

    Fewer words than a shingle: the whole sequence is the one shingle; no words (or null): 0.
    """
    words = normal_words(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.uint64(digest(b" ".join(words), SEED)).astype(np.int64))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = (ends[:-1] + 1)[: len(words) - shingle]
    starts, stops = [0, *first.tolist()], ends[shingle - 1 :].tolist()
    view = memoryview(joined)
    pieces = range(0, len(stops), 1 << 16)
    return majority_bits(*(np.array([digest(view[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64) for at in pieces))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (long) for every row."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col).cast("string")).alias("fp"))


def segments(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the m segments, as even as can be."""
    edge = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def key_sets(m: int, tau: int, chain: int) -> list[tuple[int, ...]]:
    """Sets of segments of which every viable chain of ``chain`` segments has at least one all equal.

    A chain is viable if its prefixes keep within budget.  For each start, the patterns of differing
    segments that the budgets allow leave equal segments; the smallest count of them is the size of
    the sets.
    """
    allowed = []
    for r in range(chain + 1):
        for differ in combinations(range(chain), r):
            # at least one bit for each differing segment
            if all(sum(d < l for d in differ) * m <= l * tau for l in range(1, chain + 1)):
                allowed.append([i for i in range(chain) if i not in differ])
    size = min(map(len, allowed))
    picked = {tuple(sorted((s + i) % m for i in equal)) for s in range(m) for equal in allowed if len(equal) == size}
    for s in range(m):  # a pattern with more equal segments holds one of the sets, or brings its own
        for equal in allowed:
            ring = {(s + i) % m for i in equal}
            if not any(ring.issuperset(p) for p in picked):
                picked.add(tuple(sorted(ring)[:size]))
    return sorted(picked)


def _mask(parts: list[tuple[int, int]]) -> int:
    v = sum(((1 << n) - 1) << a for a, n in parts)
    return v - (1 << 64) if v >= 1 << 63 else v


def _chain_test(x: Column, m: int, tau: int) -> Column:
    """Of the bits that differ, x: some start has every prefix of its chain within budget."""
    parts = segments(m)
    # a prefix is left out where the next one has the same budget, which bounds it too
    lengths = [l for l in range(1, m) if l == m - 1 or l * tau // m < (l + 1) * tau // m]
    out = F.lit(False)
    for s in range(m):
        ok = F.lit(True)
        for l in lengths:
            ok = ok & (F.bit_count(x.bitwiseAND(F.lit(_mask([parts[(s + i) % m] for i in range(l)])))) <= l * tau // m)
        out = out | ok
    return out


def ring_for(n: int, tau: int = 4) -> tuple[int, int]:
    """(segments, chain prefix that makes the keys): so many equal segments that no more than some
    ``STRANGERS`` share a key by chance.  Any choice gives the same links."""
    equal = next((z for z in range(2, 7) if n <= STRANGERS * 2 ** (BITS * z / (tau + z))), 7)
    m = tau + equal
    for chain in range(equal, m + 1):
        if len(key_sets(m, tau, chain)[0]) >= equal:
            return m, chain
    return m, m


Check = Callable[[DataFrame], DataFrame]


def components(nodes: DataFrame, tau: int = 4, ring: tuple[int, int] | None = None, check: Check | None = None, wide: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """nodes(node: long, fp: long), distinct -> node, component (a node of its component, the same for all).

    Nodes link when their fingerprints differ in ``tau`` bits at most.  Where ``wide`` is given, there are
    further fingerprints fp2, fp3 and so on, and all together must be within ``wide``.  Where ``check`` is
    given, it must also return the pair: it gets distinct (a, b) and gives back those that link.  Rounds of
    ``pivots`` decide how much is left for the exact step, never the links.
    """
    nodes = cut(nodes)
    m, chain = ring or ring_for(nodes.count(), tau)
    check = check or (lambda edges: edges)
    fps = ["fp"] if wide is None else [c for c in nodes.columns if c.startswith("fp")]
    masks = _masks(key_sets(m, tau, chain), segments(m))
    apart = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    near = apart("fp") <= tau if wide is None else (apart("fp") <= tau) & (sum(map(apart, fps)) <= wide)
    named = lambda x: [F.col(c).alias(f"{c}_{x}") for c in fps]
    xor = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    # a pair that meets under several keys counts under the first of them
    first_key = F.array_position(F.array(*[xor.bitwiseAND(F.lit(v)) == 0 for v in masks]), True) == F.col("k") + 1

    def pairs(met: DataFrame) -> DataFrame:
        # the chain test stays out of the join's own condition, which runs for every two that share a key:
        # the number keeps this filter behind it
        met = met.select("a", "b", xor.alias("x"), F.monotonically_increasing_id().alias("number"))
        met = met.where((F.col("number") >= 0) & _chain_test(F.col("x"), m, tau))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # 1: families.  A few coarse keys; a pivot of each bucket that isn't of one component
    label = nodes.select("node", *fps, F.col("node").alias("component"))
    coarse = _masks([(i,) for i in range(FAMILY_KEYS)], segments(FAMILY_KEYS))
    for r in range(pivots):
        rows = _keyed(label, fps, coarse)
        order = F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.col("node").alias("b"), *named("b"))
        pivot = rows.groupBy("key").agg(F.min(order).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "p.*").drop("h")
        met = rows.select("key", F.col("node").alias("a"), *named("a")).join(pivot, "key").where(near & (F.col("a") != F.col("b")))
        label = _relabel(label, fps, check(pairs(met).distinct()))
    # 2: exactly.  Buckets of a moderate size: all their pairs of different components.  In larger ones that
    # aren't of one component all rows but those of the commonest (estimated by the hash order's first row,
    # any choice is right) meet all rows of other components
    rows = _keyed(label, fps, masks)
    large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_BUCKET).select("key"))
    some = bool(large.limit(1).count())
    left = lambda df: df.select("key", F.col("node").alias("a"), *named("a"), F.col("component").alias("ca"))
    right = lambda df, *more: df.select(F.col("key").alias("key_b"), F.col("node").alias("b"), *named("b"), F.col("component").alias("cb"), "k", *more)
    met = (F.col("key") == F.col("key_b")) & near & (F.col("ca") != F.col("cb")) & first_key
    plain = rows.join(small(large), "key", "left_anti") if some else rows
    edges = pairs(left(plain).join(right(plain), met & (F.col("a") < F.col("b"))))
    if some:
        most = rows.join(small(large), "key")
        main = most.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(pivots)).alias("h"), "component"))["component"].alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "main")
        most = most.join(main, "key")
        other = left(most.where("component <> main"))
        every = right(most, (F.col("component") == F.col("main")).alias("of_main"))
        edges = edges.union(pairs(other.join(every, met & (F.col("of_main") | (F.col("a") < F.col("b"))))))
    return _relabel(label, fps, check(edges.distinct())).select("node", "component")


def _masks(sets: list[tuple[int, ...]], parts: list[tuple[int, int]]) -> list[int]:
    return [_mask([parts[i] for i in s]) for s in sets]


def _keyed(label: DataFrame, fps: list[str], masks: list[int]) -> DataFrame:
    """node, fps, component, k, key: one row for each set of segments (the k-th), key covering the bits under it."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(v))) for k, v in enumerate(masks)])
    return label.select("node", *fps, "component", F.posexplode(keys).alias("k", "key"))


def _relabel(label: DataFrame, fps: list[str], edges: DataFrame) -> DataFrame:
    """Components after adding edges between nodes: the edges are carried over to the present components."""
    to = label.select(F.col("node").alias("a"), F.col("component").alias("x"))
    edges = edges.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = union_components(edges).select(F.col("id").alias("component"), F.col("component").alias("to"))
    label = cut(label.join(joined, "component", "left").select("node", *fps, F.coalesce("to", "component").alias("component")))
    release(label.sparkSession)
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest id reachable over links.

    Copies, repeated rows and all texts without words (null ones too) share a fingerprint and so a
    component.  A null id is never the smallest unless all ids of the component are null; a
    repeated id stands for each of its rows.  Texts of any length are hashed whole.  No rows in: no
    rows out.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    found = components(rows.select(F.col("fp").alias("node"), "fp").distinct(), tau)
    # smallest id of each fingerprint, then of each component: minima only, combined map-side
    # (both kept as tables: a join of plain scans is one that skew handling can split)
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(found.withColumnRenamed("node", "fp"), "fp"))
    named = cut(least.groupBy("component").agg(F.min("least").alias("component_id")))
    by_fp = cut(least.select("fp", "component").join(named, "component").select("fp", "component_id"))
    return rows.join(by_fp, "fp")


def shingle_hashes(text: str | None, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, in order; of all its words if those are fewer.

    Words' hashes are combined, so that a word is hashed once for all its shingles; ``known`` keeps them.
    """
    words = normal_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : j + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes for the k-th fingerprint: themselves for the first."""
    if k == 0:
        return h
    v = h * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64))
    return v ^ (v >> np.uint64(29))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id (NULL_ID for null), version, node (of the words in order: the same for texts of the same words), fp, fp2, ..."""
    names = ["fp", *[f"fp{k}" for k in range(2, SKETCH + 1)]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for pdf in batches:
            out = []
            for t in pdf["text"].tolist():
                h = shingle_hashes(t, shingle, known)
                node = xxhash.xxh64_intdigest(h.tobytes(), len(h))
                out.append((np.uint64(node).astype(np.int64), *[majority_bits(remixed(h, k)) for k in range(SKETCH)]))
            yield pd.concat([pdf[["doc_id", "version"]], pd.DataFrame(out, columns=["node", *names])], axis=1)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInPandas(each, "doc_id long, version long, node long, " + ", ".join(f"{c} long" for c in names))


def alike(docs: DataFrame, rows: DataFrame, edges: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those of the edges (a, b) whose texts have a Jaccard similarity of word shingles of at least ``similarity``.

    Only texts that stand in an edge are fetched, one for each node.
    """
    edges = cut(edges)  # distinct
    release(edges.sparkSession)
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    holders = rows.groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("d")).join(ends, "node", "left_semi")
    holders = cut(holders.select("node", F.col("d.doc_id").alias("h_id"), F.col("d.version").alias("h_version")))
    few = holders.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    text = F.col(text_col).cast("string")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("h_id"), F.xxhash64(text).alias("h_version"), text.alias("text"))
    # repeated rows of an id and a text: one of them will do
    texts = cut(own.join(F.broadcast(holders) if few else holders, ["h_id", "h_version"]).groupBy("node").agg(F.min("text").alias("text")))
    both = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        last: dict[int, np.ndarray] = {}  # a pivot stands in many pairs one after another

        def of(node: int, text: str) -> np.ndarray:
            if node not in last:
                if sum(map(len, last.values())) > HELD_SHINGLES:
                    last.clear()
                last[node] = np.unique(shingle_hashes(text, shingle, known))
            return last[node]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ta"].tolist(), pdf["tb"].tolist(), strict=True):
                x, y = of(a, ta), of(b, tb)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return cut(both.mapInPandas(compare, "a long, b long"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 8, wide: int = 48, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id (NULL_ID for null), version (hash of the text), component of every row.

    Texts link when their fingerprints of ``shingle``-word shingles differ in ``tau`` of 64 bits at most,
    with further ones in ``wide`` of 256, and the shingles' Jaccard similarity is at least
    ``similarity``; texts of the same words always do.  256 bits tell pairs of 0.8 from others well, so
    ``wide`` spares comparisons and costs hardly any link; but a pair of 0.8 differs in some 10 of 64 bits,
    so ``tau`` decides how many of such pairs are seen (the README has figures).  What is linked is never
    less similar.
    """
    bounded_batches(docs.sparkSession)
    rows = cut(sketches(docs, id_col, text_col, shingle))
    found = components(rows.drop("doc_id", "version").distinct(), tau, wide=wide, pivots=FAMILY_PIVOTS, check=lambda edges: alike(docs, rows, edges, id_col, text_col, shingle, similarity))
    return rows.join(found, "node").select("doc_id", "version", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``similar_components``, all columns.

    It is the one of the smallest id (null ids count as the smallest), then of the smallest hash of
    the text; of repeated rows of that id and text one stays.  Rows of a repeated id with other texts
    are rows of their own.
    """
    own, mark, n = fresh("kept_id", docs), fresh("kept_version", docs), fresh("kept_n", docs)
    found = similar_components(docs, id_col, text_col, **options)
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("d")).select(F.col("d.doc_id").alias(own), F.col("d.version").alias(mark))
    order = Window.partitionBy(own, mark).orderBy(*[F.col(c) for c, t in docs.dtypes if t in ("string", "bigint", "int")])
    rows = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    first = rows.join(cut(kept.distinct()), [own, mark], "left_semi").withColumn(n, F.row_number().over(order))
    return first.where(F.col(n) == 1).select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ship(__name__)
