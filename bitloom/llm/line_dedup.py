"""Line deduplication by pairwise alignment.

A document is a sequence of line hashes.  Groups of consecutive lines, the fewest that reach the
words of a deleted block from each line on and back from each line, bring documents together: each
later holder of a group is paired with the group's first holder, however many documents hold it.
Every line of a repeated block lies in a group within it, so every later occurrence has an
earlier document it repeats as partner.  Each pair is aligned with patience diff (lines unique on
both sides, longest increasing run, recursion between), and blocks of consecutive aligned lines
that are long enough are deleted from the later document.  What the alignment leaves (lines that
are unique on neither side, further or moved occurrences) goes by the pair's common groups.

The first holder of a group is never the later one for it, so one occurrence of everything stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, ship, table

#: Fewest words of an aligned block that is deleted.
BLOCK_WORDS = 8
#: Base of the groups' hashes.
ODD = 0x9E3779B97F4A7C15


def matching_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Patience diff of two sequences: (start in a, start in b, length), in order, not adjoining."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i >= j or k >= m:
            continue
        where_a: dict[int, int] = {}
        for x in range(i, j):
            where_a[a[x]] = -1 if a[x] in where_a else x
        where_b: dict[int, int] = {}
        for x in range(k, m):
            where_b[b[x]] = -1 if b[x] in where_b else x
        both = [(x, where_b[h]) for h, x in where_a.items() if x >= 0 and where_b.get(h, -1) >= 0]
        if not both:
            continue
        both.sort()
        tails: list[int] = []  # longest increasing run of the places in b
        last: list[int] = []
        before = [-1] * len(both)
        for n, (_, y) in enumerate(both):
            at = bisect_left(tails, y)
            if at == len(tails):
                tails.append(y)
                last.append(n)
            else:
                tails[at] = y
                last[at] = n
            before[n] = last[at - 1] if at else -1
        run, n = [], last[-1]
        while n >= 0:
            run.append(both[n])
            n = before[n]
        run.reverse()
        pairs += run
        for (x0, y0), (x1, y1) in zip([(i - 1, k - 1), *run], [*run, (j, m)], strict=True):
            if x0 + 1 < x1 and y0 + 1 < y1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    out: list[tuple[int, int, int]] = []
    for x, y in sorted(pairs):
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((x, y, 1))
    return out


def groups(words: np.ndarray, edges: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line behind the last) of the shortest groups of block_words from each line on and back from each.

    ``words``: of the lines of several documents, one after another; ``edges``: where each begins, and the end.
    Groups begin and end with lines that have words.
    """
    before = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero(words > 0)
    doc = np.searchsorted(edges, at, "right")
    stop = np.searchsorted(before, before[at] + block_words)
    start = np.searchsorted(before, before[at + 1] - block_words, "right") - 1
    on, back = stop <= edges[np.minimum(doc, len(edges) - 1)], start >= edges[doc - 1]
    both = np.unique(np.concatenate([np.column_stack([at, stop])[on], np.column_stack([start, at + 1])[back]]), axis=0)
    return both[:, 0], both[:, 1]


def repeated_blocks(a: list[int], a_words: np.ndarray, b: list[int], b_words: np.ndarray, block_words: int) -> list[tuple[int, int, int]]:
    """Blocks of a that stand in b, (start in a, start in b, length): those of the alignment, then those
    that the groups of both find for the lines left.  The blocks cover every line of a that lies in
    a run of block_words or more that stands in b."""
    before = np.concatenate([[0], np.cumsum(a_words)])
    out = [(x, y, n) for x, y, n in matching_blocks(a, b) if before[x + n] - before[x] >= block_words]
    gone = np.zeros(len(a), bool)
    for x, _, n in out:
        gone[x : x + n] = True
    if gone.all():
        return out
    first: dict[tuple[int, ...], int] = {}
    for s, e in zip(*(g.tolist() for g in groups(b_words, np.array([0, len(b)]), block_words)), strict=True):
        first.setdefault(tuple(b[s:e]), s)
    more: list[tuple[int, int, int]] = []
    for s, e in zip(*(g.tolist() for g in groups(a_words, np.array([0, len(a)]), block_words)), strict=True):
        if not gone[s:e].all() and (y := first.get(tuple(a[s:e]))) is not None:
            if more and more[-1][0] - more[-1][1] == s - y and s <= more[-1][0] + more[-1][2]:
                x, z, n = more.pop()
                more.append((x, z, max(n, e - x)))
            else:
                more.append((s, y, e - s))
    return out + more


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (hash of the text, for repeated ids), hs (line hashes), ws (words of each line)."""
    text = F.col(text_col).cast("string")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\t\r]", " ")))
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), lines.alias("lines"))
    return rows.select("doc_id", "version", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("ws"))


def duplicate_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, version, blocks: array of (start, n, partner, partner_start), lines from 0; documents with blocks only.

    Of two documents the one with the greater (id, version) is the later one.
    """
    seqs = cut(sequences(docs, id_col, text_col).distinct())

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs, ws = (np.concatenate([np.zeros(0, np.int64), *pdf[c]]).astype(np.int64) for c in ("hs", "ws"))
            edges = np.concatenate([[0], np.cumsum([len(x) for x in pdf["hs"]])]).astype(np.int64)
            start, stop = groups(ws, edges, block_words)
            # sums of hashes times powers of an odd number, brought back to the group's start: equal groups
            # have equal keys, others hardly ever (they would only be compared in vain)
            power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(hs), x, np.uint64)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hs.view(np.uint64) * power(ODD)[:-1])])
            key = (sums[stop] - sums[start]) * power(pow(ODD, -1, 1 << 64))[start]
            doc = np.searchsorted(edges, start, "right") - 1
            one = pd.DataFrame({"doc": doc, "h": key.view(np.int64)}).drop_duplicates()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[one["doc"]], "version": pdf["version"].to_numpy()[one["doc"]], "h": one["h"]})

    each = cut(seqs.mapInPandas(keys, "doc_id long, version long, h long")).select(F.struct("doc_id", "version").alias("d"), "h")
    held = each.groupBy("h").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n"))
    held = cut(held.where("n > 1").select("h", "first"))
    pairs = each.join(held, "h").where(F.col("d") != F.col("first")).select(F.col("d.doc_id").alias("doc_id"), F.col("d.version").alias("version"), F.col("first.doc_id").alias("p_id"), F.col("first.version").alias("p_version")).distinct()
    pairs = cut(pairs)
    a = pairs.join(seqs, ["doc_id", "version"])
    b = seqs.select(F.col("doc_id").alias("p_id"), F.col("version").alias("p_version"), F.col("hs").alias("p_hs"), F.col("ws").alias("p_ws"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for x, y, n in repeated_blocks(r.hs.tolist(), r.ws, r.p_hs.tolist(), r.p_ws, block_words):
                    out.append((r.doc_id, r.version, x, n, r.p_id, y))
            yield pd.DataFrame(out, columns=["doc_id", "version", "start", "n", "partner", "partner_start"])

    found = a.join(b, ["p_id", "p_version"]).mapInPandas(align, "doc_id long, version long, start int, n int, partner long, partner_start int")
    return found.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "n", "partner", "partner_start"))).alias("blocks"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines, n_deleted, blocks, partners: one row per input row.

    Null ids and null texts are left as they are and deleted from by nobody.  Lines are compared
    without white space at their ends; empty lines are deleted within blocks only.  A document of
    which every line goes has an empty text.  Texts of one id go by (id, hash of the text); rows of
    equal id and text are one document, all treated alike.  Very long texts are sequences like any
    others.  Extra columns, whatever their names, are ignored.  No rows in: no rows out.
    """
    blocks = duplicate_blocks(docs, id_col, text_col, **options)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    both = rows.join(blocks, ["doc_id", "version"], "left")
    lines = F.split("text", "\n")
    gone = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.sequence(b["start"], b["start"] + b["n"] - 1))))
    both = both.withColumn("gone", gone)
    # a difference of sets of places: by hashing, in proportion to the lines
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return both.select(
        "doc_id",
        F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("blocks", F.array().cast("array<struct<start:int,n:int,partner:bigint,partner_start:int>>")).alias("blocks"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["partner"]))), F.array().cast("array<bigint>")).alias("partners"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ship(__name__)
