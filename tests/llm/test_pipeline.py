"""The pipeline, stage by stage, against brute force on a small corpus."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_nll, frame, prose
from test_whole_results import brute_overlaps, brute_similar

import corpus_pipeline
from bitloom.llm import mixing, quality, registry, token_files


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    r = random.Random(21)
    items = [prose(r, 30) for _ in range(5)]
    texts, kind = [], []
    for i in range(150):
        t, k = prose(r, r.randint(20, 90)), "clean"
        if i % 10 == 3:
            t, k = "%%% $$$ &&& ### " * 30, "junk"
        elif i % 10 == 5 and texts:
            t, k = texts[i - 5], "copy"
        elif i % 10 == 6:
            t, k = texts[i - 6] + " " + prose(r, 1), "near"
        elif i % 10 == 7:
            t, k = t + " " + items[i % 5], "leak"
        texts.append(t)
        kind.append(k)
    docs = frame(spark, texts, sources=[r.choice("abc") for _ in texts])
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if kind[i] == "junk" else 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, kind


def test_stages(spark, corpus):
    d, texts, kind = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{d}/stage{i}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())

    # 1: everything the classifier keeps, judged by brute-force perplexities
    labels = [i for i in range(0, 150, 2) if kind[i] != "junk"]
    nll = brute_nll(texts, [texts[i] for i in labels])
    middle = sorted(nll[i] for i in labels)[(len(labels) - 1) // 2]
    dev = [(x - middle) * len(t) / (len(t) + quality.SHORT) for x, t in zip(nll, texts, strict=True)]
    low, high = min(dev[i] for i in labels), max(dev[i] for i in labels)
    first = {x.doc_id for x in seen[0]}
    assert first == {i for i in range(150) if low - 1e-5 <= dev[i] <= high + 1e-5}
    assert not any(kind[i] == "junk" for i in first)

    # 2: the smallest id of each component
    ids = sorted(first)
    comp = brute_similar([texts[i] for i in ids], 8, 5, 0.8)
    second = sorted(x.doc_id for x in seen[1])
    assert second == [ids[k] for k in sorted({comp.index(c) for c in comp})] and len(second) < len(first)
    assert not any(kind[i] == "copy" and i - 5 in first for i in second)
    near = [i for i in first if kind[i] == "near" and i - 6 in first]
    assert len(set(near) - set(second)) > len(near) / 2

    # 3: no document that holds an item, all others
    third = {x.doc_id for x in seen[2]}
    assert third == {i for i in second if kind[i] != "leak"}

    # 4: whole copies, at most three, near the budget
    copies = collections.Counter(x.doc_id for x in seen[3])
    assert set(copies) <= third and max(copies.values()) <= 3
    size = {i: len(texts[i].split()) for i in third}
    assert 0 <= sum(size.values()) - sum(size[i] * n for i, n in copies.items()) <= 270

    # 5: the ids of every row of the mix
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(token_files.default_tokenizer()[0]), 0
    for x in sorted(seen[4], key=lambda x: x.start):
        own = np.array([*t.encode(texts[x.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert collections.Counter(x.doc_id for x in seen[4]) == copies

    again = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, seen[4]))


def test_registry():
    assert {q.split("_")[0] for q in registry.queries()} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages_lose_no_odd_rows(spark, tmp_path):
    """Null ids, repeated ids, null texts, repeated rows: each stage against what it should keep of its own input."""
    d, r = str(tmp_path), random.Random(22)
    items = [prose(r, 30) for _ in range(3)]
    texts = [prose(r, r.randint(20, 60)) for _ in range(60)]
    texts += [None, None, "", texts[0], texts[0], texts[1] + " " + items[0], texts[2], texts[3] + " " + items[1]]
    ids = [*[r.choice([None, 5, k]) for k in range(60)], None, 5, 61, 62, 62, 5, None, None]
    docs = frame(spark, texts, ids, sources=[r.choice(["a", "b", None]) for _ in texts])
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = lambda df: collections.Counter((x.doc_id, x.text, x.source) for x in df.collect())
    steps = [f for _, f in corpus_pipeline.STAGES]
    before = rows(docs)

    judged = quality.classify(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()
    assert len(judged) == len(texts)
    kept = steps[0](spark, docs, d)
    assert sum(rows(kept).values()) == sum(x.keep for x in judged) and not rows(kept) - before

    one = rows(steps[1](spark, docs, d))
    comp = brute_similar(texts, 8, 5, 0.8)
    assert max(one.values()) == 1 and sum(one.values()) == len(set(comp)) and not one - before
    of = {(i, t): c for i, t, c in zip(ids, texts, comp, strict=True)}
    assert {of[i, t] for i, t, _ in one} == set(comp)

    clean = rows(steps[2](spark, docs, d))
    dirty = {t for t in texts if brute_overlaps([(0, t)], list(enumerate(items)))}
    assert len(dirty) == 2 and clean == collections.Counter({k: n for k, n in before.items() if k[1] not in dirty})

    mixed = rows(steps[3](spark, docs, d))
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(len((t or "").split()) * n for (_, t, _), n in mixed.items()) == taken
    assert all(n <= 3 * before[k] for k, n in mixed.items())

    found = sorted(steps[4](spark, docs, d).collect(), key=lambda x: x.start)
    assert len(found) == len(texts) and [x.start for x in found] == [0, *np.cumsum([x.n_tokens for x in found])[:-1].tolist()]
    assert [x.doc_id is None for x in found] == sorted((i is None for i in ids), reverse=True)
