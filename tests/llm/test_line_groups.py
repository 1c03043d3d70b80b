"""Blocks of short, common and repeated lines, against brute force."""

import random

from test_text_operators import frame

from bitloom.llm import line_dedup


def brute(docs, block_words):
    """Lines of each document that lie in a run of enough words that stands in an earlier document."""
    out = []
    for d, a in enumerate(docs):
        runs = {tuple(b[s:e]) for b in docs[:d] for s in range(len(b)) for e in range(s + 1, len(b) + 1)}
        gone = set()
        for s in range(len(a)):
            for e in range(s + 1, len(a) + 1):
                if sum(len(x.split()) for x in a[s:e]) >= block_words and tuple(a[s:e]) in runs and a[s] and a[e - 1]:
                    gone.update(range(s, e))
        out.append(gone)
    return out


def held(spark, docs):
    out = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, ["\n".join(d) for d in docs])).collect()}
    return [{i for b in out[k].blocks for i in range(b["start"], b["start"] + b["n"])} for k in range(len(docs))]


def test_common_short_lines(spark):
    passage = ["three short words", "and three more", "then the rest"]
    docs = [[f"own {k} line here", *passage, f"last {k}"] for k in range(40)]
    assert held(spark, docs) == [set(), *[{1, 2, 3}] * 39]


def test_passage_twice(spark):
    p = ["three short words", "and three more", "then the rest"]
    docs = [["a first", *p, "b second"], ["c third", *p, "d fourth", *p, "e fifth", p[1]]]
    assert held(spark, docs) == [set(), {1, 2, 3, 5, 6, 7}]


def test_random_lines_against_brute_force(spark):
    r = random.Random(15)
    lines = ["a b c", "d e", "f", "g h i j k l m n", "o p q r", "s t u v w", ""]
    docs = [[r.choice(lines) for _ in range(r.randint(0, 9))] for _ in range(80)]
    got = held(spark, [d + [f"end {k}"] for k, d in enumerate(docs)])
    want = brute(docs, 8)
    assert sum(map(len, want)) > 50
    for g, w, d in zip(got, want, docs, strict=True):
        assert w <= g and all(not d[i] for i in g - w)  # empty lines at a block's ends may go along
