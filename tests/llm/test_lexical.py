"""Ranked lexical search against brute force, and what sharing saves."""

import math
import random
import re
from collections import Counter

import numpy as np

from ensspark.llm import op13_lexical as lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=20):
    """(item, rank, doc, score); docs and items are (id, text)."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 75 + (25 * bag.total() * n) // total if bag else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, None if null else doc, -score


def frame(spark, rows, key):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in rows], f"{key} long, text string, q long, score string")


def test_ranking_against_brute_force(corpus):
    rng = random.Random(13)
    vocabulary = [f"{a}{b}" for a in ("Oak", "elm", "é", "日") for b in "abcdefgh123"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    docs = [(rng.randrange(10**12), text(rng.randrange(60))) for _ in range(400)]
    docs += [(None, text(30)), (None, docs[3][1]), (7, None), (8, ""), (9, " .,"), (docs[0][0], docs[0][1])] + [(100 + i, docs[5][1]) for i in range(40)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(60)] + [(61, None), (62, "..."), (63, "absent words"), (None, "Oaka oaka"), (5, text(400))]
    want = Counter(brute(docs, items))
    small = lexical.ranked(frame(corpus, docs, "doc_id").repartition(5), frame(corpus, items, "item_id"), scan_terms=300, block_terms=70, chunk_bytes=9000)
    whole = lexical.ranked(frame(corpus, docs, "doc_id"), frame(corpus, items, "item_id"))
    assert Counter(map(tuple, small.collect())) == want == Counter(map(tuple, whole.collect()))


def test_long_texts_span_chunks(corpus):
    docs = [(1, "alpha beta " * 150_000 + "gamma"), (2, "gamma"), (3, "delta")]
    items = [(1, "alpha gamma"), (2, "x" * 3_000_000)]
    got = lexical.ranked(frame(corpus, docs, "doc_id"), frame(corpus, items, "item_id")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(docs, items))


def test_no_rows(corpus):
    docs, items = frame(corpus, [(1, "a b")], "doc_id"), frame(corpus, [(1, "a")], "item_id")
    assert lexical.ranked(docs.limit(0), items).collect() == [] == lexical.ranked(docs, items.limit(0)).collect()
    assert lexical.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_sets_are_added_up_once():
    rng = np.random.default_rng(3)
    phrases = [np.sort(rng.choice(5000, 12, replace=False)) for _ in range(8)]
    block = []
    for q in range(100):
        own = np.unique(np.concatenate([phrases[q % 8], phrases[(q // 8) % 8], rng.choice(5000, 3)]))
        block.append((q, own, np.ones(len(own), np.int64) + (own % 2)))
    graph = lexical.mined(block)
    assert graph.additions() < 0.35 * sum(len(t) - 1 for _, t, _ in block)
    weights = rng.integers(0, 1000, 5000)
    sums = (weights[graph.terms] * graph.times).tolist()
    for members in graph.sets:
        assert members.max() < len(sums)  # only what is there already
        sums.append(sum(sums[i] for i in members))
    for (q, members), (number, own, times) in zip(graph.items, block, strict=True):
        assert q == number and sum(sums[i] for i in members) == int((weights[own] * times).sum())
