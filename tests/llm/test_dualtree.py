"""The search against a plain one, whatever the shape of the trees; ties, repeats, nulls, long and empty texts."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crumbtrail.llm import dualtree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k):
    """docs and items: (id, text). Rows (item, rank, doc, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            weight = lambda w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
            score = sum(weight(w) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((score, doc))
        found.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, r + 1, doc, score) for r, (score, doc) in enumerate(found[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(80)] + ["É", "éa", "A_b", "x-Y", "Zz"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(700)]
    docs += [(1000 + i % 40, docs[3][1]) for i in range(300)]  # copies, ids that repeat
    docs += [(None, docs[3][1]), (None, "w1 w2"), (2000, None), (2001, ""), (2002, " .\n"), (2003, "w3 " * 200000 + "W4")]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(90)]
    items += [(5, "w1 w1 W2"), (5, "w1 w1 W2"), (200, None), (201, "absent"), (None, "w9")]
    return docs, items


@pytest.mark.parametrize("k, item_terms", [(50, 1 << 18), (7, 150)])
def test_equals_plain_search(spark, corpus, k, item_terms):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit("x"), "own": F.lit(1), "no": F.lit(2), "score": F.lit(0.5)}).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "id": F.lit(1), "no": F.lit(2)})
    assert rows(dualtree.search(d, i, k=k, item_terms=item_terms)) == plain(docs, items, k)


def test_pairs_are_pruned(corpus):
    """Documents on one theme each: most pairs are never scored, and what is left is exact."""
    rng = np.random.default_rng(6)
    items = pd.DataFrame([(i, 100 * (i // 8) + t, 5 + int(rng.integers(9))) for i in range(64) for t in rng.choice(100, 12, replace=False)], columns=["no", "term", "w"])
    tree = dualtree.ItemTree(items)
    at_work = dualtree._Searcher(tree, np.zeros(len(tree.numbers), np.int64), 5)
    kept = {}
    for batch in range(6):
        own = [np.unique(100 * theme + rng.integers(0, 100, 30)) for theme in np.sort(rng.integers(0, 8, 1024))]
        lengths = np.array([len(x) for x in own])
        tree_ = dualtree.DocTree(tree.vocabulary, lengths, np.concatenate(own), np.ones(lengths.sum(), np.int64), np.full(1024, 100))
        ids = np.arange(batch * 1024, (batch + 1) * 1024)
        at_work.search(tree_, ids, np.zeros(1024, bool))
        kept |= {int(d): set(x.tolist()) for d, x in zip(ids, own)}
    assert at_work.scored < 0.4 * at_work.pairs
    share = 10**9 // (1000 + 2000)
    got = sorted(zip(tree.numbers[at_work.held[0]].tolist(), (-at_work.held[1]).tolist(), at_work.held[2].tolist()))
    want = []
    for no, own in items.groupby("no"):
        w = dict(zip(own.term, own.w))
        scores = sorted((-share * sum(v for t, v in w.items() if t in d), i) for i, d in kept.items())
        want += [(no, s, i) for s, i in scores[:5] if s < 0]
    assert got == sorted(want)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(x[:20], f"{n} long, text string") for x, n in zip(corpus, ("doc_id", "item_id")))
    assert dualtree.search(docs.where("false"), items).collect() == []
    assert dualtree.search(docs, items.where("false")).collect() == []
