"""Outliers by one statistic alone, counts against a plain count, and the estimate against a plain search."""

import re

import numpy as np
from pyspark.sql import functions as F

from crumbtrail.llm import outliers


def test_repetition_alone_makes_an_outlier(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(10**5, 10**6, n)]
    rows = [(i, " ".join(words(200))) for i in range(300)]
    again = words(49)
    # 49 % of the words repeated: short of the base rule.
    rows.append((1000, " ".join(again + words(51) + again + words(51))))
    # 7 of 10 lines are duplicates, with few repeated words.
    rows.append((1001, "\n".join(["w11111"] * 8 + [" ".join(words(96)), " ".join(words(96))])))
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert got[1000].n_repeat_words == 98 and not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001}
    assert all(r.distance2 < 36 for r in got.values())


def test_cutoff_is_the_stated_quantile():
    assert abs(outliers.CUTOFF - 18.4668) < 1e-3


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10**6, "a b c a b c a b"), (10**6 + 1, "x\n\ny\nx\n \nx"), (10**6 + 2, None), (10**6 + 3, "#$ é#| \t\x0b<b>"), (10**6 + 4, "t t t t t")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for r in outliers.counts(docs.withColumn("whole", F.col("text"))).collect():
        text = r.whole or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_least_determinant_is_found(spark):
    """A quarter of correlated outliers does not draw the estimate: as good as many random starts."""
    rng = np.random.default_rng(12)
    n, bad = 600, 140
    good = rng.multivariate_normal(np.zeros(4), np.array([[1, 0.8, 0, 0], [0.8, 1, 0, 0], [0, 0, 1, 0.5], [0, 0, 0.5, 1]]), n)
    far = rng.multivariate_normal([4, -4, 3, 3], 0.05 * np.eye(4), bad)
    x = np.vstack([good, far])
    rows = [("a", *map(float, v)) for v in x] + [("b", *map(float, v * 2 + 1)) for v in good[:80]]
    got = {r.g_: r for r in outliers.mcd(spark.createDataFrame(rows, "g_ string, x0 double, x1 double, x2 double, x3 double")).collect()}
    assert set(got) == {"a", "b"}
    factor = np.zeros((4, 4))
    for i, j in outliers.PAIRS:
        factor[i, j] = got["a"][f"l{i}{j}"]
    floors = np.diag([f**2 for f in outliers.FLOORS.values()])
    k, least = int(0.75 * len(x)), np.inf
    for _ in range(60):
        own = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(30):
            mean, cov = own.mean(0), np.cov(own.T, bias=True) + 1e-6 * np.eye(4)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d)[:k]]
        least = min(least, np.linalg.det(np.cov(own.T, bias=True) * outliers._consistency(0.75) + floors))
    assert np.linalg.det(factor @ factor.T) < 1.1 * least
    assert np.abs([got["a"][f"m{i}"] for i in range(4)]).max() < 0.25


def test_small_groups_are_judged_by_their_language(spark):
    rng = np.random.default_rng(4)
    word = {"en": "abcdefgh", "de": "abcdefghijklmnopqrst"}
    rows = [(i, " ".join(word[g] + str(rng.integers(0, 10**6)) for _ in range(100)), g, f"s{i % 30}") for i, g in enumerate(["en", "de"] * 120)]
    rows.append((1000, " ".join(word["de"] + str(x) for x in range(100, 200)), "en", "s1"))
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {1000}
    few = outliers.judge(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string")).collect()
    assert all(r.distance2 is None and r.kept for r in few)
