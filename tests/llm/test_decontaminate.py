"""Decontamination against plain dynamic programming."""

import random

from crumbtrail.llm import decontaminate


def distance(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (p != t)))
    return min(row)


def test_myers():
    rng = random.Random(2)
    for _ in range(400):
        pattern = [rng.randrange(4) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(5) for _ in range(rng.randrange(0, 80))]
        best, end = decontaminate.myers(pattern, text)
        assert best == distance(pattern, text)
        assert distance(pattern, text[:end]) == best and (not end or distance(pattern, text[: end - 1]) > best)


def test_all_items_and_documents(spark):
    rng = random.Random(5)
    items = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 20, 31]))] for _ in range(40)]
    items[7] = items[3]
    docs = []
    for _ in range(120):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            own = list(rng.choice(items))
            for _ in range(rng.randrange(0, max(1, len(own) // 4) + 1)):
                kind, at = rng.randrange(3), rng.randrange(len(own) + 1)
                own[at : at + (kind > 0)] = [f"v{rng.randrange(9)}"] if kind < 2 else []
            words[rng.randrange(len(words) + 1) : 0] = own
        docs.append(words)
    docs[5] = docs[4]
    docs.append([f"x{i}" for i in range(5000)] + items[9] + [f"y{i}" for i in range(5000)])
    rows = spark.createDataFrame([(i, " ".join(d).upper() if i % 2 else ", ".join(d), "clash") for i, d in enumerate(docs)], "doc_id long, text string, distance string")
    wanted = spark.createDataFrame([(i, " ".join(x), 0) for i, x in enumerate(items)], "item_id long, text string, doc_id int")
    want = set()
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            if (n := distance(x, d)) <= len(x) // 5:
                want.add((i, j, n))
    got = decontaminate.find_items(rows, wanted, block_chars=900).collect()
    assert len(got) == len(want) and {(r.doc_id, r.item_id, r.distance) for r in got} == want
    for r in got:
        assert distance(items[r.item_id], docs[r.doc_id][r.start_word : r.end_word]) == r.distance
