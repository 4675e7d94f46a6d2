"""Roots and proofs against a plain fold; block sizes and fan-outs change nothing that they should not."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from crumbtrail.llm import manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold(nodes, fanout):
    """The root, and for each node its proof: (left, right) by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(proofs):
            a = at[i] // fanout * fanout
            run = level[a : a + fanout]
            p.append(("".join(run[: at[i] - a]), "".join(run[at[i] - a + 1 :])))
            at[i] //= fanout
        level = [H("".join(level[a : a + fanout])) for a in range(0, len(level), fanout)]
    return level[0], proofs


def plain(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    folds = {g: fold([x[2] for x in sorted(groups[g])], fanout) for g in langs}
    root, up = fold([folds[g][0] for g in langs], fanout)
    out = []
    for g, above in zip(langs, up):
        for (_, _, own, doc), proof in zip(sorted(groups[g]), folds[g][1]):
            out.append((doc, own, folds[g][0], root, [tuple(x) for x in proof + above]))
    return sorted(out, key=str)


def proved(df, **how):
    leaves = df.select("lang", "doc_id", manifest.leaf([F.col(c) for c in manifest.FIELDS]).alias("leaf"), F.lit("x").alias("path"), F.lit("y").alias("h"))
    got = manifest.manifest(leaves.drop("path"), **how).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(x.left, x.right) for x in r.path]) for r in got), key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i % 3}", ["en", "de", "é", "zz", None][min(i % 7, 4)], i * 3 if i % 5 else None, None if i % 11 == 0 else f"tëxt {i}" * (i % 4)) for i in range(150)]
    out += [(7, "s", "en", 1, "a"), (7, "s", "en", 1, "a"), (7, "s", "en", 1, "b"), (None, None, None, None, None), (None, None, None, None, None), (10**12, "long", "en", 5, "word " * 200000), (3, "", "only", 0, "")]
    return out


@pytest.mark.parametrize("fanout, levels", [(2, 6), (2, 2), (3, 2), (5, 1)])
def test_equals_plain_fold(spark, rows, fanout, levels):
    assert proved(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout=fanout, levels=levels) == plain(rows, fanout)


@pytest.mark.parametrize("some", [[], [(1, "s", "en", 2, "x")], [(1, "s", None, 2, "x"), (2, "s", "de", 2, "x")]])
def test_few_leaves(spark, some):
    assert proved(spark.createDataFrame(some, SCHEMA)) == (plain(some) if some else [])


def test_tampering_is_found(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = manifest.query(spark, str(tmp_path)).collect()
    want = {(r[0], r[1]): r for r in plain(rows)}
    null_chars = {(r[0], leaf(r)) for r in rows if r[3] is None}
    for r in got:
        _, _, subroot, root, proof = want[(r.doc_id, r.leaf)]
        assert (r.subroot, r.root) == (subroot, root)
        tampered = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 0 and (r.doc_id, r.leaf) not in null_chars
        assert r.verified == (not tampered) == (r.folded_root == root)
    assert sum(not r.verified for r in got) > 5
