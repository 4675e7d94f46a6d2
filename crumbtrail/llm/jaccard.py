"""Near-duplicate join on the Jaccard similarity of word n-grams.

Texts with the same set of n-grams are one class from the start. MinHash bands bring
candidate classes together; connected components of the bands' stars are cut into blocks,
and every pair of blocks of a component is one small task group. In it all pairs are compared
by Bayesian pruning: MinHash values are compared a few at a time, and a pair is dropped once
the posterior probability that it reaches the threshold falls below the tolerance. What is
left is verified exactly on the n-gram sets. Only counts and spanning links leave a block, so
a group of g near copies makes rows in proportion to g times its number of blocks.

With 42 bands of 6 values a pair at similarity 0.8 is missed with probability 3e-6, unless
others of its group bring it together as well; the tolerance adds at most 1e-5.

Defined cases: words are what ASCII white space separates, A-Z lower-cased; texts with fewer
words than n have one n-gram, all their words; null texts and texts without words are in no
group; rows with equal texts, repeated ids among them, share a class; a null id belongs to
its class but gives no class id (null if the class has no other); an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.common import KeyFilter, small_batches, table, written
from crumbtrail.llm.components import components

BANDS, ROWS, SIGNATURE = 42, 6, 64
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    value = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    empty = names.index("") if "" in names else -1
    index = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    if empty >= 0:
        index, owner = index[index != empty], owner[index != empty]
        counts = np.bincount(owner, minlength=len(counts))
    words = value[index] if len(index) else np.zeros(0, np.uint64)
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        grams = grams * _STEP + words[i : i + len(grams)]
    grams = _mix(grams)
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= n:
            out.append(np.unique(grams[end - count : end - n + 1]))
        elif count:
            h = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[end - count : end]:
                    h = h * _STEP + w
            out.append(_mix(np.array([h])))
        else:
            out.append(grams[:0])
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS MinHash values of each set (none may be empty)."""
    out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 32_768):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for k in range(BANDS * ROWS):
            out[k, i:j] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
        i = j
    return out.T


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ngram_sets(batch.column(2), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            node, bands, signature = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                mh = minhashes([sets[i] for i in full])
                keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(full), 0)
                for r in range(ROWS):
                    keys = keys * _STEP + mh[:, r::ROWS]
                keys = _mix(keys).view(np.int64)
                for at, i in enumerate(full):
                    node[i] = xxhash.xxh64_intdigest(sets[i].tobytes()) - 2**63
                    bands[i] = keys[at]
                    signature[i] = mh[at, :SIGNATURE].tobytes()
            columns = [pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "th", "node", "bands", "signature"])

    return run


def _sets(n: int, wanted: KeyFilter):
    """The n-gram sets of the rows whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(wanted(whole.column(3).to_numpy())))
            sets = pa.array([s.tobytes() for s in ngram_sets(batch.column(2), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["doc", "th", "grams"])

    return run


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n compared values, the fewest equal ones at which a pair is kept: with a uniform prior the
    posterior of J >= threshold after m of n is the probability of at most m in a binomial of n + 1."""
    out = [0]
    for n in range(1, SIGNATURE + 1):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(max(m, 0))
    return out


def linked_pairs(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left, right), those whose sets reach the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    # Sizes alone bound the similarity.
    fits = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
    left, right = left[fits], right[fits]
    same = np.zeros(len(left), np.int64)
    for k in range(0, SIGNATURE, 8):
        same += (sigs[left, k : k + 8] == sigs[right, k : k + 8]).sum(1)
        stay = same >= least[k + 8]
        left, right, same = left[stay], right[stay], same[stay]
    if len(left) > 4 * len(sets):
        inter = _intersections(sets)[left, right]
    else:
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    ok = inter >= threshold * (size[left] + size[right] - inter) - 1e-9
    return left[ok], right[ok]


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices over slices of the shared n-grams."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        total += x @ x.T
    return np.rint(total).astype(np.int64)


def _verify(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def group(pdf: pd.DataFrame) -> tuple[list[int], list[int], list[int]] | None:
        nodes = pdf.node.to_numpy()
        sigs = np.frombuffer(b"".join(pdf.signature), np.uint32).reshape(len(pdf), SIGNATURE)
        sets = [np.frombuffer(g, np.uint64) for g in pdf.grams]
        own, i, j = pdf.own.to_numpy(), pdf.i.iloc[0], pdf.j.iloc[0]
        if i == j:
            left, right = np.triu_indices(len(pdf), 1)
        else:
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
        left, right = linked_pairs(sigs, sets, left, right, threshold, least)
        if not len(left):
            return None
        links = np.bincount(np.r_[left, right], minlength=len(pdf))
        # The least node that each reaches within the block.
        root = np.arange(len(pdf))
        rank = np.empty(len(pdf), np.int64)
        rank[np.argsort(nodes)] = np.arange(len(pdf))
        low = rank.copy()
        while True:
            before = low.copy()
            np.minimum.at(low, left, before[right])
            np.minimum.at(low, right, low[left])
            if (low == before).all():
                break
        root = np.sort(nodes)[low]
        some = np.flatnonzero(links)
        return nodes[some].tolist(), links[some].tolist(), root[some].tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        names = ["comp", "i", "j"]

        def parts(pdf: pd.DataFrame) -> list[pd.DataFrame]:
            key = pdf[names].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            return [pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)])]

        def out(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            node, links, root, comp = [], [], [], []
            for g in groups:
                if found := group(g):
                    node += found[0]
                    links += found[1]
                    root += found[2]
                    comp += [g.comp.iloc[0]] * len(found[0])
            if node:
                yield pd.DataFrame({"node": node, "links": links, "root": root, "comp": comp})

        for pdf in batches:
            if not len(pdf):
                continue
            if held and (held[-1][names].iloc[-1] == pdf[names].iloc[0]).all():
                cut = parts(pdf)
                held.append(cut[0])
                if len(cut) == 1:
                    continue
                yield from out([pd.concat(held)])
                pdf = pd.concat(cut[1:])
            elif held:
                yield from out([pd.concat(held)])
            cut = parts(pdf)
            yield from out(cut[:-1])
            held = [cut[-1]]
        if held:
            yield from out([pd.concat(held)])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-5,
    block: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per document: its id, ``class_id`` (least id of all it is linked to, over any number of links),
    ``text_class`` (least id of the documents with the same n-grams) and ``n_links``, the number of other
    text classes within the threshold of its own. ``th`` is xxhash64 of the text, to tell rows apart, and ``group``
    a number that rows of one class share (null without words), also where ids are null or repeat."""
    spark = docs.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = written(rows.mapInArrow(_signatures(n), "doc long, th long, node long, bands array<long>, signature binary"), "signatures")
    worded = signed.where("node IS NOT NULL")
    classes = written(
        worded.groupBy("node").agg(F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"), F.min("doc").alias("first_doc"), F.min(F.struct("doc", "th")).alias("like")), "classes"
    )
    # Stars: every member of a band's bucket is tied to the least one.
    member = classes.select("node", F.explode("bands").alias("band"))
    hubs = written(member.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").select("band", "hub"), "buckets")
    # Most buckets hold one class: a key filter leaves their members where they are.
    shared = member.where(KeyFilter(hubs.select("band")).column(F.col("band")))
    stars = shared.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    comps = written(components(stars), "candidates")
    sizes = comps.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = (
        comps.join(sizes, "root")
        .join(classes.select("node", "signature", "like"), "node")
        .select("node", F.col("root").alias("comp"), "blocks", "signature", "like", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int").alias("own"))
    )
    # The n-gram sets of candidates only, from one document of each class. Texts do not move: a key
    # filter picks the rows, and their sets meet the classes.
    wanted = written(comps.join(classes.select("node", "like"), "node").select("node", F.col("like.doc").alias("w_doc"), F.col("like.th").alias("w_th")), "wanted")
    maybe = KeyFilter(wanted.select(F.xxhash64("w_doc", "w_th").alias("h")))
    picked = rows.select("*", F.xxhash64("doc", "th").alias("h")).mapInArrow(_sets(n, maybe), "doc long, th long, grams binary")
    same = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th"))
    grams = written(picked.join(wanted, same).select("node", "grams").dropDuplicates(["node"]), "ngrams")
    pairs = (
        placed.drop("like")
        .join(grams, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", "blocks", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "signature", "grams")
    )
    dealt = pairs.repartition(n_parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    found = written(dealt.drop("blocks").mapInPandas(_verify(threshold, tolerance), "node long, links long, root long, comp long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    labelled = written(
        classes.select("node", "first_doc").join(links, "node", "left").join(roots, "node", "left").select("node", "first_doc", "n_links", F.coalesce("root", "node").alias("root")),
        "labels",
    )
    least = labelled.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    final = labelled.join(least, "root").select("node", F.col("root").alias("group"), F.col("first_doc").alias("text_class"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = signed.select("doc", "th", "node").join(final, "node", "left")
    alone = F.col("node").isNull()
    return joined.select(
        F.col("doc").alias(id_col),
        F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc")).otherwise(F.col("text_class")).alias("text_class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "th",
        "group",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th", "group")
