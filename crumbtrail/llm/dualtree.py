"""Ranked lexical search of many items at once, by a tree of items and trees of documents.

A document's coordinate for a term is the term's share of the score, an item's is the term's
weight, and a score is their inner product. Nodes of the item tree (groups of items) and of the
document trees (blocks, runs of blocks, whole batches) hold the largest coordinate of what stands
below them, so the inner product of two nodes bounds every score between them. A pair of nodes is
dropped, with all its items and documents, when its bound is below the weakest kth score of the
node's items; what is left goes down both trees at once, and only pairs of an item and a block
that survive are scored. All numbers are 64-bit integers, so bounds and scores are exact.

The corpus is read once for the postings of terms that some item has (a bitmap of fixed size tells
them), which are written with their documents in an order that puts similar ones into one block.
A first pass scores for each item the most promising block of each batch: the kth best of those
scores over the corpus is a score that the result must reach. The second pass searches with it;
each task raises it further by what it finds, and hands on at most k documents an item.
Items are taken in blocks of about ``item_terms`` terms, so what is broadcast does not grow.

Defined cases: a null or empty text has no term and is not counted; a document row is a document,
also where ids repeat; null ids come before all others among equal scores; repeated item rows
each get their ranking; items without a term that occurs get none; an item of any length is
searched whole; an empty table gives an empty table; other columns are ignored. Terms are told apart by
64-bit hashes: one in 10^12 queries of a hundred thousand terms confuses two of a billion.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crumbtrail.llm.common import KeyFilter, small_batches, table, written
from crumbtrail.llm.ragged import gather

#: Bytes of terms (fixed value): all but these ASCII ranges; A-Z are lower-cased, the rest parts terms.
_APART = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in _APART else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_PIECE = 4 << 20
_MOST_KNOWN = 1 << 18
#: Documents of a node, from the root of a batch down; items of a node, likewise. The pairs go down together.
DOC_NODES = (1024, 128, 16)
ITEM_NODES = (64, 8, 1)


def _counted(text: bytes) -> Counter:
    """How often each term occurs. Long texts are split piece by piece."""
    flat = text.translate(_FOLD)
    if len(flat) <= _PIECE:
        return Counter(flat.split())
    out, at = Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + _PIECE)
        end = len(flat) if end < 0 else end
        out.update(flat[at:end].split())
        at = end
    return out


def _postings(keep: KeyFilter | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int | None] = {}
        for batch in batches:
            counted = [_counted(t) for t in batch.column("text").to_pylist()]
            if len(known) > _MOST_KNOWN:
                known.clear()
            new = list(set().union(*counted) - known.keys())
            if new:
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64).view(np.int64)
                wanted = keep(hashes) if keep else np.ones(len(new), bool)
                known.update((w, h if k else None) for w, h, k in zip(new, hashes.tolist(), wanted.tolist()))
            offsets, terms, tfs = [0], [], []
            for c in counted:
                own = [(h, n) for h, n in ((known[w], n) for w, n in c.items()) if h is not None]
                terms += [h for h, _ in own]
                tfs += [n for _, n in own]
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            total = pa.array([sum(c.values()) for c in counted], pa.int64())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), total, *lists], names=["own", "n", "terms", "tfs"])

    return run


def postings(rows: DataFrame, own: Column, text: Column, keep: KeyFilter | None = None) -> DataFrame:
    """own, n (terms of the whole text with repeats), and the hashes and numbers of its distinct terms, or of those that keep lets pass."""
    small_batches(rows.sparkSession)
    df = rows.select(own.alias("own"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    kind = df.schema["own"].dataType.simpleString()
    return df.mapInArrow(_postings(keep), f"own {kind}, n long, terms array<long>, tfs array<long>")


class ItemTree:
    """The items of one block: their terms as places in ``vocabulary`` (sorted hashes), and for each size of node the terms and
    largest weights of its nodes, as runs of flat arrays. Items that share their heaviest terms are neighbours."""

    def __init__(self, rows: pd.DataFrame) -> None:
        """rows: no, term, w, each pair of no and term once."""
        self.vocabulary, place = np.unique(rows.term.to_numpy(np.int64), return_inverse=True)
        no, w = rows.no.to_numpy(np.int64), rows.w.to_numpy(np.int64)
        heaviest = np.lexsort((place, -w, no))
        first = np.r_[True, np.diff(no[heaviest]) != 0]
        numbers, lead = no[heaviest][first], place[heaviest][first]
        order = np.lexsort((numbers, lead))
        self.numbers = numbers[order]
        rank = np.empty(len(numbers), np.int64)
        rank[order] = np.arange(len(numbers))
        item = rank[np.searchsorted(numbers, no)]
        self.levels = [self._level(item // size, place, w) for size in ITEM_NODES]

    def _level(self, node: np.ndarray, place: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """terms, weights, starts, lengths."""
        by = np.lexsort((place, node))
        new = np.r_[True, (np.diff(node[by]) != 0) | (np.diff(place[by]) != 0)]
        most = np.maximum.reduceat(w[by], np.flatnonzero(new))
        terms, of = place[by][new], node[by][new]
        starts = np.flatnonzero(np.r_[True, np.diff(of) != 0])
        return terms, most, starts, np.diff(np.r_[starts, len(of)])


class DocTree:
    """A batch of documents: for single documents and for each size of node the terms (places in the vocabulary) and their
    largest shares, as runs of flat arrays."""

    def __init__(self, vocabulary: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> None:
        place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        met = vocabulary[place] == terms
        node, place, tfs = np.repeat(np.arange(len(lengths)), lengths)[met], place[met], tfs[met]
        most = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[node])
        self.size, self.levels, below = len(lengths), {}, 1
        for size in (1, *reversed(DOC_NODES)):
            key = node // (size // below) * len(vocabulary) + place
            by = np.argsort(key, kind="stable")
            key, most = key[by], most[by]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            most = np.maximum.reduceat(most, first) if len(first) else most
            node, place = np.divmod(key[first], len(vocabulary))
            self.levels[size] = (place, most, np.searchsorted(node, np.arange(-(-self.size // size) + 1)))
            below = size

    def node(self, size: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        place, most, starts = self.levels[size]
        return place[starts[i] : starts[i + 1]], most[starts[i] : starts[i + 1]]


class _Searcher:
    """Searches batches one after the other. floor: for each item (in the tree's order) a score that results must reach."""

    def __init__(self, tree: ItemTree, floor: np.ndarray, k: int, rows: int = 1 << 20) -> None:
        self.tree, self.floor, self.k, self.rows = tree, np.maximum(floor, 1), k, rows
        self.scratch = np.zeros(len(tree.vocabulary), np.int64)
        self.held = [np.zeros(0, np.int64)] * 4
        self.waiting: list[list[np.ndarray]] = []
        self.scored = self.pairs = 0

    def _bounds(self, level: int, nodes: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The largest score that each of these item nodes can have with documents of these coordinates."""
        terms, weights, starts, lengths = self.tree.levels[level]
        self.scratch[place] = most
        own = lengths[nodes]
        values = gather(weights, starts[nodes], own) * self.scratch[gather(terms, starts[nodes], own)]
        self.scratch[place] = 0
        return np.add.reduceat(values, np.cumsum(own) - own)

    def _weakest(self, level: int) -> np.ndarray:
        """The least floor of each item node."""
        return np.minimum.reduceat(self.floor, np.arange(0, len(self.floor), ITEM_NODES[level]))

    def _score(self, batch: DocTree, block: int, items: np.ndarray) -> np.ndarray:
        """Scores of each document of a block (rows) with each of the items."""
        terms, weights, starts, lengths = self.tree.levels[-1]
        a, b = block * DOC_NODES[-1], min((block + 1) * DOC_NODES[-1], batch.size)
        place, most, at = batch.levels[1]
        here, value = place[at[a] : at[b]], most[at[a] : at[b]]
        # The block's own terms, numbered from 1; all others meet a column of zeros.
        own = np.unique(here)
        self.scratch[own] = np.arange(1, len(own) + 1)
        shares = np.zeros((b - a, len(own) + 1), np.int64)
        shares[np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), self.scratch[here]] = value
        n = lengths[items]
        column = self.scratch[gather(terms, starts[items], n)]
        self.scratch[own] = 0
        weight = gather(weights, starts[items], n)
        met = column > 0
        item = np.repeat(np.arange(len(items)), n)[met]
        out = np.zeros((b - a, len(items)), np.int64)
        if len(item):
            first = np.flatnonzero(np.diff(item, prepend=-1))
            out[:, item[first]] = np.add.reduceat(shares[:, column[met]] * weight[met], first, axis=1)
        self.scored += out.size
        return out

    def _keep(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray, no_id: np.ndarray) -> None:
        self.waiting.append([items, scores, docs, no_id])
        if sum(len(x[0]) for x in self.waiting) > self.rows:
            self.settle()

    def settle(self) -> None:
        """Keeps k documents an item, and raises the floors to their scores."""
        item, score, doc, no_id = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        self.waiting = []
        by = np.lexsort((doc, ~no_id.astype(bool), -score, item))
        item = item[by]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        # Every item's kth: nothing below it can be among the k best.
        kth = by[rank == self.k - 1]
        full = item[rank == self.k - 1]
        self.floor[full] = np.maximum(self.floor[full], score[kth])
        by, item = by[rank < self.k], item[rank < self.k]
        self.held = [item, score[by], doc[by], no_id[by]]

    def _add(self, scores: np.ndarray, items: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        d, i = np.nonzero(scores >= self.floor[items])
        if len(d):
            self._keep(items[i], scores[d, i], ids[d], nulls[d])

    def search(self, batch: DocTree, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Down both trees, from the batch's root and the groups of items to blocks and items."""
        self.pairs += batch.size * len(self.floor)
        alive = {0: np.arange(len(self.tree.levels[0][2]))}
        for level, size in enumerate(DOC_NODES):
            weakest, down = self._weakest(level), {}
            for node, items in alive.items():
                place, most = batch.node(size, node)
                if not len(place):
                    continue
                items = items[self._bounds(level, items, place, most) >= weakest[items]]
                if not len(items):
                    continue
                if level + 1 == len(DOC_NODES):
                    a = node * size
                    self._add(self._score(batch, node, items), items, ids[a : a + size], nulls[a : a + size])
                    continue
                wide = ITEM_NODES[level] // ITEM_NODES[level + 1]
                below = (items[:, None] * wide + np.arange(wide)).ravel()
                below = below[below < len(self.tree.levels[level + 1][2])]
                deep = size // DOC_NODES[level + 1]
                down.update((child, below) for child in range(node * deep, min((node + 1) * deep, -(-batch.size // DOC_NODES[level + 1]))))
            alive = down
        self.settle()

    def seed(self, batch: DocTree) -> None:
        """Scores for each item the block that promises most to it."""
        size, items = DOC_NODES[-1], np.arange(len(self.floor))
        blocks = -(-batch.size // size)
        bounds = np.stack([self._bounds(len(ITEM_NODES) - 1, items, *batch.node(size, i)) for i in range(blocks)])
        best, reach = bounds.argmax(0), bounds.max(0) >= self.floor
        for block in np.unique(best[reach]):
            own = items[(best == block) & reach]
            scores = self._score(batch, int(block), own)
            self._add(scores, own, np.zeros(len(scores), np.int64), np.zeros(len(scores), bool))
        self.settle()


_FOUND = "no long, score long, doc long, no_id boolean"


def _task(shared: Broadcast, k: int, seeding: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, floor = shared.value
        at_work = _Searcher(tree, floor.copy(), k)
        for b in batches:
            terms, tfs = b.column("terms"), b.column("tfs")
            lengths = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            ids = b.column("doc")
            batch = DocTree(tree.vocabulary, lengths, *(x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs)), b.column("m").to_numpy(zero_copy_only=False))
            if seeding:
                at_work.seed(batch)
            else:
                at_work.search(batch, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, doc, no_id = at_work.held
        yield pa.RecordBatch.from_arrays([pa.array(tree.numbers[item], pa.int64()), pa.array(score, pa.int64()), pa.array(doc, pa.int64()), pa.array(no_id.astype(bool), pa.bool_())], names=["no", "score", "doc", "no_id"])

    return run


def best_k(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with ``rank``; first those of each of 64 shares of its rows, so that no task meets all of them."""
    order = [F.desc("score"), F.desc("no_id"), F.asc("doc")]
    share = F.pmod(F.xxhash64("doc", "score"), F.lit(64))
    inner = found.withColumn("share_", share).withColumn("rank", F.row_number().over(Window.partitionBy("no", "share_").orderBy(*order))).where(F.col("rank") <= k)
    return inner.drop("share_").withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, item_terms: int = 1 << 18, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = items.select(F.col(item_id).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("no"))
    asked = written(postings(asked, F.struct("id", "no"), F.col("text")), "items").select("own.no", "own.id", "terms")
    sought = asked.select("no", F.explode("terms").alias("term"))
    keep = KeyFilter(sought.select("term").distinct())
    read = written(postings(docs, F.struct(F.col(doc_id).cast("long").alias("doc")), F.col(text_col), keep), "postings").select("own.doc", "n", "terms", "tfs")
    totals = read.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = totals["docs"], max(totals["terms"], 1)
    # Documents with the same least and largest hashes of terms are likely to be alike.
    likeness = [F.array_min("terms"), F.array_max("terms"), F.col("n"), F.xxhash64("doc", "terms")]
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
    ordered = read.where(F.size("terms") > 0).repartitionByRange(parts, *likeness).sortWithinPartitions(*likeness)
    ordered = written(ordered.select("doc", m.alias("m"), "terms", "tfs"), "postings-ordered")
    df = ordered.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = written(sought.join(df, "term").select("no", "term", weight.alias("w")), "item-weights")
    blocks = -(-weights.count() // item_terms)
    out = None
    for i in range(blocks):
        mine = weights.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == i).toPandas()
        if not len(mine):
            continue
        tree = ItemTree(mine)
        floor = np.zeros(len(tree.numbers), np.int64)
        first = spark.sparkContext.broadcast((tree, floor))
        seeds = best_k(ordered.mapInArrow(_task(first, k, True), _FOUND), k).where(F.col("rank") == k).select("no", "score").toPandas()
        by_number = np.argsort(tree.numbers)
        floor[by_number[np.searchsorted(tree.numbers, seeds.no.to_numpy(np.int64), sorter=by_number)]] = seeds.score
        second = spark.sparkContext.broadcast((tree, floor))
        found = written(best_k(ordered.mapInArrow(_task(second, k, False), _FOUND), k), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], _FOUND + ", rank int")
    met = out.join(asked.select("no", "id"), "no")
    return met.select(F.col("id").alias("item_id"), "rank", F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d,
         list_transform(regexp_extract_all(coalesce(text, ''), '{_TERM}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws
  FROM documents
), sizes AS (
  SELECT doc_id, d, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0
), totals AS (
  SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes
), asked AS (
  SELECT item_id, i, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{_TERM}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS term
  FROM (SELECT *, row_number() OVER () AS i FROM benchmark)
), tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY d, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN totals
), scores AS (
  SELECT i, any_value(item_id) AS item_id, d, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (d) CROSS JOIN totals
  GROUP BY i, d
), ranks AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
"""
