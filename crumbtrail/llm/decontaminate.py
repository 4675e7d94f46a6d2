"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words (letters, marks and digits; all else separates).
A test item of n words allows k = floor(rate * n) word edits. It is split into k + 1 pieces;
a passage within k edits holds at least one of them whole. Piece hits are found with rolling
hashes over the documents' word numbers, and the surroundings of each hit are verified with
Myers' bit-parallel edit distance. The items are a query set of stated size: they come to the
workers in blocks of at most ``block_chars`` characters, one pass over the documents each.

Defined cases: items of fewer words than one edit needs (four, at the rate of a fifth) are found
as they stand, items without words, null ones among them, match nothing; null and empty texts match nothing; equal items and repeated documents each give their own
rows; of equal distances the earliest end counts; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.common import small_batches, table
from crumbtrail.llm.ragged import gather, split_words

#: What separates words (RE2 syntax).
_GAP = r"[^\pL\pM\pN]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id {id}, item_id {item}, distance int, budget int, start_word int, end_word int"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and the number of each text's (empty words at the ends count)."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(texts), _GAP, " "), " ")


def plain_words(text: str) -> list[str]:
    """The words of one text, for single items and tests."""
    words = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in pc.utf8_lower(pa.scalar(text)).as_py())
    return words.split(" ") if " " not in words else re.split(" +", words.strip(" "))


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of the text, and the end of the first such stretch."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Pieces of a block of items, ready for lookup by word numbers."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.names: list[object] = []
        self.patterns: list[np.ndarray] = []
        vocabulary: dict[str, int] = {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for name, text in items:
            words = [w for w in plain_words(text or "") if w]
            if not words:
                continue
            pattern = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
            k = math.floor(rate * len(pattern) + 1e-9)
            cuts = [len(pattern) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(b - a, []).append((int(self._hash(pattern[a:b].astype(np.uint64), b - a)[0]), len(self.names), a))
            self.names.append(name)
            self.patterns.append(pattern)
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.budgets = np.floor(rate * self.lengths + 1e-9).astype(np.int64)
        self.vocabulary = pa.array(list(vocabulary), pa.string())
        #: By length: a sieve of hashes, the distinct hashes, where the places of each begin, and item and offset of each place.
        self.pieces: dict[int, tuple[np.ndarray, ...]] = {}
        for m, found in pieces.items():
            h = np.array([x[0] for x in found], np.uint64)
            order = np.argsort(h, kind="stable")
            exact, start = np.unique(h[order], return_index=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[exact >> np.uint64(44)] = True
            item, offset = (np.array([x[i] for x in found], np.int64)[order] for i in (1, 2))
            self.pieces[m] = (sieve, exact, np.r_[start, len(h)], item, offset)

    @staticmethod
    def _hash(ids: np.ndarray, m: int, before: np.ndarray | None = None) -> np.ndarray:
        """Rolling hashes of all windows of m ids; before: those of m - 1."""
        if before is None and m > 1:
            before = Matcher._hash(ids, m - 1)
        mixed = (ids[m - 1 :] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ mixed >> np.uint64(29) if m == 1 else before[: len(mixed)] * _BASE + (mixed ^ mixed >> np.uint64(29))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and offset in the item of every whole piece in a run of word numbers (0: not in any item)."""
        known = ids > 0
        last = np.where(known, len(ids), np.arange(len(ids)))
        run = np.minimum.accumulate(last[::-1])[::-1] - np.arange(len(ids))
        h, out = None, []
        for m in range(1, max(self.pieces, default=0) + 1):
            if len(ids) < m:
                break
            h = self._hash(ids, m, h)
            if m not in self.pieces:
                continue
            sieve, exact, start, item, offset = self.pieces[m]
            at = np.flatnonzero(run[: len(h)] >= m)
            at = at[sieve[h[at] >> np.uint64(44)]]
            place = np.minimum(np.searchsorted(exact, h[at]), len(exact) - 1)
            same = exact[place] == h[at]
            at, place = at[same], place[same]
            # Each place meets all items that have the piece.
            times = start[place + 1] - start[place]
            own = gather(np.arange(len(item)), start[place], times)
            out.append((np.repeat(at, times), item[own], offset[own]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, distance, budget, first word, word behind the last) of every match."""
        values, counts = words_of(texts)
        ids = pc.index_in(values, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # A separator between texts keeps pieces from reaching over.
        begins = np.cumsum(counts) - counts
        spread = np.zeros(len(ids) + len(counts) + 1, np.uint64)
        owner = np.repeat(np.arange(len(counts)), counts)
        spread[np.arange(len(ids)) + owner] = ids
        starts = begins + np.arange(len(counts))
        p, item, offset = self.hits(spread)
        if not len(p):
            return []
        text = np.searchsorted(starts, p, "right") - 1
        k, n = self.budgets[item], self.lengths[item]
        a = np.maximum(starts[text], p - offset - k)
        b = np.minimum(starts[text] + counts[text], p - offset + n + k)
        # Stretches of one text and item that overlap are one.
        order = np.lexsort((a, item, text))
        text, item, a, b = text[order], item[order], a[order], b[order]
        pair = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
        base = np.cumsum(pair) * (len(spread) + 1)
        reach = np.maximum.accumulate(b + base)
        new = pair | np.r_[True, (a + base)[1:] > reach[:-1]]
        first = np.flatnonzero(new)
        text, item, a, b = text[first], item[first], a[first], np.maximum.reduceat(b, first)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, lo, hi in zip(text.tolist(), item.tolist(), a.tolist(), b.tolist()):
            k, pattern = int(self.budgets[i]), self.patterns[i]
            window = spread[lo:hi].astype(np.int64)
            # Words of the item that the stretch lacks must all be edited.
            if len(pattern) - np.count_nonzero(np.isin(pattern, window)) > k:
                continue
            distance, end = myers(pattern.tolist(), window.tolist())
            if distance <= k and ((t, i) not in out or distance < out[t, i][0]):
                back = myers(pattern[::-1].tolist(), window[:end][::-1].tolist())[1]
                at = lo - int(starts[t])
                out[t, i] = (distance, at + end - back, at + end)
        return [(t, i, d, int(self.budgets[i]), x, y) for (t, i), (d, x, y) in out.items()]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    rate: float = 0.2,
    block_chars: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and test item that occurs in it within the item's budget of word edits."""
    spark = docs.sparkSession
    small_batches(spark)
    types = (docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString())
    schema = _SCHEMA.format(id=types[0], item=types[1])
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where(F.col("item_text").isNotNull())
    chars = wanted.agg(F.sum(F.char_length("item_text"))).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * chars / block_chars))
    found = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_text", "item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r.item_id, r.item_text) for r in part])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = matcher.matches(batch.column(1).fill_null("")) if matcher.names else []
                at = pa.array([r[0] for r in rows], pa.int64())
                item = pa.array([matcher.names[r[1]] for r in rows], item_type)
                rest = [pa.array([r[i] for r in rows], pa.int32()) for i in range(2, 6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), item, *rest], names=["doc_id", "item_id", "distance", "budget", "start_word", "end_word"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema[item_id_col].dataType)
        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
