"""Language identification with bit-sliced Bloom filters of byte n-grams.

A language contains an n-gram if it has it at least ``min_count`` times and not much more
rarely than the language that has it most often. One filter holds all languages: each slot is
a bitmask, and the AND of an n-gram's slots is the set of languages that contain it. A text is
given to the language with the most n-grams, after each count is corrected by the rate of
false positives of that language's slice.

Texts are lower-cased and all but letters and marks becomes single spaces. The counts for the
filters come from at most about ``max_docs`` texts per language, taken by a hash of the id.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing was learned; texts whose n-grams are all unknown go to the language with most
examples, with score 0, as do ties among equals; null languages are not learned from; repeated
rows are judged alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crumbtrail.llm.common import fold, small_batches, table, written

N = 4
HASHES = 3
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_CHUNK = 1 << 19
UNKNOWN = "und"


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased letters and marks, with single spaces between words and around."""
    only = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\pL\pM]+", " ")
    return pc.binary_join_element_wise(" ", pc.utf8_trim(only, " "), "  ", "")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins, with the end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _grams(data: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin at a..b, and which of them stay within a text."""
    part = np.zeros(b - a + N - 1, np.uint64)
    rest = data[a : b + N - 1]
    part[: len(rest)] = rest
    out = part[: b - a].copy()
    for i in range(1, N):
        out |= part[i : b - a + i] << np.uint64(8 * i)
    inside = np.ones(b - a, bool)
    for i in range(1, N):
        at = ends - i - a
        inside[at[(at >= 0) & (at < b - a)]] = False
    return out, inside


def slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    g = grams + np.uint64(1)
    return [((g * odd) ^ (g * odd) >> np.uint64(29)) * _ODD[0] >> np.uint64(64 - bits) for odd in _ODD[:HASHES]]


@dataclass
class Filters:
    langs: list[str]
    bits: int
    words: np.ndarray  # (slots, 64-bit words of the language mask)

    def rates(self) -> np.ndarray:
        """The rate of false positives of each language: its share of set slots, for all hashes."""
        fill = [np.count_nonzero(self.words[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(self.words) for i in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text of letters(): its number of n-grams, and those that each language contains."""
        data, offsets = _bytes(texts)
        total = np.zeros(len(texts), np.int64)
        found = np.zeros((len(self.langs), len(texts)), np.int64)
        begin, ends = offsets[:-1], offsets[1:]
        for a in range(int(offsets[0]), int(offsets[-1]), _CHUNK):
            b = min(a + _CHUNK, int(offsets[-1]))
            grams, inside = _grams(data, ends, a, b)
            where = slots(grams, self.bits)
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(begin, b, "left")
            own = np.arange(first, last)
            own = own[ends[own] > begin[own]]
            starts = np.maximum(begin[own] - a, 0)
            total[own] += np.add.reduceat(inside, starts, dtype=np.int64)
            for w in range(self.words.shape[1]):
                mask = np.where(inside, self.words[where[0], w], np.uint64(0))
                for s in where[1:]:
                    mask &= self.words[s, w]
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    found[i, own] += np.add.reduceat((mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool), starts, dtype=np.int64)
        return total, found

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        clean = letters(texts)
        known = pc.match_substring_regex(clean, r"\pL").to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, found = self.counts(clean)
        rate = self.rates()[:, None]
        true = np.clip((found - rate * total) / (1 - rate + 1e-9), 0, None)
        best = true.argmax(0)
        top = true.max(0)
        # The best language against the next one.
        second = np.sort(true, 0)[-2] if len(self.langs) > 1 else np.zeros(len(texts))
        score = np.where(known & (top > 0), top / np.maximum(top + second, 1e-9), 0.0)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())], np.clip(score, 0, 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, clean = batch.column(0), letters(batch.column(1))
        data, offsets = _bytes(clean)
        code = lang.dictionary_encode()
        owner = np.repeat(code.indices.to_numpy(zero_copy_only=False), np.diff(offsets)).astype(np.uint64)
        a, b = int(offsets[0]), int(offsets[-1])
        grams, inside = _grams(data, offsets[1:], a, b)
        pairs, n = np.unique(((owner << np.uint64(8 * N)) | grams)[inside], return_counts=True)
        lang_of = pa.DictionaryArray.from_arrays(pa.array((pairs >> np.uint64(8 * N)).astype(np.int32)), code.dictionary).cast(pa.string())
        gram = (pairs & np.uint64((1 << 8 * N) - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([lang_of, pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, *, max_docs: int = 4000, min_count: int = 3, ratio: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from the texts and languages of docs."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # Languages are few: one row each goes to the driver.
    sizes = {r[0]: r["n"] for r in rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters([], 1, np.zeros((2, 1), np.uint64))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, max_docs / n) * 1_000_000))])
    sample = rows.where(F.pmod(F.xxhash64(id_col, F.lit("lang")), F.lit(1_000_000)) < share[F.col(lang_col)])
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    counts = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_counted, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-grams")
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = F.create_map(*[F.lit(x) for lang, n in total.items() for x in (lang, float(n))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    per_gram = Window.partitionBy("gram")  # at most a row per language
    kept = (
        counts.where(F.col("n") >= min_count)
        .withColumn("f", F.col("n") / totals[F.col("lang")])
        .withColumn("most", F.max("f").over(per_gram))
        .where(F.col("f") >= ratio * F.col("most"))
        .select("gram", number[F.col("lang")].alias("i"))
    )
    size = kept.agg(F.count_distinct("gram").alias("n")).first().n
    bits = min(22, max(12, int(size * 8).bit_length()))
    width = -(-len(langs) // 64)

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, i = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().astype(np.int64)
            mask = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            for s in slots(gram, bits):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(i // 64), pa.array(mask)], names=["slot", "word", "mask"])

    # At most 2^22 slots whatever the corpus holds.
    filled = kept.mapInArrow(slotted, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros((1 << bits, width), np.uint64)
    words[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Filters(langs, bits, words)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs without the text, with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(len(own)))
            columns = [batch.column(i) for i in range(len(own))] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(*own, F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held: Column = fold(F.col("doc_id"), 3) == 1
    filters = learn(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), filters)
