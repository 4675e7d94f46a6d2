"""Token ids in grammar-compressed files.

Whole texts are encoded with a tokenizers file whose words do not reach over white space, so
distinct stretches between white space are encoded once per worker and kept in a bounded
cache. Ids go to ranges of the document id and into shards, in ascending order of the id; each
shard is compressed by Re-Pair, with its rules, expansion lengths and document bounds, so that
one document can be read without expanding the shard. The files are Parquet, one row a shard.

Defined cases: a null text is the empty text and has only the end id; null document ids come
first; rows with equal ids stand in the order of their tokens, each with its own place; a text
longer than a shard is a shard of its own; an empty table gives an empty file; other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crumbtrail.llm.common import new_path, small_batches, table
from crumbtrail.llm.ragged import RunCache
from crumbtrail.llm.repair import compress, expand, expand_range

#: Bytes of a worker's cache.
CACHE = 160 << 20
#: Marks that end a word: the tokenizer parts them from a letter or digit before.
_ENDINGS = r"([A-Za-z0-9])([.,!?;:]+)(\s|$)"
#: Texts with these stay as they are.
_KEEP = r"<\||[A-Z]\pM"
_SHARD = (
    "bucket int, seq int, n_tokens long, first_rule int, doc_ids array<long>, doc_tokens array<int>, "
    "rules binary, lengths binary, sequence binary"
)
_encoders: dict[str, RunCache] = {}


def encoder(path: str) -> RunCache:
    """Ids of stretches without white space, by the tokenizers library."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _encoders[path] = RunCache(
            lambda units: [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)], CACHE
        )
    return _encoders[path]


def encode_texts(path: str, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and the number of each text's, the end id with them."""
    texts = texts.fill_null("")
    # The tokenizer lowers case itself; doing it first, and parting words from the marks behind them,
    # leaves fewer distinct stretches. Special tokens would suffer, and so would capitals with a mark
    # on them: the tokenizer composes characters before it lowers them.
    plain = pc.invert(pc.match_substring_regex(texts, _KEEP))
    if pc.any(plain).as_py():
        texts = pc.if_else(plain, pc.replace_substring_regex(pc.ascii_lower(texts), _ENDINGS, r"\1 \2\3"), texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, lengths = encoder(path).runs(lists.flatten())
    bounds = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
    if end_id is not None:
        flat = np.insert(flat, bounds[1:], end_id)
        bounds = bounds + np.arange(len(bounds))
    return flat, np.diff(bounds)


def _encoded(model: str, end_id: int | None, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = encode_texts(model, batch.column(1), end_id)
            raw, ends = flat.astype("<u4").view(np.uint8), np.cumsum(sizes) * 4
            # Ids below 65,536 travel as two bytes.
            if not len(flat) or flat.max() < 1 << 16:
                raw, ends = flat.astype("<u2").view(np.uint8), np.cumsum(sizes) * 2
            offsets = pa.py_buffer(np.r_[0, ends].astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(raw)])
            doc = batch.column(0)
            bucket = np.searchsorted(bounds, doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), doc, pa.array(sizes, pa.int32()), ids], names=["bucket", "doc_id", "n", "ids"])

    return run


def _sharded(first_rule: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seq, held, total = -1, 0, [], 0

        def shard() -> pa.RecordBatch:
            sequence, rules, lengths = compress(np.concatenate([h[1] for h in held]), first_rule)
            row = {
                "bucket": bucket, "seq": seq, "n_tokens": total, "first_rule": first_rule,
                "doc_ids": [h[0] for h in held], "doc_tokens": [len(h[1]) for h in held],
                "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": sequence.astype("<u4").tobytes(),
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for b, doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (b != bucket or total + n > shard_tokens):
                    yield shard()
                    held, total, seq = [], 0, seq + 1
                if b != bucket:
                    bucket, seq = b, 0
                held.append((doc, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)))
                total += n
        if held:
            yield shard()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    model: str,
    *,
    end_id: int | None = None,
    vocabulary: int = 49_408,
    shard_tokens: int = 1 << 18,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of all texts, in ascending order of the id, as shards below ``path``. model: a path that is there on every worker."""
    spark = docs.sparkSession
    small_batches(spark, 4096)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds of the ranges, from the id column alone; as many as there are partitions.
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first().c or []
    bounds = np.unique(np.array(cuts, np.int64))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(_encoded(model, end_id, bounds), "bucket int, doc_id long, n int, ids binary")
    ranged = coded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    ranged.mapInArrow(_sharded(vocabulary, shard_tokens), _SHARD).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
            lengths = np.frombuffer(r["lengths"], "<u4")
            ids = expand(np.frombuffer(r["sequence"], "<u4"), rules, lengths, r["first_rule"]).astype("<u4")
            sizes = np.array(r["doc_tokens"], np.int64)
            ends = np.cumsum(sizes)
            k = len(sizes)
            parts = [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["bucket"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary()),
                ],
                names=["bucket", "seq", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
            )


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids as 32-bit integers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    stored = shards(spark, path)
    # A row per range goes to the driver: as many as the file has partitions.
    totals = {r.bucket: r.n for r in stored.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    base, ranges = 0, []
    for b in sorted(totals):
        ranges.append((b, base))
        base += totals[b]
    before = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.select("bucket", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inside"))
        .join(F.broadcast(spark.createDataFrame(ranges, "bucket int, base long")), "bucket")
        .select("bucket", "seq", (F.col("base") + F.col("inside")).alias("shard_start"))
    )
    rows = stored.mapInArrow(_decoded if ids else _without_ids, f"bucket int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long{', ids binary' if ids else ''}")
    done = rows.join(starts, ["bucket", "seq"]).withColumn("start", F.col("shard_start") + F.col("within"))
    return done.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def _without_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decoded(batches):
        yield batch.select(batch.schema.names[:-1])


def document_ids(row, index: int) -> np.ndarray:
    """The ids of one document of a shard, expanding no more than it needs."""
    ends = np.cumsum(row.doc_tokens)
    rules = np.frombuffer(row.rules, "<u4").reshape(-1, 2)
    parts = np.frombuffer(row.sequence, "<u4"), rules, np.frombuffer(row.lengths, "<u4"), row.first_rule
    return expand_range(*parts, int(ends[index] - row.doc_tokens[index]), int(ends[index]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path, ids=False)
