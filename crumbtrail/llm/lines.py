"""Line deduplication over a corpus.

A line's key is its text without ASCII white space at both ends and with A-Z lower-cased.
Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose
all their lines except in the document with the largest id. Key hashes (128 bits) are
range-partitioned with document and position as further sort keys, so that the lines of a
very common key are spread over many partitions; each partition is streamed once, batch by
batch, and only what touches its edges is settled by a table of at most two keys per
partition. The
outcome is a compressed bitmap per document (bit set: the line stays); texts never move.

Defined cases: a null or empty text is one empty line, which stays; rows with the same id
are one document for the counts, and equal texts under one id get one bitmap; null ids sort
below all others and count as one document; ties cannot occur, as a key keeps its lines in
one document id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.common import SPACES, KeyFilter, ascii_lower, small_batches, table, written

#: Stands for a null doc_id in the sort, below every real id.
NO_ID = -(2**63)
_ROW = ["h1", "h2", "doc", "th", "pos"]
_LINES = "h1 long, h2 long, doc long, th long, pos int"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("th"))


def line_keys(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line long enough: two 64-bit hashes of its key, document, hash of the text, position."""
    lines = _texts(docs, id_col, text_col).select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Lines that are too short before they are stripped need no key.
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACES))))
    return keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.lit(2)).alias("h2"), "doc", "th", "pos"
    )


class _Group:
    """The lines of one key as they come. Only what is undecided is held: the lines of its first min_docs - 1 documents."""

    def __init__(self, at_edge: bool, stays: int) -> None:
        self.at_edge, self.stays = at_edge, stays
        self.docs, self.last, self.pending = 0, None, []

    def feed(self, part: pd.DataFrame, min_docs: int) -> Iterator[pd.DataFrame]:
        if self.at_edge:
            yield part.assign(kind=1)
            return
        doc = part.doc.to_numpy()
        self.docs += int(np.count_nonzero(doc[1:] != doc[:-1])) + (self.last is None or doc[0] != self.last)
        self.last = doc[-1]
        self.pending.append(part)
        if self.docs >= min_docs:
            for held in self.pending:
                yield held[held.doc != self.stays].assign(kind=0)
            self.pending = []

    def close(self, h1: int, h2: int, min_docs: int) -> Iterator[pd.DataFrame]:
        """At the end of the partition, where the key may go on in the next one."""
        if not self.at_edge and self.docs >= min_docs:
            yield pd.DataFrame([(h1, h2, self.stays, 0, 0, 2)], columns=[*_ROW, "kind"])
        for held in self.pending:
            yield held.assign(kind=1)


def _settle(min_docs: int):
    """Streams a sorted partition, batch by batch. Kind 0 rows are lines to drop; kind 1 rows belong to a key at an edge
    of the partition and are undecided; a kind 2 row says that the partition's last key has enough documents, and which stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            h1, h2, doc = (pdf[c].to_numpy() for c in ("h1", "h2", "doc"))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts = np.flatnonzero(new)
            # Keys that begin and end within the batch are settled together.
            a, b = (int(starts[1]), int(starts[-1])) if len(starts) > 2 else (0, 0)
            if a < b:
                inner, at = new[a:b], doc[a:b]
                own = np.cumsum(inner) - 1
                first = np.flatnonzero(inner)
                docs = np.add.reduceat((inner | np.r_[True, at[1:] != at[:-1]]).astype(np.int64), first)
                # Documents come in falling order, so that a key's first occurrence is the one that stays.
                drop = (docs[own] >= min_docs) & (at != at[first][own])
                if drop.any():
                    yield pdf.iloc[a:b][drop].assign(kind=0)
            ends = np.r_[starts[1:], len(pdf)]
            for i in sorted({0, len(starts) - 1}):
                part = pdf.iloc[int(starts[i]) : int(ends[i])]
                here = (h1[starts[i]], h2[starts[i]])
                if here != key:
                    key, group = here, _Group(key is None, doc[starts[i]])
                yield from group.feed(part, min_docs)
        if group:
            yield from group.close(*key, min_docs)

    return run


def dropped_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, pos) of every line that goes."""
    spark = docs.sparkSession
    keys = written(line_keys(docs, min_chars, id_col, text_col), "line-keys")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(n, "h1", "h2", F.desc("doc"), "th", "pos").sortWithinPartitions("h1", "h2", F.desc("doc"), "th", "pos")
    settled = written(ordered.mapInPandas(_settle(min_docs), _LINES + ", kind int"), "line-groups")
    edge = settled.where("kind = 1").drop("kind")
    # At most two keys per partition; document counts by a distinct that spreads over (key, doc).
    counted = edge.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("stays"))
    reached = settled.where("kind = 2").select("h1", "h2", F.lit(min_docs).cast("long").alias("docs"), F.col("doc").alias("stays"))
    facts = counted.unionByName(reached).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("stays").alias("stays"))
    facts = facts.where(F.col("docs") >= min_docs)
    at_edge = edge.join(F.broadcast(facts), ["h1", "h2"]).where(F.col("doc") != F.col("stays"))
    return settled.where("kind = 0").select("doc", "th", "pos").unionByName(at_edge.select("doc", "th", "pos"))


def _bitmap(drops: pd.Series, counts: pd.Series) -> pd.Series:
    def one(pos: np.ndarray, n: int) -> bytes:
        keep = np.ones(-(-n // 8) * 8, bool)
        keep[np.asarray(pos, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)

    return pd.Series([one(p, n) for p, n in zip(drops, counts)])


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A compressed keep bitmap for each document that loses a line: doc, th, n_drop, keep (zlib; little-endian bits)."""
    gone = dropped_lines(docs, min_chars=min_chars, min_docs=min_docs, id_col=id_col, text_col=text_col)
    per_doc = gone.distinct().groupBy("doc", "th").agg(F.collect_list("pos").alias("drops"), F.max("pos").alias("last"))
    pack = F.pandas_udf(_bitmap, "binary")
    # Lines beyond the last dropped one stay; the bitmap ends there.
    return per_doc.select("doc", "th", F.size("drops").alias("n_drop"), pack("drops", F.col("last") + 1).alias("keep"))


def _apply(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    out, total, gone = [], [], []
    for t, k in zip(text, keep):
        lines = t.split("\n")
        total.append(len(lines))
        if k is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little")
            kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
            gone.append(len(lines) - len(kept))
            t = "\n".join(kept)
        else:
            gone.append(0)
        out.append(t)
    return pd.DataFrame({"kept": out, "n_lines": total, "n_dropped": gone})


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``kept`` (the text that stays), ``n_lines`` and ``n_dropped`` added; applies the bitmaps."""
    spark = docs.sparkSession
    small_batches(spark)
    maps = written(keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs, id_col=id_col, text_col=text_col), "line-keep")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"))
    # Most texts lose no line: a key filter tells them apart, and only the others are shuffled to their bitmaps.
    maybe = KeyFilter(maps.select(F.xxhash64("doc", "th").alias("h"))).column(F.xxhash64("doc", "th"))
    apply = F.pandas_udf(_apply, "kept string, n_lines long, n_dropped long")
    inner = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    whole = F.struct(inner.alias("kept"), F.size(F.split(inner, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    untouched = rows.where(~maybe).select("row", whole.alias("done"))
    joined = rows.where(maybe).join(maps.select("doc", "th", "keep"), ["doc", "th"], "left")
    both = untouched.unionByName(joined.select("row", apply(inner, F.col("keep")).alias("done")))
    added = [F.col("done")[c].alias(c) for c in ("kept", "n_lines", "n_dropped")]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    return both.select(*own, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: CTEs that give ``kept_lines`` (doc_id, n_lines, n_dropped, kept) from a view named in place of {docs}.
SQL_KEPT = r"""
split_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {docs}
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split_lines
), common AS (
  SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.stays AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k
), kept_lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)"""

SQL = f"""
WITH {SQL_KEPT.format(docs="documents")}
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM kept_lines
"""
