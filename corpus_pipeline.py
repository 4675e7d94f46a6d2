"""A training corpus from raw documents, stage by stage; each stage is one operator of crumbtrail.llm.

Every stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and works on
all that the stage before it kept. All but the last return those columns again; other columns of
docs are left out. Null and empty texts are documents like others; an empty table gives an empty
table; equal rows are treated alike, but for the near-duplicate stage, which keeps one of them.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crumbtrail.llm import decontaminate, jaccard, lines, pieces, quality
from crumbtrail.llm.common import KeyFilter, collected, drop_tables, new_path, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: What the stage before made beside its rows, by thread: it goes once those rows are stored.
_beside = threading.local()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the tables of the stage before it, whose rows are stored by now."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, getattr(_beside, "paths", []))
        _beside.paths = []
        with collected(_beside.paths):
            return work(spark, docs, sf_dir)

    return run


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for rows whose (doc_id, th) is in gone. Only rows that may be are shuffled to meet it."""
    gone = written(gone.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_")).distinct(), "gone")
    maybe = KeyFilter(gone.select(F.xxhash64("d_", "t_").alias("h"))).column(F.xxhash64("doc_id", _hash()))
    same = F.col("doc_id").eqNullSafe(F.col("d_")) & (_hash() == F.col("t_"))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, same, "left_anti")).select(*COLUMNS)


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is judged as an empty one."""
    stats = written(quality.with_statistics(docs.select("doc_id", "text")), "quality-stats")
    model = quality.fit_labelled(stats, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_text(model)(F.col("text")) >= 0.7).select(*COLUMNS)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows. A document left without any text stays, empty."""
    done = lines.dedup_lines(docs.select(*COLUMNS))
    cut = F.col("n_dropped") > 0
    length = F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))).select(*COLUMNS)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id (null ids last), of rows that share it the one with the
    least text hash, of rows equal in both any one. Texts without words are in no group and stay."""
    done = written(jaccard.near_duplicates(docs).where("group IS NOT NULL").select("doc_id", "th", "group"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    groups = done.groupBy("group").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(done.join(groups, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))), "members")
    kept = _without(docs, members.where("NOT stays"))
    # Rows that repeat id and text.
    again = members.where("stays").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    maybe = KeyFilter(again.select(F.xxhash64("doc_id", "th").alias("h"))).column(F.xxhash64("doc_id", _hash()))
    some = kept.where(maybe).withColumn("th_", _hash())
    one = some.withColumn("n_", F.row_number().over(Window.partitionBy("doc_id", "th_").orderBy("lang", "source", "n_chars")))
    # The filter may let others pass: rows without words keep their repeats.
    words = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return kept.where(~maybe).unionByName(one.where((F.col("n_") == 1) | ~F.coalesce(words, F.lit(False))).select(*COLUMNS))


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = docs.select(F.to_json(F.struct("doc_id", _hash().alias("th"))).alias("row"), "text")
    hits = decontaminate.find_items(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return _without(docs, hits.select(F.from_json("doc_id", "doc_id long, th long").alias("r")).select("r.doc_id", "r.th"))


@_stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as ids, with the text that they decode to."""
    import public_tokenizers

    return pieces.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), ("ids", "n_tokens", "decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: SQL can express neither the classifier nor the encoding; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet and read again.

    What a stage kept aside is removed as soon as its rows are stored.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        path = new_path(spark, "stage-" + name.split()[0])
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
