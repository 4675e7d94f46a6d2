"""Quality scores from random Fourier features of document statistics.

Whole texts become a fixed vector of statistics. Random Fourier features of it approximate
a Gaussian kernel; normal equations are summed over partitions and solved as ridge
regression; isotonic regression over out-of-fold values turns the ridge value into a score
from 0 to 1. The fit uses at most about ``max_train`` labelled rows, taken by a hash of the id.

Defined cases: a null text is scored like the empty text; labels that are null do not count,
several labels of one id count as their mean; documents without label are only scored; with
no labelled row at all every score is 1, as nothing speaks against any document; equal texts
get equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crumbtrail.llm.common import fold, small_batches, table, written

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    "digit": b"0123456789",
    "stop": b".,;:?",
    "excl": b"!",
    "symbol": b"#*$%&|<>",
    "other": b"\"'()[]{}@^~`_-+=/\\",
    "space": b" ",
}
_LOOK = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _LOOK[list(_chars)] = _i
STATISTICS = [f"share_{c}" for c in _CLASSES] + [
    "log_words", "word_bytes", "long_words", "distinct_words", "top_word", "word_again", "windows_again",
    "line_bytes", "lines_again", "short_lines",
]
_BINS = 4096


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = max(len(raw), 1)
    kinds = np.bincount(_LOOK[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES) + 1)[:-1] / n
    words = raw.split()
    m = max(len(words), 1)
    tally = Counter(words)
    windows = max(len(words) - 2, 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return [
        *np.sqrt(kinds).tolist(),
        np.log1p(len(words)),
        len(b"".join(words)) / m,
        sum(c for w, c in tally.items() if len(w) > 14) / m,
        # What is left of the distinct share when its fall with length is taken out.
        np.log1p(len(tally)) / np.log1p(m),
        max(tally.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m,
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if len(words) > 2 else 0.0,
        np.log1p(sum(map(len, lines)) / k),
        1 - len(set(lines)) / k if lines else 0.0,
        sum(len(x) < 20 for x in lines) / k,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with ``stats``, an array in the order of STATISTICS."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in (text_col, "stats")]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(len(own)).to_pylist()]
            columns = [batch.column(i) for i in range(len(own))] + [pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(*own, F.col(text_col)).mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: list[np.ndarray]
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.beta[2]
        # The last thousandth keeps the order within flat parts of the isotonic fit.
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to y with weights w, by pooling adjacent violators."""
    means: list[float] = []
    sizes: list[float] = []
    spans: list[int] = []
    for a, b in zip(y.tolist(), w.tolist()):
        means.append(a)
        sizes.append(b)
        spans.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            m, s, n = means.pop(), sizes.pop(), spans.pop()
            means[-1] = (means[-1] * sizes[-1] + m * s) / (sizes[-1] + s)
            sizes[-1] += s
            spans[-1] += n
    return np.repeat(means, spans)


def fit(train: DataFrame, *, features: int = 384, width: float = 5.0, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """train: half (0 or 1), y (double), stats. None if there is no row."""
    if train.isEmpty():
        return None
    # A bounded number of rows: a few tasks, each of which sends one set of sums.
    train = train.select("half", "y", "stats").repartition(16)
    dims = len(STATISTICS)
    moments = train.agg(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(dims) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    model = Model(
        np.array([moments[f"m{i}"] for i in range(dims)]),
        np.array([max(moments[f"s{i}"], 1e-3) for i in range(dims)]),
        rng.normal(0, 1 / width, (dims, features)),
        rng.uniform(0, 2 * np.pi, features),
        [],
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, features + 1, features + 2))
        for pdf in batches:
            for half in (0, 1):
                own = pdf[pdf.half == half]
                if len(own):
                    f = model.features(np.stack(own.stats.to_numpy()))
                    total[half] += f.T @ np.column_stack([f, own.y.to_numpy()])
        yield pd.DataFrame([(h, i, total[h, i].tobytes()) for h in (0, 1) for i in range(features + 1)], columns=["half", "i", "row"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = sum(np.frombuffer(r) for r in pdf.row)
        return pd.DataFrame([(pdf.half.iloc[0], pdf.i.iloc[0], row.tobytes())], columns=["half", "i", "row"])

    parts = train.mapInPandas(sums, "half int, i int, row binary").groupBy("half", "i").applyInPandas(add, "half int, i int, row binary").collect()
    both = np.zeros((2, features + 1, features + 2))
    for r in parts:
        both[r.half, r.i] = np.frombuffer(r.row)
    for s in (both[0], both[1], both[0] + both[1]):
        count = max(s[-1, -2], 1.0)
        penalty = np.eye(features + 1) * ridge * count / features
        penalty[-1, -1] = 1e-9 * count + 1e-12
        model.beta.append(np.linalg.solve(s[:, :-1] + penalty, s[:, -1]))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                f = model.features(np.stack(pdf.stats.to_numpy()))
                half = pdf.half.to_numpy()
                # Each half is predicted by the fit to the other one.
                raw = np.where(half == 0, f @ model.beta[1], f @ model.beta[0])
                yield pd.DataFrame({"bin": np.clip((raw + 1) / 3 * _BINS, 0, _BINS - 1).astype(np.int32), "y": pdf.y.to_numpy()})

    bins = train.mapInPandas(held, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    w = np.array([b.n for b in bins], float)
    model.knots = np.array([(b.bin + 0.5) * 3 / _BINS - 1 for b in bins])
    model.values = isotonic(np.array([b.y for b in bins]) / w, w)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """stats with ``score`` in place of the statistics."""
    own = [c for c in stats.columns if c not in ("stats", "score")]
    if model is None:
        return stats.select(*own, F.lit(1.0).alias("score"))

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.score(np.stack(x.to_numpy())), 0, 1) if len(x) else [], dtype=float)

    return stats.select(*own, F.pandas_udf(run, "double")("stats").alias("score"))


def score_text(model: Model | None) -> Callable[[Column], Column]:
    """A function from the text column to its score, for use where nothing else should pass through Python."""
    if model is None:
        return lambda text: F.lit(1.0)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.score(np.array([statistics(t or "") for t in texts])), 0, 1) if len(texts) else [], dtype=float)

    return F.pandas_udf(run, "double")


def fit_labelled(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_train: int = 200_000) -> Model | None:
    """stats: id and statistics of the documents whose labels may be used."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.avg(label_col).cast("double").alias("y"))
    n = known.count()
    if n > max_train:
        # The sample is taken before anything meets: only its rows are written and read again.
        known = known.where(F.pmod(F.xxhash64("key", F.lit("train")), F.lit(1_000_000)) < int(1e6 * max_train / n))
    train = stats.select(F.col(id_col).alias("key"), "stats").join(known, "key")
    return fit(written(train.withColumn("half", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int")), "quality-train"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column | None = None,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = 200_000,
) -> DataFrame:
    """docs without the text, with ``score`` and ``predicted``. learn: which documents' labels may be used (default: all)."""
    own = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    marked = docs.withColumn("learn_", F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True))
    stats = written(with_statistics(marked.select(*own, "learn_", text_col), text_col), "quality-stats")
    model = fit_labelled(stats.where("learn_"), labels, id_col=id_col, label_col=label_col, max_train=max_train)
    done = score(stats.drop("learn_"), model)
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 4) == 2
    done = classify(docs, table(spark, sf_dir, "labels"), learn=~held)
    return done.select("doc_id", held.alias("held_out"), "score", "predicted")
