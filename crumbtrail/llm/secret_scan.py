"""Secret scans: three rules of form, and character Markov models of random strings and of ordinary identifiers.

The rules find assignments of a password or key, access keys, and long runs of hexadecimal
digits. Beyond them, every run of the characters that keys are made of is scored by
two character models of second order: one of random strings, one of what texts are written
in. The sum of their log-likelihood ratios is the evidence, in bits; a run with at least
``bits`` of it is a span of kind ``random``, and if a whole run falls short, its segment with
most evidence is one if that alone reaches it.

Labelled samples train the models. Those of the query come from the documents, all of them:
the values that the rules find are random ones, the runs outside their matches ordinary ones;
``random_samples`` adds strings of alphabets that the rules do not know. ``model`` takes any
others. What is counted are transitions between 69 symbols, a table of fixed size that each
task sums up, so neither the corpus nor a group of copies passes through one task.

Defined cases: a null or empty text has no span; spans of one kind never overlap; kinds of
rules may overlap each other, spans of the models overlap none of theirs; code points count,
the end is exclusive; equal rows get equal rows; an empty table gives an empty table; other
columns are ignored. A text longer than ``_SEGMENT`` bytes is scored in segments that end
between runs, so its length is no matter of memory beyond that of its longest run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.common import small_batches, table

#: The rules, their order and their least lengths (fixed values). Lower-cased texts are matched with the first.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = b"0123456789abcdef"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: What keys are made of (fixed value): the symbols of the models. One more stands for all else.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_K = len(ALPHABET) + 1
_OTHER = _K - 1
_CODE = np.full(256, _OTHER, np.int32)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(_OTHER)
_IS_HEX = np.zeros(256, bool)
_IS_HEX[np.frombuffer(HEX, np.uint8)] = True
_SEGMENT = 4 << 20


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def base_spans(data: bytes) -> np.ndarray:
    """Rows (kind, start, end, start of the value) of the rules' matches, in bytes; by start, then kind."""
    found = [(0, m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= LEAST["assign"]]
    found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    a, b = _edges(_IS_HEX[np.frombuffer(data, np.uint8)])
    long = b - a >= LEAST["hex"]
    found += [(2, s, e, s) for s, e in zip(a[long].tolist(), b[long].tolist())]
    return np.array(sorted(found, key=lambda x: (x[1], x[0])), np.int64).reshape(-1, 4)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts behind one another with a line feed between, which no match and no run crosses; and where each begins."""
    return b"\n".join(texts), np.cumsum([0, *[len(t) + 1 for t in texts]])


def _keys(codes: np.ndarray) -> np.ndarray:
    """For each position the transition from the two symbols before it; what lies before a run counts as one symbol."""
    before = np.r_[np.int32(_OTHER), codes[:-1]]
    two = np.where(before == _OTHER, np.int32(_OTHER), np.r_[np.int32(_OTHER), before[:-1]])
    return (two * _K + before) * _K + codes


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about _SEGMENT bytes that end where no run goes on."""
    at = 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and _CODE[data[end]] != _OTHER:
            end += 1
        yield at, end
        at = end


def _masked(codes: np.ndarray, spans: np.ndarray, value_only: bool) -> np.ndarray:
    """Whether each position lies in a span."""
    steps = np.zeros(len(codes) + 1, np.int32)
    np.add.at(steps, spans[:, 3 if value_only else 1], 1)
    np.add.at(steps, spans[:, 2], -1)
    return np.cumsum(steps[:-1]) > 0


def _transitions(codes: np.ndarray, counts: np.ndarray) -> None:
    counts += np.bincount(_keys(codes)[codes != _OTHER], minlength=_K**3)


def _emit(random: np.ndarray, ordinary: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(random + ordinary)
    return pd.DataFrame({"key": at, "random": random[at], "ordinary": ordinary[at]})


def _count_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    random, ordinary = np.zeros(_K**3, np.int64), np.zeros(_K**3, np.int64)
    for pdf in batches:
        data, _ = _joined(pdf.text.tolist())
        spans = base_spans(data)
        for a, b in _segments(data):
            codes = _CODE[np.frombuffer(data, np.uint8, b - a, a)]
            near = spans[(spans[:, 1] < b) & (spans[:, 2] > a)].copy()
            near[:, 1:] = np.clip(near[:, 1:] - a, 0, b - a)
            _transitions(np.where(_masked(codes, near, False), _OTHER, codes), ordinary)
            if len(near):
                _transitions(np.where(_masked(codes, near, True), codes, _OTHER), random)
    yield _emit(random, ordinary)


def _count_samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = [np.zeros(_K**3, np.int64), np.zeros(_K**3, np.int64)]
    for pdf in batches:
        for label in (0, 1):
            data, _ = _joined(pdf.text[pdf.label == label].tolist())
            for a, b in _segments(data):
                _transitions(_CODE[np.frombuffer(data, np.uint8, b - a, a)], counts[label])
    yield _emit(counts[1], counts[0])


_COUNTS = "key long, random long, ordinary long"


def _bytes(c: str):
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Transitions of the samples that the rules label: values of matches are random, runs outside matches ordinary."""
    small_batches(docs.sparkSession)
    return docs.select(_bytes(text_col).alias("text")).mapInPandas(_count_texts, _COUNTS)


def sample_counts(samples: DataFrame) -> DataFrame:
    """Transitions of samples (text, label: 1 random, 0 ordinary)."""
    small_batches(samples.sparkSession)
    return samples.where("label IN (0, 1)").select(_bytes("text").alias("text"), F.col("label").cast("int")).mapInPandas(_count_samples, _COUNTS)


def random_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """n random strings of each of five alphabets, the same ones at each call: digests in the ways that keys are written."""
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    base64 = lambda salt: F.base64(digest(salt))
    forms = [
        base64("a"),
        F.translate(base64("b"), "+/=", "-_"),
        F.regexp_replace(base64("c"), "[+/=]", ""),
        F.upper(F.regexp_replace(base64("d"), "[+/=01]", "")),
        F.lower(F.regexp_replace(base64("e"), "[+/=]", "")),
    ]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("text"), F.lit(1).alias("label"))


def _probabilities(n: np.ndarray) -> np.ndarray:
    """log2 of the next symbol's probability after two symbols, each order smoothed by the one below."""
    n3 = n.reshape(_K, _K, _K).astype(np.float64)
    n2 = n3.sum(0)
    n1 = n2.sum(0)
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * _K)
    p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
    p3 = (n3 + 8 * p2) / (n3.sum(2, keepdims=True) + 8)
    return np.log2(p3).ravel()


def model(counts: DataFrame) -> np.ndarray:
    """The log-likelihood ratios, in bits, from counts of transitions: _K^3 numbers, whatever the number of samples."""
    summed = counts.groupBy("key").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).toPandas()
    both = np.zeros((2, _K**3), np.int64)
    both[:, summed.key.to_numpy(np.int64)] = summed[["random", "ordinary"]].to_numpy(np.int64).T
    return (_probabilities(both[0]) - _probabilities(both[1])).astype(np.float32)


def best_segment(evidence: np.ndarray) -> tuple[float, int, int]:
    """The stretch with the largest sum, and that sum."""
    sums = np.cumsum(np.r_[0.0, evidence])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return float(sums[end] - sums[start]), start, end


def random_spans(data: bytes, base: np.ndarray, ratios: np.ndarray, min_chars: int, bits: float) -> list[tuple[int, int, float]]:
    """(start, end, evidence) of what the models find outside the base spans, in bytes."""
    out = []
    for a, b in _segments(data):
        codes = _CODE[np.frombuffer(data, np.uint8, b - a, a)]
        near = base[(base[:, 1] < b) & (base[:, 2] > a)].copy()
        if len(near):
            near[:, 1:] = np.clip(near[:, 1:] - a, 0, b - a)
            codes = np.where(_masked(codes, near, False), _OTHER, codes)
        starts, ends = _edges(codes != _OTHER)
        long = ends - starts >= min_chars
        starts, ends = starts[long], ends[long]
        if not len(starts):
            continue
        evidence = ratios[_keys(codes)].astype(np.float64)
        # A run whose positive evidence falls short has no segment that reaches the bound.
        most = np.cumsum(np.r_[0.0, np.maximum(evidence, 0)])
        for s, e in zip(*(x[most[ends] - most[starts] >= bits] for x in (starts, ends))):
            total = float(evidence[s:e].sum())
            if total < bits:
                total, i, j = best_segment(evidence[s:e])
                if j - i < min_chars:
                    continue
                s, e = s + i, s + j
            if total >= bits:
                out.append((a + int(s), a + int(e), total))
    return out


_OUT = ["n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string", "n_random long", "random_bits double"]


def _scanner(shared: Broadcast, min_chars: int, bits: float):
    def run(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        data, begins = _joined(texts)
        base = base_spans(data)
        more = random_spans(data, base, shared.value, min_chars, bits)
        rows = [(int(s), int(k), int(e), 0.0) for k, s, e, _ in base] + [(s, 3, e, x) for s, e, x in more]
        of = np.searchsorted(begins, [r[0] for r in rows], side="right") - 1 if rows else []
        own: dict[int, list] = {}
        for d, r in zip(of, rows):
            own.setdefault(int(d), []).append(r)
        nothing = hashlib.sha256(b"").hexdigest()
        out = [(0, 0, 0, nothing, "", 0, 0.0)] * len(texts)
        for d, found in own.items():
            raw = np.frombuffer(texts[d], np.uint8)
            # Bytes that begin a code point, before each position.
            points = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])
            found.sort()
            named = [(k, f"{KINDS[k]}:{points[s - begins[d]]}:{points[e - begins[d]]}") for s, k, e, _ in found]
            n = np.bincount([k for k, _ in named], minlength=4).tolist()
            rules = ",".join(x for k, x in named if k < 3)
            out[d] = (*n[:3], hashlib.sha256(rules.encode()).hexdigest(), ",".join(x for _, x in named), n[3], max(x for *_, x in found))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT])

    return run


def scan(docs: DataFrame, ratios: np.ndarray, *, min_chars: int = 16, bits: float = 24.0, text_col: str = "text") -> DataFrame:
    """The rows of docs with n_assign, n_access, n_hex, base_sha256, spans, n_random and random_bits (the most evidence of a
    span of the models) added. 24 bits: one string in 17 million may look that random by chance."""
    spark = docs.sparkSession
    small_batches(spark)
    find = F.pandas_udf(_scanner(spark.sparkContext.broadcast(ratios), min_chars, bits), ", ".join(_OUT))
    names = [c.split()[0] for c in _OUT]
    own = [F.col("row_").getField(c).alias(c) for c in docs.columns if c not in names]
    return docs.select(F.struct("*").alias("row_"), find(_bytes(text_col)).alias("found_")).select(*own, *[F.col("found_").getField(c).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = model(corpus_counts(docs).unionByName(sample_counts(random_samples(spark))))
    return scan(docs, ratios).select("doc_id", *[c.split()[0] for c in _OUT])
