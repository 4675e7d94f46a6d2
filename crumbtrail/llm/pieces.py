"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text, with spaces as the marker character and one marker in front, falls into units
that start with markers and have none further on; no piece of the vocabulary reaches over
such a border, so units are encoded by themselves. All new units of a batch lie in one flat
numpy array of symbols. In each round every unit finds the least rank among its pairs
(a segmented minimum), merges the occurrences of it from the left, and the array is
compacted, until no unit has a pair left. Merges at the same rank happen together only as
long as none of them makes a pair that would have to come first. What remains outside the
vocabulary becomes byte pieces. A cache per worker, bounded in bytes, keeps encoded units.
Texts are taken a few at a time, and long ones in segments between units, so that what a
worker holds follows its longest text only by the text itself and its ids.

Defined cases: null and empty texts have no ids and decode to the empty text; null ids of
documents pass through; repeated rows are encoded alike; very long texts take more segments
and very long units more rounds; an empty table gives an empty table; asked-for columns
replace columns of the input that have the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crumbtrail.llm.common import small_batches, table
from crumbtrail.llm.ragged import RunCache, gather, slices

MARK = "▁"
#: Units start at markers and at line ends, which are in no piece of more than one character.
_UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
NONE = np.int64(1) << 40
#: Bytes of a worker's cache.
CACHE = 64 << 20
#: Characters of a segment of a text, and of the texts taken together.
SEGMENT = 1 << 20
#: A space between other characters than spaces, markers and line ends: a text may be cut there.
_CUT = re.compile(f"(?<=[^ {MARK}\n]) (?=[^ {MARK}\n])")


class Vocabulary:
    """Ranks and results of all pairs whose concatenation is a piece; ids of characters and bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.size = size
        if any(MARK in p.lstrip(MARK) or "\n" in p[:-1] + p[1:] for p in self.ids):
            raise ValueError("a piece holds a line end, or the marker behind other characters")
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k]), self.symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 22 | b] = (order[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        found = [pairs[k] for k in self.keys.tolist()]
        self.ranks = np.array([x[0] for x in found], np.int64)
        self.merged = np.array([x[1] for x in found], np.int64)

    def symbol(self, s: str) -> int | None:
        """A piece's id; a character outside the vocabulary is the size plus its code point."""
        return self.ids.get(s, self.size + ord(s) if len(s) == 1 else None)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 if their concatenation is no piece."""
        key = left << 22 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.look(left, right)
        return np.where(at >= 0, self.ranks[at], NONE)

    def encode(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units (not empty), by merge rounds over all of them at once."""
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol(chr(c)) for c in kinds], np.int64)[back]
        word = np.repeat(np.arange(len(units)), [len(u) for u in units])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self._ranks(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            open_ = np.repeat(least < NONE, lengths)
            if 2 * np.count_nonzero(open_) < len(sym):
                done.append((word[~open_], sym[~open_]))
                sym, word, rank = sym[open_], word[open_], rank[open_]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                least, lengths = least[least < NONE], np.diff(np.r_[starts, len(sym)])
            best = np.repeat(least, lengths)
            hit = np.flatnonzero((rank == best) & (rank < NONE))
            # Of pairs that overlap, every second one of the run, from its left end.
            run = np.r_[True, np.diff(hit) != 1]
            first = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
            hit = hit[(hit - first) % 2 == 0]
            new = self.merged[self.look(sym[hit], sym[hit + 1])]
            # A pair made now that ranks no later than the one merged must be seen before
            # the merges further right: these wait for the next round.
            after = hit + 2
            right_in = (after < len(sym)) & (word[np.minimum(after, len(sym) - 1)] == word[hit])
            right = np.where(right_in, self.rank(new, sym[np.minimum(after, len(sym) - 1)]), NONE)
            before = hit - 1
            left_in = (before >= 0) & (word[np.maximum(before, 0)] == word[hit])
            joined = np.r_[False, np.diff(hit) == 2] & left_in
            left_sym = np.where(joined, np.r_[0, new[:-1]], sym[np.maximum(before, 0)])
            left = np.where(left_in, self.rank(left_sym, new), NONE)
            unsafe = np.minimum(left, right) <= rank[hit]
            if unsafe.any():
                own = word[hit]
                begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                earlier = np.cumsum(unsafe) - unsafe
                ok = earlier == np.repeat(earlier[begin], np.diff(np.r_[begin, len(hit)]))
                hit, new = hit[ok], new[ok]
            sym[hit] = new
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank = sym[stay], word[stay], rank[stay]
            changed = np.unique(np.r_[place[hit], np.maximum(place[hit] - 1, 0)])
            rank[changed] = self._ranks_at(sym, word, changed)
        if done:
            word, sym = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(word, kind="stable")
            word, sym = word[order], sym[order]
        return self._split(word, sym, len(units))

    def _ranks_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(sym) - 1)
        inside = (nxt > at) & (word[nxt] == word[at])
        return np.where(inside, self.rank(sym[at], sym[nxt]), NONE)

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._ranks_at(sym, word, np.arange(len(sym)))

    def _split(self, word: np.ndarray, sym: np.ndarray, n: int) -> list[np.ndarray]:
        """The ids of each unit."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            # Characters outside the vocabulary: their UTF-8 bytes' pieces in their place.
            spelled = [self.bytes[list(chr(c).encode())] for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in spelled]
            at = np.repeat(sym >= self.size, times)
            word, sym = np.repeat(word, times), np.repeat(sym, times)
            sym[at] = np.concatenate(spelled)
        bounds = np.searchsorted(word, np.arange(1, n))
        return np.split(sym.astype(np.int32), bounds)


class Codec:
    """A vocabulary with its cache and the decimal form of its ids."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.cache = RunCache(self._encode, CACHE)
        names = [f"{i},".encode() for i in range(self.vocabulary.size)]
        self.width = np.array([len(n) for n in names], np.int64)
        self.offset = np.cumsum(self.width) - self.width
        self.decimal = np.frombuffer(b"".join(names), np.uint8)

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        # Blocks bound the arrays; long units go with few others.
        out, block, chars = [], [], 0
        for u in units:
            block.append(u if u[:1] == "\n" else MARK + u)
            chars += len(u) + 1
            if chars > 200_000:
                out += self.vocabulary.encode(block)
                block, chars = [], 0
        return out + self.vocabulary.encode(block) if block else out

    def ids(self, texts: list[str]) -> list[list[np.ndarray]]:
        """The ids of each text, segment by segment."""
        split = [segments(t) for t in texts]
        flat = [s for own in split for s in own]
        coded: list[np.ndarray] = []
        for a, b in slices(np.array([len(s) for s in flat], np.int64), 1 << 12, SEGMENT):
            coded += self._segment_ids(flat[a:b])
        ends = np.cumsum([len(own) for own in split]).tolist()
        return [coded[b - len(own) : b] for own, b in zip(split, ends)]

    def _segment_ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [units_of(t) for t in texts]
        counts = np.array([len(u) for u in split], np.int64)
        flat, lengths = self.cache.runs(pa.array(list(chain.from_iterable(split)), pa.string()))
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def sha256(self, ids: list[np.ndarray]) -> str:
        """The digest of all ids in decimal, joined by commas."""
        h = hashlib.sha256()
        for i, part in enumerate(ids):
            h.update((b"," if i else b"") + self.decimals(part))
        return h.hexdigest()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(self.decimal, self.offset[ids], self.width[ids]).tobytes()[:-1]

    def decode(self, ids: list[np.ndarray]) -> str:
        """The text of ids in segments. The library drops the marker that each segment begins with: a space of the text."""
        return " ".join(self.vocabulary.library.decode(part.tolist()) for part in ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def segments(text: str) -> list[str]:
    """The text in pieces of about SEGMENT characters; the single spaces between them are left out."""
    out, a = [], 0
    while len(text) - a > SEGMENT and (cut := _CUT.search(text, a + SEGMENT)):
        out.append(text[a : cut.start()])
        a = cut.end()
    return [*out, text[a:]] if a else [text]


def units_of(text: str) -> list[str]:
    """Units without their first marker; those that start with a line end have none."""
    words = text.replace("\n", " \n").split(" ")
    if "" in words or MARK in text:
        return [u if u[0] == "\n" else u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))] if text else []
    return words


#: What encode can add, with its type.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded"), text_col: str = "text") -> DataFrame:
    """docs without the text, with the asked-for outputs of encoding and decoding it. model: a path that is there on every worker."""
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in docs.columns if c != text_col and c not in outputs]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField(c, OUTPUTS[c]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for whole in batches:
            length = pc.fill_null(pc.binary_length(whole.column(len(own))), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(length, 256, SEGMENT):
                batch = whole.slice(a, b - a)
                own_codec = codec(model)
                ids = own_codec.ids([t or "" for t in batch.column(len(own)).to_pylist()])
                made = {}
                if "ids" in outputs:
                    made["ids"] = [np.concatenate(i) for i in ids]
                if "n_tokens" in outputs:
                    made["n_tokens"] = [sum(map(len, i)) for i in ids]
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = [own_codec.sha256(i) for i in ids]
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    texts = [own_codec.decode(i) for i in ids]
                    made["decoded"] = texts
                    made["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                columns = [batch.column(i) for i in range(len(own))] + [pa.array(made[c], target.field(c).type) for c in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(*own, F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))
