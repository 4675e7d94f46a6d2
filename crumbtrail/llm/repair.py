"""Re-Pair grammar compression of arrays of ids, in rounds over whole arrays."""

from __future__ import annotations

import numpy as np

from crumbtrail.llm.ragged import gather

_MULT = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, first: int, min_count: int = 8, least_gain: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, lengths): rule r stands for the id ``first + r``, is a pair of ids, and expands to lengths[r] ids.

    Each round counts all pairs and replaces those found at least ``min_count`` times; where two
    overlap, the more frequent one goes first. It ends when a round shortens the sequence by less
    than ``least_gain`` of its length.
    """
    seq = ids.astype(np.int64)
    rules, lengths = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    made = 0
    size = np.zeros(0, np.int64)
    while len(seq) > 2 * min_count:
        key = seq[:-1] << 32 | seq[1:]
        # Most rare pairs go by a count of hash bins, before the exact one.
        bins = ((key.view(np.uint64) * _MULT) >> np.uint64(46)).astype(np.int64)
        often = np.flatnonzero(np.bincount(bins, minlength=1 << 18)[bins] >= min_count)
        pairs, at, counts = np.unique(key[often], return_inverse=True, return_counts=True)
        good = counts[at] >= min_count
        often, at = often[good], at[good]
        if not len(often):
            break
        order = np.empty(len(pairs), np.int64)
        order[np.lexsort((pairs, counts))] = np.arange(1, len(pairs) + 1)
        rank = np.zeros(len(key) + 2, np.int64)
        rank[often + 1] = order[at]
        here = rank[often + 1]
        win = (here >= rank[often]) & (here >= rank[often + 2])
        chosen, at = often[win], at[win]
        # What still overlaps is one pair of equal ids in a run: every second of it.
        run = np.r_[True, np.diff(chosen) != 1]
        start = chosen[np.flatnonzero(run)][np.cumsum(run) - 1]
        even = (chosen - start) % 2 == 0
        chosen, at = chosen[even], at[even]
        left = np.bincount(at, minlength=len(pairs)) >= min_count
        pick = left[at]
        chosen, at = chosen[pick], at[pick]
        if len(chosen) < max(1, least_gain * len(seq)):
            break
        number = np.cumsum(left) - 1
        rule = np.column_stack([pairs[left] >> 32, pairs[left] & 0xFFFFFFFF])
        known = np.where(rule >= first, size[np.maximum(rule - first, 0)] if made else 1, 1)
        rules.append(rule)
        lengths.append(known.sum(1))
        seq[chosen] = first + made + number[at]
        stay = np.ones(len(seq), bool)
        stay[chosen + 1] = False
        seq = seq[stay]
        made += len(rule)
        size = np.concatenate(lengths)
    return seq.astype(np.uint32), np.concatenate(rules).astype(np.uint32), np.concatenate(lengths).astype(np.uint32)


def _passes(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """A sequence with its nonterminals replaced, level after level."""
    seq = seq.astype(np.int64)
    while True:
        rule = seq >= first
        if not rule.any():
            return seq
        times = np.where(rule, 2, 1)
        at = np.cumsum(times) - times
        out = np.empty(int(times.sum()), np.int64)
        out[at[~rule]] = seq[~rule]
        pair = rules[seq[rule] - first]
        out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that a sequence stands for: all rules are expanded once, then the sequence in one pass."""
    table = np.r_[np.arange(first), _passes(first + np.arange(len(rules)), rules, first)].astype(np.uint32)
    size = np.r_[np.ones(first, np.int64), lengths.astype(np.int64)]
    start = np.cumsum(size) - size
    return gather(table, start[seq], size[seq])


def expand_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int, end: int) -> np.ndarray:
    """Ids start..end of the expansion; only what reaches into the range is expanded."""
    seq = seq.astype(np.int64)
    base = 0
    while len(seq):
        size = np.where(seq >= first, lengths[np.maximum(seq - first, 0)], 1) if len(lengths) else np.ones(len(seq), np.int64)
        ends = base + np.cumsum(size.astype(np.int64))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        base = int(ends[a - 1]) if a else base
        seq = seq[a:b]
        rule = seq >= first
        if not rule.any():
            return seq[start - base : end - base].astype(np.uint32)
        times = np.where(rule, 2, 1)
        at = np.cumsum(times) - times
        out = np.empty(int(times.sum()), np.int64)
        out[at[~rule]] = seq[~rule]
        pair = rules[seq[rule] - first]
        out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq.astype(np.uint32)
