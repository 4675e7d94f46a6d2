"""Column functions over labels, banner texts and CSS values."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crumbtrail.plans.params import DOUBLE_NEGATIVES, GRADES



def _folded() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one character with marks, and that character."""
    pairs = []
    for first, last in ((0xA0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1FFF), (0xFF01, 0xFF5E)):
        for c in map(chr, range(first, last + 1)):
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(bare) == 1 and bare != c:
                pairs.append((c, bare))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


#: Letters with accents, and other forms of a character, and what they fold to.
ACCENTS = _folded()


def fold_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *ACCENTS), r"\p{M}+", "")


def normalize(text: Column) -> Column:
    """Lower case, without accents, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), r"[ \t\n\r]+", " "))


def folded(words: list[str]) -> list[str]:
    """The same for a list of terms; each once, in order."""
    bare = ("".join(x for x in unicodedata.normalize("NFKD", w) if not unicodedata.combining(x)) for w in words)
    return list(dict.fromkeys(" ".join(w.lower().split()) for w in bare))


def null_like(v: Column) -> Column:
    """Null for blank text and for ``nan`` in any case, which other tools write in place of a missing value."""
    v = F.regexp_replace(v, r"^\s+|\s+$", "")
    return F.when(~F.lower(v).isin("", "nan"), v)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def mentions(text: Column, words: list[str]) -> Column:
    """As contains_any(), in one expression however many words there are: for short texts such as labels and attributes."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def count_hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def words_per_sentence(text: Column) -> Column:
    """Mean number of words of the sentences; null without any."""
    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))), lambda s: s != "")
    words = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(F.split(s, " ")))
    return F.when(F.size(sentences) > 0, words / F.size(sentences))


def double_negatives(text: Column) -> list[Column]:
    """What each of the patterns finds first, or null."""
    return [F.nullif(F.regexp_extract(text, f"(?i)({p})", 1), F.lit("")) for p in DOUBLE_NEGATIVES]


def parse_px(v: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(v, r"([0-9]+\.?[0-9]*)", 1), F.lit("")).cast("double"), F.lit(0.0))


def font_weight(v: Column) -> Column:
    named = {"bold": 700, "bolder": 800, "normal": 400, "lighter": 300}
    out = F.when(F.regexp_like(v, F.lit("^[0-9]+$")), v.try_cast("int")).otherwise(400)
    for name, n in named.items():
        out = F.when(F.lower(v) == name, n).otherwise(out)
    return F.coalesce(out, F.lit(400))


_NAMED = {"white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "transparent": (255, 255, 255)}


def rgb(v: Column) -> list[Column]:
    """Red, green and blue of rgb(), rgba(), #rrggbb, #rgb and a few names; null for others."""
    s = F.lower(F.trim(v))
    out = []
    for i in range(3):
        channel = F.regexp_extract(s, r"^rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)", i + 1)
        long = F.conv(F.regexp_extract(s, r"^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})$", i + 1), 16, 10)
        short = F.regexp_extract(s, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", i + 1)
        value = F.when(s.startswith("rgb"), F.nullif(channel, F.lit("")).try_cast("int"))
        value = value.when(F.regexp_like(s, F.lit("^#[0-9a-f]{6}$")), long.try_cast("int"))
        value = value.when(F.regexp_like(s, F.lit("^#[0-9a-f]{3}$")), F.conv(F.concat(short, short), 16, 10).try_cast("int"))
        for name, c in _NAMED.items():
            value = value.when(s == name, c[i])
        out.append(value)
    return out


def luminance(c: list[Column]) -> Column:
    line = [F.when(x / 255 <= 0.03928, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4))) for x in c]
    return 0.2126 * line[0] + 0.7152 * line[1] + 0.0722 * line[2]


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast ratio; null if a colour cannot be read (greatest and least would skip it)."""
    la, lb = luminance(rgb(a)), luminance(rgb(b))
    return F.when(la.isNotNull() & lb.isNotNull(), (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05))


def grade(score: Column) -> Column:
    out = F.lit(GRADES[-1][1])
    for bound, name in GRADES[-2::-1]:
        out = F.when(score >= bound, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def safe_pct(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * n, d), F.lit(0.0))
