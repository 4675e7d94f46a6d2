"""Consent banners: elements, texts, buttons, platforms and dark patterns.

Markup is read once, by the standard parser inside tasks, into an array of elements with their
attributes, parents and texts; all rules are then column expressions over that array.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions import text as X
from crumbtrail.plans import params as P

ELEMENTS = "array<struct<pos: int, parent: int, tag: string, attrs: map<string, string>, text: string>>"
_SILENT = {"script", "style"}
_READ = {"button", "a", "input", "label"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects elements in document order, each with the stretch of the page's words that lies inside it; an end tag closes what
    is open inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []
        self.words: list[str] = []
        self.silent = 0

    def _close(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.found[i]["to"] = len(self.words)
            self.silent -= self.found[i]["tag"] in _SILENT
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = len(self.found)
        self.found.append({"pos": at, "parent": self.open[-1] if self.open else None, "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "from": len(self.words), "to": len(self.words)})
        if tag not in _VOID:
            self.open.append(at)
            self.silent += tag in _SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[i]]["tag"] == tag:
                self._close(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words += data.split()


def _read(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close(0)
    around = {e["parent"] for e in reader.found if e["tag"] == "input" and e["attrs"].get("type", "").lower() == "checkbox"}
    read = lambda e: e["tag"] in _READ or e["attrs"].get("role", "").lower() == "button" or e["pos"] in around
    return [{k: e[k] for k in ("pos", "parent", "tag", "attrs")} | {"text": " ".join(reader.words[e["from"] : e["to"]]) if read(e) else ""} for e in reader.found]


#: ELEMENTS, as tasks hand it back.
_ELEMENT = pa.struct([("pos", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


def _read_all(pages: pa.Array) -> pa.Array:
    """The elements of each page of a batch; markup that comes again in it is read once."""
    coded = pages.fill_null("").dictionary_encode()
    read = [[e | {"attrs": list(e["attrs"].items())} for e in _read(h)] for h in coded.dictionary.to_pylist()]
    return pa.array(read, pa.list_(_ELEMENT)).take(coded.indices)


def elements(html: Column) -> Column:
    """All elements of a page as an array of pos, parent (a pos, or null), tag, attrs and text: that of all inside it for what can
    be clicked, labels, and what stands around a check box, so that the array does not grow with the depth; empty for others.
    Names are lower case, attributes without a value have the empty one; broken markup gives what can be read."""
    return F.arrow_udf(_read_all, ELEMENTS)(html)


#: A start tag with attributes in double, single or no quotes.
TAG = r"""<([a-zA-Z][a-zA-Z0-9-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
_ATTRIBUTE = r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)"""


def html_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """A row per start tag of whole pages: position, lower-cased name and attributes. In the JVM alone, for pages at scale;
    elements() adds parents and texts."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit("(" + TAG + ")"), F.lit(1))
    df = pages.select(F.col(id_col), F.posexplode(tags).alias("pos", "raw")).withColumn("inside", F.regexp_extract("raw", TAG, 2))
    names = F.transform(F.regexp_extract_all("inside", F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all("inside", F.lit(_ATTRIBUTE), F.lit(2)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    # Of a name that comes twice the first counts.
    first = F.filter(F.arrays_zip(names.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))).alias("i")), lambda p: F.array_position(names, p["k"]) == p["i"])
    attrs = F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))
    return df.select(id_col, "pos", F.lower(F.regexp_extract("raw", TAG, 1)).alias("tag"), attrs.alias("attrs"))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t\n\r]+", " "))


def _first_platform(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, marks in reversed(P.CMP_SIGNATURES):
        out = F.when(X.contains_any(low, [m.lower() for m in marks]), name).otherwise(out)
    return out


def detect_cmp(html: Column, scripts: Column | None = None) -> Column:
    """The first platform, in order, of which a signature is in the page or in the addresses of its scripts (an array)."""
    both = html if scripts is None else F.concat_ws(" ", html, F.array_join(scripts, " "))
    return _first_platform(F.lower(both))


def detect_cmp_tokens(els: Column) -> Column:
    """The same by addresses of scripts and by ids, classes and data attributes alone, over elements()."""
    attr = lambda e, k: F.element_at(e["attrs"], k)
    scripts = F.transform(F.filter(els, lambda e: e["tag"] == "script"), lambda e: attr(e, "src"))
    data = lambda e: F.array_join(F.map_values(F.map_filter(e["attrs"], lambda k, v: k.startswith("data-"))), " ")
    tokens = F.transform(els, lambda e: F.concat_ws(" ", attr(e, "id"), attr(e, "class"), data(e)))
    return _first_platform(F.lower(F.concat_ws(" ", F.array_join(scripts, " "), F.array_join(tokens, " "))))


def _is_button(e: Column) -> Column:
    kind = F.lower(F.coalesce(F.element_at(e["attrs"], F.lit("type")), F.lit("")))
    return e["tag"].isin("button", "a") | ((e["tag"] == "input") & kind.isin("button", "submit")) | (F.lower(F.coalesce(F.element_at(e["attrs"], F.lit("role")), F.lit(""))) == "button")


def extract_buttons(banners: DataFrame) -> DataFrame:
    """A row per clickable element of a banner: position among them, element, tag, id, and its label: text, value or spoken label."""
    attr = lambda k: F.nullif(F.trim(F.element_at("b.attrs", k)), F.lit(""))
    df = banners.select("domain", F.posexplode(F.filter(elements(F.col("html")), _is_button)).alias("pos", "b"))
    label = F.coalesce(F.nullif("b.text", F.lit("")), attr("value"), attr("aria-label"), F.lit(""))
    return df.select("domain", "pos", F.col("b.pos").alias("element"), F.col("b.tag").alias("tag"), F.coalesce(attr("id"), F.lit("")).alias("id"), label.alias("label"))


def banner_summary(buttons: DataFrame, actions: DataFrame) -> DataFrame:
    """Per site: which actions its buttons offer, and the clicks that accepting and rejecting take (999: unreachable)."""
    has = lambda a: F.coalesce(F.bool_or(F.col("action") == a), F.lit(False))
    df = buttons.join(actions, "label", "left").groupBy("domain").agg(has("accept").alias("has_accept"), has("reject").alias("has_reject"), has("settings").alias("has_settings"))
    clicks = lambda c: F.when(F.col(c), 1).when(F.col("has_settings"), 2).otherwise(999)
    return df.withColumns({"accept_clicks": clicks("has_accept"), "reject_clicks": clicks("has_reject")})


def banner_like(text: Column, attrs: Column) -> tuple[Column, Column]:
    """Whether a text speaks of consent, and whether attributes hint at it."""
    return X.contains_any(X.normalize(text), X.folded(P.BANNER_WORDS + P.BANNER_PHRASES)), X.contains_any(X.normalize(attrs), X.folded(P.BANNER_HINTS))


def candidate_score() -> Column:
    """The evidence that an element is the consent banner, over its features: text, attrs, n_hints, accepts, rejects, settings,
    actions, fixed, dialog, edge, full_screen, nested, area_ratio, privacy_link."""
    c = F.col
    words = X.contains_any(X.normalize(c("text")), X.folded(P.BANNER_WORDS))
    like, hinted = banner_like(c("text"), c("attrs"))
    acts, area = c("actions") > 0, c("area_ratio")
    rules = [
        (like, 5), (words, 3), (hinted, 3), (c("accepts") > 0, 7), (c("rejects") > 0, 7), (c("settings") > 0, 4), (c("actions") >= 2, 2), (c("fixed"), 4),
        (c("dialog"), 3), ((area >= 0.03) & (area <= 0.95), 2), (area > 0.95, -4), (c("edge"), 2), (c("full_screen") & acts, -2), (c("nested"), -6),
        (c("dialog") & (area <= 0.8) & acts, 2), (~c("fixed") & ~c("dialog") & ~c("edge") & acts, -6), ((area < 0.02) & acts, -4),
        (~like & ~words & ~hinted & (c("n_hints") == 0) & acts, -3), (F.char_length("text") > 80, 1), (F.char_length("text") > 4000, -3), (c("privacy_link"), 1),
    ]
    score = F.when(c("n_hints") > 0, F.least(F.lit(5), c("n_hints") + 1)).otherwise(0)
    return reduce(lambda a, rule: a + F.when(F.coalesce(rule[0], F.lit(False)), rule[1]).otherwise(0), rules, score).cast("int")


def best_candidate(candidates: DataFrame, key: str, id_col: str) -> DataFrame:
    """The candidate of each page with most evidence; of equals the one without a nested surface, with more actions, like a
    dialog, with more hints, not over the full screen, and first."""
    order = [F.desc("score"), F.col("nested"), F.desc("actions"), F.desc("dialog"), F.desc("n_hints"), F.col("full_screen"), F.col(id_col)]
    df = candidates.withColumn("score", candidate_score())
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n_ = 1").drop("n_")


def pick_buttons(buttons: DataFrame) -> DataFrame:
    """The first accept and the first reject button of each banner, side by side, and whether any reject button is hidden."""
    cols = ["width", "height", "font_size", "font_weight", "color", "background"]
    first = lambda kind: F.min_by(F.struct(*cols), F.when(F.col("kind") == kind, F.col("pos")))
    only = lambda kind: F.when(F.count_if(F.col("kind") == kind) > 0, first(kind))
    return buttons.groupBy("domain").agg(only("accept").alias("a"), only("reject").alias("r"), F.bool_or((F.col("kind") == "reject") & hidden_style()).alias("hidden"))


def hidden_style() -> Column:
    """Whether a button's style hides it: not displayed, not visible, without extent, or in the colour of its background."""
    ink, ground = X.rgb(F.col("color")), X.rgb(F.col("background"))
    same = reduce(lambda x, y: x & y, [F.coalesce(a == b, F.lit(False)) for a, b in zip(ink, ground)])
    flat = (X.parse_px(F.col("width")) == 0) | (X.parse_px(F.col("height")) == 0)
    return F.coalesce(F.col("display") == "none", F.lit(False)) | F.coalesce(F.col("visibility") == "hidden", F.lit(False)) | flat | same


def asymmetric(pair: DataFrame) -> DataFrame:
    """D1: the reject button is much smaller, lighter or of poor contrast."""
    px = lambda b, c: X.parse_px(F.col(f"{b}.{c}"))
    area = lambda b: px(b, "width") * px(b, "height")
    font = lambda b: px(b, "font_size")
    ratio = lambda r, a: F.when(a > 0, r / a).otherwise(1.0)
    df = pair.withColumns(
        {
            "size_ratio": ratio(area("r"), area("a")),
            "font_ratio": ratio(font("r"), font("a")),
            "weight_diff": X.font_weight(F.col("a.font_weight")) - X.font_weight(F.col("r.font_weight")),
            "contrast": X.contrast(F.col("r.color"), F.col("r.background")),
        }
    )
    both = F.col("a").isNotNull() & F.col("r").isNotNull()
    flag = (F.col("size_ratio") < 0.7) | (F.col("font_ratio") < 0.85) | (F.col("weight_diff") > 200) | F.coalesce(F.col("contrast") < 3.0, F.lit(False))
    measures = [F.when(both, F.col(c)).alias(c) for c in ("size_ratio", "font_ratio", "weight_diff", "contrast")]
    return df.select("domain", *measures, F.coalesce(both & flag, F.lit(False)).alias("d1"), F.coalesce("hidden", F.lit(False)).alias("hidden"))


def compare_previews(previews: DataFrame) -> DataFrame:
    """(domain, source, issues) for each site with a button to accept. previews: domain, role (accept, reject, settings; at most one
    of each), width, height, font_size, font_weight, plain_link, clicks. Without a button to refuse, that to the settings stands for it."""
    from crumbtrail.functions import labels as L

    own = F.struct("width", "height", "font_size", "font_weight", "plain_link", "clicks")
    per = previews.groupBy("domain").agg(*[F.max(F.when(F.col("role") == r, own)).alias(r) for r in ("accept", "reject", "settings")]).where("accept IS NOT NULL")
    df = per.withColumn("source", L.reject_source(F.col("reject").isNotNull(), F.col("settings").isNotNull())).withColumn("other", F.coalesce("reject", "settings"))
    area = lambda b: F.col(f"{b}.width") * F.col(f"{b}.height")
    size = F.when((area("accept") > 0) & (area("other") > 0), area("other") / area("accept"))
    font = F.when(F.col("accept.font_size") > 0, F.col("other.font_size") / F.col("accept.font_size"))
    issues = L.button_issues(F.col("source"), F.col("settings.clicks"), size, font, F.col("accept.font_weight") - F.col("other.font_weight"), F.col("other.plain_link"))
    return df.select("domain", "source", issues.alias("issues"))


def _squeezed(e: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.element_at(e["attrs"], F.lit("style")), F.lit(""))), " ", "")


def _attr(e: Column, name: str) -> Column:
    return F.lower(F.coalesce(F.element_at(e["attrs"], F.lit(name)), F.lit("")))


def hidden_reject(els: Column, vocabulary: list[tuple] = P.VOCABULARY) -> Column:
    """D2 by markup: an element that reads like a refusal has a hiding class or style. vocabulary: (action, kind, terms)."""
    terms = [w.lower() for a, _, words in vocabulary if a == "reject" for w in words]
    hides = lambda e: X.mentions(_attr(e, "class"), P.HIDDEN_CLASSES) | X.contains_any(_squeezed(e), ["display:none", "visibility:hidden"])
    return F.exists(els, lambda e: e["tag"].isin("button", "a", "input") & X.mentions(F.lower(e["text"]), terms) & hides(e))


def labels_of(els: Column) -> Column:
    """The labels among the elements that name another one."""
    return F.filter(els, lambda e: (e["tag"] == "label") & F.map_contains_key(e["attrs"], F.lit("for")))


def preselected(els: Column, labels: Column | None = None) -> Column:
    """D4: how many boxes are checked beforehand that their label, or else the element around them, does not call necessary.
    labels: labels_of(els), if it is a column already."""
    labels = labels_of(els) if labels is None else labels
    box = lambda e: (e["tag"] == "input") & (_attr(e, "type") == "checkbox") & F.map_contains_key(e["attrs"], F.lit("checked"))
    label = lambda e: F.get(F.filter(labels, lambda x: F.element_at(x["attrs"], F.lit("for")) == F.element_at(e["attrs"], F.lit("id"))), F.lit(0))["text"]
    around = lambda e: F.get(els, e["parent"])["text"]
    words = [w.lower() for w in P.NECESSARY]
    name = lambda e: F.lower(F.coalesce(F.nullif(label(e), F.lit("")), around(e), F.lit("")))
    return F.size(F.filter(els, lambda e: box(e) & ~X.mentions(name(e), words)))


def forced_action(els: Column) -> Column:
    """D5: a wall that is fixed or fills the window, or a fixed blurring layer."""
    fixed = lambda e: F.contains(_squeezed(e), F.lit("position:fixed"))
    full = lambda e: X.contains_any(_squeezed(e), ["width:100%", "height:100%"])
    wall = lambda e: X.mentions(F.concat_ws(" ", _attr(e, "class"), _attr(e, "id")), P.WALL_WORDS)
    blur = lambda e: ~F.contains(_attr(e, "class"), F.lit("no-blur")) & X.contains_any(_attr(e, "class"), ["blur", "backdrop"])
    one = F.exists(els, lambda e: e["tag"].isin("div", "section", "aside") & wall(e) & (fixed(e) | full(e)))
    return one | F.exists(els, lambda e: e["tag"].isin("div", "section") & blur(e) & fixed(e))


def suspicious_phrases(html: Column, els: Column, vocabulary: list[tuple] = P.VOCABULARY, text: Column | None = None) -> Column:
    """D7: phrases that press or confuse, in order: guilt, each double negative, each ambiguous label. text: the visible text of
    html in lower case, if it is a column already."""
    text = F.lower(visible_text(html)) if text is None else text
    guilt = [F.when(F.contains(text, F.lit(p)), F.lit(f"guilt-trip: '{p}'")) for p in P.GUILT]
    twice = [F.when(x.isNotNull(), F.concat(F.lit("double-negative: '"), x, F.lit("'"))) for x in X.double_negatives(text)]
    vague = [w.lower() for a, _, words in vocabulary if a == "dismiss" for w in words]
    labels = F.transform(F.filter(els, lambda e: e["tag"].isin("button", "a", "input") & F.lower(e["text"]).isin(vague)), lambda e: F.concat(F.lit("ambiguous-button: '"), F.lower(e["text"]), F.lit("'")))
    return F.concat(F.array_compact(F.array(*guilt, *twice)), labels)


PATTERNS = ["asymmetric", "hidden_reject", "missing_reject", "preselected", "forced_action", "multi_layer", "confusing"]


def dark_patterns(banners: DataFrame, buttons: DataFrame, vocabulary: list[tuple] = P.VOCABULARY) -> DataFrame:
    """Seven flags per banner, their names in order, their number, the checked boxes, the click ratio and the phrases.
    Without a banner only two of them are looked at."""
    pair = asymmetric(pick_buttons(buttons)).select("domain", "d1", "hidden")
    # The elements and the text are read once, into columns of their own.
    df = banners.withColumn("els", elements(F.col("html"))).join(pair, "domain", "left").withColumns({"labels_": labels_of(F.col("els")), "text_": F.lower(visible_text(F.col("html")))})
    df = df.withColumns({"boxes": preselected(F.col("els"), F.col("labels_")), "phrases": suspicious_phrases(F.col("html"), F.col("els"), vocabulary, F.col("text_"))})
    flags = {
        "d1": F.coalesce("d1", F.lit(False)),
        "d2": F.coalesce("hidden", F.lit(False)) | hidden_reject(F.col("els"), vocabulary),
        "d3": ~F.col("found") | ~F.col("has_reject") | (F.col("reject_clicks") == 999),
        "d4": F.col("boxes") > 0,
        "d5": forced_action(F.col("els")),
        "d6": (F.col("accept_clicks") < 999) & (F.col("reject_clicks") > F.col("accept_clicks")),
        "d7": F.size("phrases") > 0,
    }
    df = df.withColumns(flags).withColumn("click_ratio", F.when((F.col("accept_clicks") > 0) & (F.col("accept_clicks") < 999), F.round(F.col("reject_clicks") / F.col("accept_clicks"), 2)))
    seen = [F.col("found") & F.col(f) if f not in ("d3", "d6") else F.col(f) for f in flags]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(seen, PATTERNS)]))
    return df.select("domain", *[c.alias(f) for c, f in zip(seen, flags)], names.alias("names"), "boxes", "click_ratio", "phrases").withColumn("n_patterns", F.size("names"))
