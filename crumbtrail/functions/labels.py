"""Phrases for percentages, budgets and buttons, from tables of bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands and phrases that reports carry.
SHARES = [(90, "Nearly all sites"), (70, "A large majority of sites"), (50, "A majority of sites"), (30, "A substantial minority of sites"), (0, "A minority of sites")]
UTILITY = {0.1: "Low (high privacy)", 0.5: "Moderate", 1.0: "Balanced (recommended)", 2.0: "Good utility", 5.0: "High utility", 10.0: "Near-exact"}
NOTES = [(0.1, "Very high privacy, low utility"), (0.5, "High privacy, moderate utility"), (1.0, "Good privacy-utility balance"), (2.0, "Moderate privacy, good utility")]
LAST_NOTE = "Low privacy, high utility"
POINTS = {"found": 2, "has_accept": 5, "has_reject": 5, "has_settings": 3}


def share_phrase(pct: Column) -> Column:
    words = F.lit(SHARES[-1][1])
    for bound, phrase in SHARES[-2::-1]:
        words = F.when(pct >= bound, phrase).otherwise(words)
    return F.format_string("%s (%.1f%%)", words, pct)


def utility(epsilon: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, phrase in UTILITY.items():
        out = F.when(epsilon == e, phrase).otherwise(out)
    return out


def epsilon_note(epsilon: Column) -> Column:
    out = F.lit(LAST_NOTE)
    for bound, phrase in reversed(NOTES):
        out = F.when(epsilon <= bound, phrase).otherwise(out)
    return out


def signed_percent(value: Column) -> Column:
    rounded = F.round(value, 1)
    return F.format_string("%s%.1f%%", F.when(rounded > 0, "+").otherwise(""), rounded)


def scan_quality() -> Column:
    """How much a scan of a banner has found, over its columns of the same names as in POINTS."""
    total = sum((F.when(F.col(c), n).otherwise(0) for c, n in POINTS.items()), F.lit(0))
    reach = sum((F.when(F.col(c) < 999, 1).otherwise(0) for c in ("accept_clicks", "reject_clicks")), F.lit(0))
    return total + reach + F.when(F.col("banner_text") != "", 1).otherwise(0)


def reject_source(direct: Column, settings: Column) -> Column:
    """Where a refusal can be had: its own button, the settings, or nowhere."""
    return F.when(direct, "direct").when(settings, "settings").otherwise("missing")


def button_issues(source: Column, clicks: Column, size_ratio: Column, font_ratio: Column, weight_diff: Column, plain_link: Column) -> Column:
    """What is wrong with the way to refuse against the button to accept, in order. The measures are those of the button that
    source names; clicks is how many it takes by the settings, if that is known and possible."""
    far = F.when((clicks > 0) & (clicks < 999), F.format_string("reject only behind settings (%d clicks)", clicks)).otherwise("reject only behind settings")
    found = F.array_compact(
        F.array(
            F.when(source == "settings", far), F.when(size_ratio < 0.7, "reject is smaller"), F.when(font_ratio < 0.85, "reject has a smaller font"),
            F.when(weight_diff > 200, "accept is bolder"), F.when(plain_link, "reject looks like a plain link"),
        )
    )
    return F.when(source == "missing", F.array(F.lit("no reject button"))).otherwise(found)


# Names, phrases and explanations that reports carry.
TOOL_NAMES = {
    "baseline": "Baseline", "ublock_origin": "uBlock Origin", "privacy_badger": "Privacy Badger", "firefox_etp_standard": "Firefox ETP Std",
    "firefox_etp_strict": "Firefox ETP Strict", "brave_shields": "Brave Shields", "consent_o_matic": "Consent-O-Matic",
}
TRUST = {"honest": "Supports banner claim", "mixed": "Partially supports banner claim", "dishonest": "Weakens banner claim", "not_applicable": "Not an honesty-scored action"}
NO_TRUST = "Could not verify"
#: Pattern, severity, the articles it bears on, and what it is.
PATTERN_INFO = [
    ("preselected", "high", "GDPR 4(11), 7(2)", "Boxes for more than the necessary cookies are ticked beforehand."),
    ("asymmetric", "medium", "GDPR 7(2), recital 42", "The button to refuse is smaller, lighter or harder to read than the one to accept."),
    ("hidden_reject", "high", "GDPR 7(3)", "There is a button to refuse, but its style keeps it from being seen."),
    ("missing_reject", "high", "GDPR 7(3)", "No single click refuses."),
    ("multi_layer", "medium", "GDPR 7(3)", "It takes more clicks to refuse than to accept."),
    ("confusing", "medium", "GDPR 12(1)", "The wording presses, negates twice, or names a button so that its effect is unclear."),
    ("forced_action", "critical", "GDPR 7(4), EDPB 05/2020", "Nothing can be read before one accepts."),
]
ISSUES = {
    "pre_consent_trackers": "pre-consent trackers", "dark_patterns": "dark patterns", "reject_effort": "reject friction", "analytics": "analytics trackers",
    "advertising": "advertising trackers", "social": "social trackers", "fingerprinting": "fingerprinting signals",
}


def named(key: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """The name of a key; the key itself, or what is given, where there is none."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), key if otherwise is None else otherwise)


def trust_label(verdict: Column) -> Column:
    return named(verdict, TRUST, F.lit(NO_TRUST))


def delta_phrase(label: str, value: Column) -> Column:
    """What an action did to a number; null without one."""
    return F.when(value > 0, F.format_string(f"increased {label} by %d", value)).when(value < 0, F.format_string(f"reduced {label} by %d", -value)).when(value == 0, F.lit(f"left {label} unchanged"))


def delta_summary(cookies: Column, third: Column, trackers: Column) -> Column:
    parts = F.array_compact(F.array(delta_phrase("cookies", cookies), delta_phrase("third-party cookies", third), delta_phrase("trackers", trackers)))
    return F.when(F.size(parts) == 0, "No before/after delta is available yet.").otherwise(F.concat(F.lit("It "), F.array_join(parts, ", "), F.lit(".")))


def why_helps(reasons: Column) -> Column:
    """A sentence of at most three reasons; null without any."""
    r = lambda i: F.get(reasons, F.lit(i))
    n = F.size(reasons)
    return (
        F.when(n == 1, F.concat(F.lit("Helps with "), r(0), F.lit("."))).when(n == 2, F.concat(F.lit("Helps with "), r(0), F.lit(" and "), r(1), F.lit(".")))
        .when(n >= 3, F.concat(F.lit("Helps with "), r(0), F.lit(", "), r(1), F.lit(", and "), r(2), F.lit(".")))
    )
