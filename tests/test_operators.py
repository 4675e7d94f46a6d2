"""Operators on small tables: rules, deduplication, scores and invariants."""

import itertools

from pyspark.sql import functions as F

from crumbtrail.operators import banner, bloom, classify, metrics, privacy, scoring, studies
from crumbtrail.plans import params as P
from crumbtrail.sources import readers, sinks


def cookies(spark, rows):
    return spark.createDataFrame(rows, "seq long, site string, state string, name string, cookie_domain string, path string, as_of long, expires long")


def test_cascade(spark):
    rows = [
        (0, "example.com", "pre", "x", ".stats.doubleclick.net", "/", 0, 0), (1, "example.com", "pre", "_ga", ".example.com", "/", 0, 86400 * 2),
        (2, "example.com", "pre", "q", ".ib.adnxs.com", "/", 0, 0), (3, "example.com", "pre", "q", ".script.hotjar.com", "/", 0, 0), (4, "example.com", "pre", "q", "example.com", "/", 0, 0),
        (5, "example.com", "pre", "q", ".platform.twitter.com", "/", 0, 0), (6, "example.com", "pre", "q", ".cdn.other.org", "/", 0, 0), (7, "example.com", "pre", "q", ".example.com", "/", 0, 86400 * 9),
        (8, "example.com", "pre", "q", ".static.example.com", "/", 0, 86400 * 9),
    ]
    got = {r.seq: r for r in classify.classify_cookies(cookies(spark, rows), classify.tracker_map(spark), classify.block_lists(spark), classify.fallback_map(spark)).collect()}
    assert [got[i].source for i in range(9)] == ["disconnect", "heuristic", "easylist", "disconnect", "heuristic", "fallback", "unknown", "unknown", "heuristic"]
    assert [(got[i].category, got[i].is_tracker) for i in (4, 5, 6, 7, 8)] == [("Functional", False), ("Social", True), ("Unknown", False), ("Unknown", False), ("Functional", False)]
    assert (got[0].vendor, got[0].category, got[0].third_party) == ("Google", "Advertising", True)
    assert (got[1].vendor, got[1].age_days, got[1].third_party, got[4].is_tracker) == ("Google", 2, False, False)


def test_dedup_is_the_sequential_rule(spark):
    """Keep the first; replace it by a tracker if it is none, or by a known one if it is unknown."""
    kinds = [(False, "unknown"), (False, "x"), (True, "map")]
    rows, want = [], {}
    for n, seq in enumerate(s for k in (1, 2, 3) for s in itertools.product(kinds, repeat=k)):
        keep = 0
        for i, (t, src) in enumerate(seq):
            kt, ks = seq[keep]
            if (t and not kt) or (not kt and ks == "unknown" and src != "unknown"):
                keep = i
        want[f"s{n}"] = keep
        rows += [(f"s{n}", "c", "d", t, src, i) for i, (t, src) in enumerate(seq)]
    df = spark.createDataFrame(rows, "site string, name string, cookie_domain string, is_tracker boolean, source string, seq int")
    assert {r.site: r.seq for r in classify.dedup_cookies(df).collect()} == want
    once = classify.dedup_cookies(df)
    assert classify.dedup_cookies(once).count() == once.count()


def test_filter_lists(spark):
    lines = ["||Ads.example^", "||ads.example^$third-party", "! ||no.example^", "x##.ad", "||odd/path", "", "||b.example^"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(r.domain for r in classify.adblock_domains(df).collect()) == ["ads.example", "b.example"]
    hosts = spark.createDataFrame([("127.0.0.1 A.example",), ("# c",), ("0.0.0.0  b.example",)], "line string")
    assert sorted(r.domain for r in readers.hosts_domains(hosts).collect()) == ["a.example", "b.example"]


def test_tracker_services_last_entry_wins(spark):
    doc = '{"categories": {"Ads": [{"A": {"http://a": ["x.com", "y.com"], "dnt": "z.com"}}], "Social": [{"B": {"http://b": ["X.com"], "q.com": "http://q"}}]}}'
    got = {r.domain: (r.vendor, r.category) for r in readers.tracker_services(spark.createDataFrame([(doc,)], "json string")).collect()}
    assert got == {"x.com": ("B", "Social"), "y.com": ("A", "Ads"), "q.com": ("B", "Social")}


def score(spark, **c):
    names = list(P.WEIGHTS)
    df = spark.createDataFrame([tuple(c.get(n) for n in names)], ", ".join(f"{n} int" for n in names))
    return df.select(F.round(scoring.overall(P.WEIGHTS), 2).alias("x")).first().x


def test_scores(spark):
    assert score(spark, c1=100, c2=100, c3=100, c4=100, c5=100, c6=100) == 100
    assert score(spark, c1=100, c2=100, c3=100, c4=100, c5=None, c6=0) == 88.24
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [row(scoring.c1(F.lit(n))) for n in (0, 2, 5, 10, 11)] == [100, 60, 30, 10, 0]
    assert [row(scoring.c3(F.lit(a), F.lit(b))) for a, b in ((1, 1), (1, 2), (1, 3), (1, 999), (999, 999), (999, 1))] == [100, 50, 20, 0, 0, 100]


def test_state_outcome(spark):
    row = lambda c: spark.range(1).select(F.round(c, 1).alias("x")).first().x
    n = lambda *v: [F.lit(x) for x in v]
    assert row(scoring.state_outcome(*n(0, 0, 1, "mixed"))) == 86
    assert row(scoring.state_outcome(*n(0, 0, 0, "honest"))) == 100
    assert row(scoring.state_outcome(*n(20, 20, 50, "not_applicable"))) == 0


#: Labels in many languages and what they do.
LABELS = {
    "I Accept": "accept", "I Accept Cookies": "accept", "Accept and continue": "accept", "Reject Optional Cookies": "reject", "Essential cookies only": "reject", "Necessary cookies only": "reject",
    "Continue without accepting": "reject", "Manage Preferences": "settings", "Not now": "dismiss", "Einstellungen": "settings", "Continuer sans accepter": "reject", "Cookie-instellingen": "settings",
    "Aceptar todo": "accept", "Solo cookie necessari": "reject", "Gerir preferências": "settings", "Tylko niezbędne pliki cookie": "reject", "Acceptă": "accept", "Nastavení cookies": "settings",
    "Endast nödvändiga cookies": "reject", "Vis muligheder": "settings", "Godta alle": "accept", "Vain välttämättömät evästeet": "reject", "Προβολή επιλογών": "settings", "Beállítások kezelése": "settings",
    "Prijať všetko": "accept", "Nastavitve piškotkov": "settings", "Prihvati sve": "accept", "Само необходимите бисквитки": "reject", "Slapukų nustatymai": "settings", "Pārvaldīt preferences": "settings",
    "Nõustun": "accept", "Halda áfram án samþykkis": "reject", "Lean ar aghaidh": "dismiss", "Aċċetta kollox": "accept", "Çerez ayarları": "settings", "Reject all": "reject", "TOUT REFUSER": "reject",
    "OK": "dismiss", "Alle akzeptieren": "accept", "Read on": "unknown", "": "unknown",
}


def test_labels(spark):
    voc = spark.sql(P.values(P.vocabulary_rows(), "action, kind, ord, term"))
    df = spark.createDataFrame([(x,) for x in LABELS], "label string")
    assert {r.label: r.action for r in classify.classify_labels(df, voc).collect()} == LABELS


def test_interactions(spark):
    voc = spark.sql(P.values(P.vocabulary_rows(), "action, kind, ord, term"))
    want = {"Only essential cookies": "essential", "Reject all": "reject", "Save choices": "confirm", "Not now": "dismiss", "Got it": "dismiss", "Accept all": "accept", "Options": "settings", "Read on": "unknown", "": "unknown"}
    df = spark.createDataFrame([(x,) for x in want], "label string")
    assert {r.label: r.action for r in classify.classify_interactions(df, voc).collect()} == want


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"accept": {"exact": ["Oui"], "contains": ["accord"]}, "reject": {"exact": ["Non"], "contains": []}}')
    voc = readers.read_vocabulary(spark, str(tmp_path / "v.json"))
    df = spark.createDataFrame([("OUI",), ("D'accord",), ("non",), ("?",)], "label string")
    assert {r.label: r.action for r in classify.classify_labels(df, voc).collect()} == {"OUI": "accept", "D'accord": "accept", "non": "reject", "?": "unknown"}


def test_bloom_has_no_false_negatives(spark):
    names = spark.range(300).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".example")).alias("domain"))
    got = bloom.probe(names.union(spark.createDataFrame([("other.test",)], "domain string")), bloom.build(names)).collect()
    assert all(r.maybe for r in got if r.domain.startswith("d"))
    assert not [r for r in got if r.domain == "other.test"][0].maybe


KEY = privacy.Key("a secret of the test", "first")


def catalogue(spark, n=20):
    return spark.createDataFrame([(f"m{i}", "count", float(i), 100, 0.0, 100.0) for i in range(n)], "metric string, kind string, value double, n long, lo double, hi double")


def test_noise_does_not_depend_on_partitions(spark):
    df = catalogue(spark)
    a = sorted(map(tuple, privacy.release(df.repartition(1), KEY).collect()))
    assert a == sorted(map(tuple, privacy.release(df.repartition(7), KEY).collect()))
    t = privacy.trials(df.limit(3), KEY, 400).where("epsilon = 10").collect()
    assert all(abs(r["mean"] - r.truth) < 0.5 for r in t)


def test_noise_needs_the_secret_and_shares_no_draw(spark):
    """Another secret, release or budget gives other draws; the true value does not follow from two budgets."""
    df = catalogue(spark, 40).withColumn("value", F.lit(50.0))
    draws = {}
    for key in (KEY, privacy.Key("another", "first"), privacy.Key("a secret of the test", "second")):
        for r in privacy.release(df, key).collect():
            draws.setdefault((key, r.epsilon), []).append((r.noisy - 50) * r.epsilon)
    some = [v for (_, e), v in draws.items() if e in (0.5, 1.0, 2.0)]
    for i, a in enumerate(some):
        for b in some[:i]:
            assert sum(abs(x - y) < 0.06 for x, y in zip(a, b)) < 12
    by = {e: v for (k, e), v in draws.items() if k is KEY}
    guess = [(0.5 * (50 + x / 0.5) - 1.0 * (50 + y / 1.0)) / -0.5 for x, y in zip(by[0.5], by[1.0])]
    assert sum(abs(g - 50) < 0.2 for g in guess) < 15
    for bad in (("", "x"), ("x", "")):
        try:
            privacy.Key(*bad)
        except ValueError:
            continue
        raise AssertionError("a release without secret or name")


def test_randomized_response_recovers_shares(spark):
    rows = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("domain"), (F.col("id") % 4 == 0).alias("flag"))
    got = {r.epsilon: r for r in privacy.response_trials(rows, "domain", ["flag"], KEY, 5).collect()}
    assert all(r.truth == 0.25 for r in got.values())
    assert got[1.0].error < 0.03 and got[5.0].error < 0.01


def test_merge_and_gate(spark):
    df = spark.createDataFrame([("a", 0, 1, "x", "m1"), ("a", 1, 0, "y", "m2"), ("b", 0, 0, "z", "m1")], "domain string, batch int, seq int, v string, source_mode string")
    got = studies.merge_batches(df, ["domain"], "real").collect()
    assert {(r.domain, r.v, r.source_mode) for r in got} == {("a", "y", "real"), ("b", "z", "real")}
    assert not studies.provenance_gate([df], "m1").first().ok
    assert studies.provenance_gate([df.where("source_mode = 'm1'")], "m1").first().ok


def test_grades_are_zero_filled(spark):
    got = metrics.grade_distribution(spark.createDataFrame([("A",), ("A",)], "grade string")).collect()
    assert {r.grade: r.n for r in got} == {"A": 2, "B": 0, "C": 0, "D": 0, "F": 0}


def flags(spark, html, buttons=(), **banner_values):
    b = {"domain": "a", "found": True, "has_reject": True, "accept_clicks": 1, "reject_clicks": 1, "banner_text": "", "html": html} | banner_values
    df = spark.createDataFrame([tuple(b.values())], "domain string, found boolean, has_reject boolean, accept_clicks int, reject_clicks int, banner_text string, html string")
    kinds = "domain string, pos int, kind string, width string, height string, font_size string, font_weight string, color string, background string, display string, visibility string"
    return banner.dark_patterns(df, spark.createDataFrame([("a", i, *x) for i, x in enumerate(buttons)], kinds)).first()


def test_detectors_on_markup_of_many_kinds(spark):
    cases = [
        ('<label for="n">Strictly necessary</label><input type="checkbox" id="n" checked>', []),
        ("<LABEL FOR=m>Marketing</LABEL><INPUT ID=m TYPE=CheckBox CHECKED=checked>", ["preselected"]),
        ("<p>Essential <input type='checkbox' checked></p><div><label>Ads<input type='checkbox' checked></label></div>", ["preselected"]),
        ('<div><a class="link sr-only"><span>Reject</span> <i>all</i></a></div>', ["hidden_reject"]),
        ('<button STYLE="color:red; DISPLAY : none">Ablehnen</button>', ["hidden_reject"]),
        ('<button class="hidden">Accept all</button>', []),
        ("<section id=Blocking-layer style='width: 100%'>x</section>", ["forced_action"]),
        ("<main class=wall style='position:fixed'>x</main>", []),
        ("<div class='page-blur' style='position : fixed'>x</div>", ["forced_action"]),
        ("<div class='no-blur backdrop' style='position:fixed'>x</div>", []),
        ("<p>We need <b>your</b> support.</p>", ["confusing"]), ("<p>We need her support.</p>", []), ("<p>We need\n your   support.</p>", ["confusing"]),
        ("<script>var x = 'best experience'</script><p>ok</p>", []),
        ("<button>Close</button>", ["confusing"]), ("<p>Ich will nicht ablehnen</p>", ["confusing"]),
        ("<div><p>broken <b>markup <input type=checkbox checked", []),
    ]
    for html, want in cases:
        got = flags(spark, html).names
        assert got == want, (html, got)
    assert flags(spark, "", found=False, has_reject=False, accept_clicks=999, reject_clicks=999).names == ["missing_reject"]
    assert flags(spark, "", reject_clicks=999).names == ["missing_reject", "multi_layer"]
    r = flags(spark, "", reject_clicks=3)
    assert r.names == ["multi_layer"] and r.click_ratio == 3.0


def test_hidden_by_style(spark):
    base = ("reject", "100px", "40px", "16px", "400", "#333", "#fff", "block", "visible")
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("kind", "width", "height", "font", "weight", "color", "background", "display", "visibility"), base))
    assert flags(spark, "", [base]).names == []
    for odd in (change(width="0px"), change(height="0"), change(color="#FFFFFF"), change(display="none"), change(visibility="hidden")):
        assert flags(spark, "", [base, odd]).names == ["hidden_reject"], odd


def test_buttons_of_all_kinds(spark):
    html = "<BUTTON><span>Accept</span>\n all</BUTTON><a role=button>Reject</a><a href=x>Policy</a><input type=button value='Manage'><input type=text value=no><div role='button' aria-label=Close></div>"
    got = banner.extract_buttons(spark.createDataFrame([("a", html)], "domain string, html string")).orderBy("pos").collect()
    assert [(r.tag, r.label) for r in got] == [("button", "Accept all"), ("a", "Reject"), ("a", "Policy"), ("input", "Manage"), ("div", "Close")]


def test_elements_in_the_jvm(spark):
    html = """<A HREF='x"y' id=one CLASS = "b c">t</a><br/><img alt="a > b" src=pic.png id='two' ID="three">"""
    got = banner.html_elements(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id", "html").orderBy("pos").collect()
    assert [(r.tag, dict(r.attrs)) for r in got] == [("a", {"href": 'x"y', "id": "one", "class": "b c"}), ("br", {}), ("img", {"alt": "a > b", "src": "pic.png", "id": "two"})]


def test_study_rules(spark):
    effect = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate((9, 2, 3, 4, 1, 8))] + [(studies.NO_CMP, 50)], "cmp string, sites int")
    assert sorted(r.cmp for r in studies.enough_sites(effect).collect()) == ["c0", "c2", "c3", "c5"]
    assert studies.enough_sites(effect.where("cmp IN ('c1', 'c4')")).count() == 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "crawl").mkdir()
    (tmp_path / "crawl" / "a.example.json").write_text('{"success": true, "pre_consent": {"cookies": [{"name": "n", "domain": ".d", "path": "/"}]}, "post_consent_accept": {}}')
    (tmp_path / "crawl" / "broken.json").write_text("{nonsense")
    crawl = readers.read_crawl(spark, str(tmp_path / "crawl"))
    assert [r.domain for r in crawl.collect()] == ["a.example"]
    states = readers.states_long(crawl)
    assert [r.state for r in states.collect()] == ["pre"]
    assert readers.cookies_long(states).first().name == "n"
    assert readers.read_results(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    out = sinks.stamp(spark.createDataFrame([("x", None)], "domain string, run_id string"), run_id="r1", source_mode="mock")
    sinks.write_table(out, str(tmp_path / "t"), by="source_mode")
    assert spark.read.parquet(str(tmp_path / "t")).first().run_id == "r1"
    sinks.append_missing(spark.createDataFrame([("x",), ("y",)], "domain string"), out, str(tmp_path / "m"), "domain")
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["y"]


def test_elements_do_not_grow_with_depth(spark):
    deep = "<div>" * 800 + "word <b>and</b> <a href=#>more <i>of</i> it</a>" + "</div>" * 800
    els = banner._read(deep)
    assert len(els) == 803 and sum(len(e["text"]) for e in els) == len("more of it")
    boxed = banner._read("<div><p>All <span>of us <input type=CheckBox checked></span></p><script>var x</script><label for=q>Name <b>here</label> tail</div>")
    assert {(e["tag"], e["text"]) for e in boxed if e["text"]} == {("span", "of us"), ("label", "Name here")}


def test_the_setting_names_the_vocabulary(spark, tmp_path):
    from crumbtrail.plans import queries

    (tmp_path / "v.json").write_text('{"dismiss": {"exact": ["Weg damit"]}, "accept": {"contains": ["gern"]}}')
    spark.conf.set(P.VOCABULARY_SETTING, str(tmp_path / "v.json"))
    try:
        voc = queries._vocabulary(spark)
        df = spark.createDataFrame([("weg DAMIT",), ("Aber gern!",), ("Accept all",)], "label string")
        assert {r.label: r.action for r in classify.classify_labels(df, voc).collect()} == {"weg DAMIT": "dismiss", "Aber gern!": "accept", "Accept all": "unknown"}
    finally:
        spark.conf.unset(P.VOCABULARY_SETTING)
    assert queries._vocabulary(spark).count() == len(P.vocabulary_rows())
