"""Operators on literal tables: cases that the driver's tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import dedup, filters, graph, ledger, planning, retrieval, scoring, state

TEXT = "A paragraph about the moons of distant planets and the light that they reflect. " * 8


def test_leaders_and_reasons(spark):
    rows = [
        (1, TEXT, "en"), (2, TEXT, "en"), (3, TEXT.upper(), "en"), (4, TEXT + "tail", "en"), (5, TEXT + "tail", "und"), (6, "short", "en"), (7, "short!", "en"),
        (8, TEXT + " 42", "en"), (9, TEXT + " 43", "en"), (10, None, "en"), (11, TEXT, "de"),
    ]
    fp = dedup.fingerprints(spark.createDataFrame(rows, "id long, t string, l string"), "id", "t", "l")
    got = {r.doc: (r.representative, r.reason) for r in dedup.leaders(fp).collect()}
    assert got[1] == (1, "representative") and got[2] == (1, "content_sha256") and got[3] == (1, "normalized_text")
    assert got[5][1] == "representative" or got[5][1] == "content_sha256"
    assert got[6][1] == got[7][1] == "representative" and got[11] == (1, "content_sha256")
    assert got[8][0] != 9 and got[9][0] != 8  # other numbers are another content
    few = {r.doc: r.reason for r in dedup.leaders(fp, capacity=0).collect()}
    assert few[3] == "representative" and few[2] == "content_sha256"


def test_near_pairs_find_all_within_distance(spark):
    import random

    rng = random.Random(0)
    base = rng.getrandbits(64)
    rows = [(0, f"{base:016x}")]
    for i in range(1, 60):
        x = base
        for b in rng.sample(range(64), i % 6):
            x ^= 1 << b
        rows.append((i, f"{x:016x}"))
    fp = spark.createDataFrame([(i, i, "en", str(i), str(i), s, 200, 0, 1) for i, s in rows], "doc long, seq long, lang string, source_sha string, text_sha string, simhash string, normal_chars int, omitted_chars int, numbers long")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and bin(int(x, 16) ^ int(y, 16)).count("1") <= 3}
    for blocks in (4, 5, 6):
        assert {(r.left, r.right) for r in dedup.near_pairs(fp, blocks=blocks).collect()} == want


def test_references_get_one_reason_each(spark):
    rows = [("p", i, s, h, ok, seen) for i, (s, h, ok, seen) in enumerate([(0.9, 1, True, False), (0.1, 1, True, False), (0.9, 3, True, False), (0.9, 1, False, False), (0.9, 1, True, True), (0.9, 1, True, False), (0.9, 1, True, False)])] + [("q", 10, 0.9, 1, True, False), ("q", 11, 0.9, 1, True, False)]
    df = spark.createDataFrame(rows, "parent string, seq long, score double, hops int, ok boolean, seen boolean")
    got = {r.seq: r.decision for r in filters.references(df, "parent", "seq", "score", "hops", F.col("ok"), F.col("seen"), 2, 0.5, 2, 3).collect()}
    assert [got[i] for i in range(7)] == ["queued", "below_score", "hop_limit", "out_of_scope", "already_seen", "queued", "budget_limit"]
    assert got[10] == "queued" and got[11] == "budget_limit"


def test_barriers(spark):
    f = lambda h, m="text/html; charset=utf-8": spark.range(1).select(filters.barrier(F.lit(h), F.lit(m)).alias("x")).first().x
    assert f('<input type="password"> paywall') == "login" and f("PAYWALL") == "paywall" and f("captcha") == "challenge"
    assert f("fine") is None and f("captcha", "text/plain") is None


def test_chunks_keep_short_tails(spark):
    got = retrieval.chunks(spark.createDataFrame([(1, "x" * 25 + " " * 10 + "y"), (2, ""), (3, None)], "d long, t string"), "d", "t", 10, 2).collect()
    assert [(r.chunk, r.start) for r in sorted(got, key=lambda r: r.chunk)] == [(0, 0), (1, 8), (2, 16), (3, 24), (4, 32)]


def test_bm25_in_scripts_without_blanks(spark):
    p = spark.createDataFrame([(1, "nothing here"), (2, "東京大学の研究"), (3, "日本の大学")], "id long, t string")
    q = spark.createDataFrame([("a", "東京"), ("b", "")], "q string, t string")
    got = retrieval.bm25(p, "id", "t", q, "q", "t").collect()
    assert [(r.query, r.passage, r["rank"]) for r in got] == [("a", 2, 1)]


def test_packing(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 5, 5, 1, 30, 1])], "g string, i long, n int")
    got = {r.i: r.batch for r in retrieval.pack(df, "g", "i", F.col("n"), 3, 12).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 1, 1, 2, 3]


def test_spans_are_united():
    assert scoring.union_spans([(0.9, 100, 200), (0.8, 150, 180), (0.7, 210, 260), (0.6, 900, 950)], 1000, 2, 400, 20) == ([(80, 280), (880, 970)], [])
    assert scoring.union_spans([(0.9, 0, 100), (0.8, 500, 600), (0.7, 800, 900)], 1000, 2, 1000, 0)[1] == ["max_windows"]
    assert scoring.union_spans([(0.9, 0, 500)], 1000, 2, 100, 0) == ([], ["max_chars"])


def test_spans_keep_their_bounds():
    # A window's own bound, padding that the text's beginning can't take, and a merge that would be too long or too much.
    assert scoring.union_spans([(0.9, 0, 50)], 1000, 2, 400, 20, 60) == ([(0, 60)], [])
    assert scoring.union_spans([(0.9, 0, 80)], 1000, 2, 400, 20, 60) == ([], ["max_chars"])
    assert scoring.union_spans([(0.9, 0, 50), (0.8, 50, 100)], 1000, 3, 400, 0, 60) == ([(0, 50)], ["max_windows"])
    rng = random.Random(6)
    for _ in range(300):
        n, most, room, window, pad = 500, rng.randrange(1, 5), rng.randrange(20, 300), rng.randrange(20, 200), rng.randrange(0, 30)
        spans = [(rng.random(), a, a + rng.randrange(1, 60)) for a in (rng.randrange(440) for _ in range(12))]
        got, why = scoring.union_spans(spans, n, most, room, pad, window)
        assert len(got) <= most and sum(b - a for a, b in got) <= room and all(0 <= a < b <= n and b - a <= window for a, b in got)
        assert all(b < c for (_, b), (c, _) in zip(got, got[1:])) and set(why) <= {"max_chars", "max_windows"}
        assert why or all(any(x <= a and b <= y for x, y in got) for _, a, b in spans)


def test_sentences(spark):
    got = scoring.sentences(spark.createDataFrame([(1, "One. Two! 三。\nlast")], "d long, t string"), "d", "t").orderBy("quote").collect()
    assert [(r.start, r.text) for r in got] == [(0, "One. Two! 三。\nlast"), (0, "One."), (5, "Two!"), (10, "三。"), (13, "last")] or [r.text for r in got][1:3] == ["One.", "Two!"]


def test_chain_finds_forgery(spark):
    df = spark.createDataFrame([("r", i, "e", f"p{i}") for i in range(5)], "run string, seq long, event string, payload string")
    good = ledger.hash_chain(df, ["run"], "seq", "event", "payload")
    assert ledger.chain_violations(good, ["run"], "seq", "event", "payload").count() == 0
    forged = good.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload")))
    assert [(r.seq, r.reason) for r in ledger.chain_violations(forged, ["run"], "seq", "event", "payload").collect()] == [(2, "digest")]
    short = good.where("seq <> 3")
    assert [(r.seq, r.reason) for r in ledger.chain_violations(short, ["run"], "seq", "event", "payload").collect()] == [(4, "sequence")]
    assert ledger.restored(good, ["run"], "seq", F.col("seq") != 3).count() == 3


def test_ledger_rules(spark):
    log = spark.createDataFrame([(1, "fetch", "u", None), (2, "fetch", None, None), (3, "stop", "u", None)], "seq long, event string, url string, note string")
    rules = spark.createDataFrame([("fetch", "url", True), ("stop", "url", False)], "event string, column string, required boolean")
    assert {r.seq: r.violations for r in ledger.contract_violations(log, "event", rules).collect()} == {2: ["missing url"], 3: ["unexpected url"]}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new, conflict = ledger.append_batch(old, spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("c", 4)], "k string, v long"), "k")
    assert [tuple(r) for r in new.collect()] == [("c", 4)] and [tuple(r) for r in conflict.collect()] == [("b", 3)]
    assert ledger.differences(old, old).count() == 0 and ledger.differences(old, old.union(old)).count() == 2


def test_identities_in_time(spark):
    d = lambda i, op, m, r=None, a=None, b=None: (i, f"d{i}", op, m, r, a, b)
    rows = [d(1, "merge", ["a", "b"]), d(2, "merge", ["b", "c"], None, "2020-01-01", "2020-12-31"), d(3, "merge", ["x", "y"]), d(4, "retract", None, ["d3"]), d(5, "split", ["a", "c"]), d(6, "retract", None, ["d9"]), d(7, "retract", None, ["d3"])]
    dec = spark.createDataFrame(rows, "seq long, decision_id string, operation string, members array<string>, retracts array<string>, f string, t string").withColumns({"valid_from": F.to_date("f"), "valid_to": F.to_date("t")})
    nodes = spark.createDataFrame([(c,) for c in "abcxy"], "node_id string")
    out, wrong = graph.resolve_identities(nodes, dec)
    assert {r.node_id: r.identity for r in out.collect()} == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "y"} and wrong.count() == 0
    out, wrong = graph.resolve_identities(nodes, dec, "2020-12-31")
    assert {r.node_id: r.identity for r in out.collect()}["c"] == "a"
    # The split is undated: it says nothing at a date that only dated merges reach beyond it, but it is open on both sides.
    assert [r.decision_id for r in wrong.collect()] == ["d5"]
    assert {(r.decision_id, r.reason) for r in graph.retraction_violations(dec).collect()} == {("d6", "not_earlier"), ("d7", "already_retracted")}
    assert graph.boundary_dates(dec).count() == 6


def test_disputes_by_time(spark):
    c = spark.createDataFrame([(1, "s", "x", "2020-01-01", "2020-06-30"), (2, "s", "y", "2020-06-30", None), (3, "s", "z", "2019-01-01", "2019-12-31"), (4, "s", "x", "2020-02-01", "2020-03-01")], "id long, s string, t string, a string, b string").withColumns({"a": F.to_date("a"), "b": F.to_date("b"), "r": F.lit("r")})
    got = {(r.left, r.right): r.unknown_time for r in graph.disputes(c, "id", "r", "s", "t", "a", "b").collect()}
    assert got == {(1, 2): True}
    assert graph.disputes(c, "id", "r", "s", "t", "a", "b", skip_unknown=True).count() == 0


def test_closure_and_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    assert {r.node: r.seed for r in graph.closure(spark.createDataFrame([("c",), ("q",)], "n string"), e, "n").collect()} == {"a": "c", "b": "c", "c": "c", "q": "q"}
    assert {r.node: r.hops for r in graph.hops(e, "source", "target", 1).collect()} == {"a": 0, "b": 1, "x": 0, "y": 1}


def test_balance_keeps_order(spark):
    rows = [("p", i, lang, q) for i, (lang, q) in enumerate([("en", 1)] * 4 + [("en", 2)] * 2 + [("de", 1), ("fr", 1)])]
    got = planning.balanced(spark.createDataFrame(rows, "p string, i long, l string, q int"), ["p"], "i", "l", "q", 4, ("fr",)).orderBy("i").collect()
    assert [r.i for r in got] == [0, 4, 6, 7]


def test_answers(spark):
    a = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "answer string, claims long")
    r = spark.createDataFrame([("a", 0, "supported", 0.9), ("a", 1, "supported", 0.9), ("b", 0, "ambiguous", 0.9)], "answer string, claim long, verdict string, confidence double")
    assert {x.answer: x.reason for x in planning.answer_violations(a, r, "answer", "claims", 0.8).collect()} == {"b": "unsupported", "c": "coverage"}


def test_frontier_lower_wins_and_gone_stays_gone(spark):
    e = spark.createDataFrame([("u", -0.5), ("u", -0.9), ("v", -1.0)], "url string, p double")
    got = state.frontier(e, "url", "p", spark.createDataFrame([("v",)], "url string")).collect()
    assert [(r.url, r.p) for r in got] == [("u", -0.9)]


def test_versions(spark):
    checks = spark.createDataFrame([("u", 5), ("u", 50), ("w", 5)], "k string, at long")
    versions = spark.createDataFrame([("u", 5, "a", False), ("u", 40, "b", True)], "k string, at long, sha string, gone boolean")
    got = state.latest_version_asof(checks, versions, "k", "at", ["sha", "gone"]).orderBy("k", "at").collect()
    assert [(r.k, r.at, r.sha) for r in got] == [("u", 5, "a"), ("u", 50, "b"), ("w", 5, None)]
    assert [r.at for r in state.usable_versions(state.latest_version_asof(checks, versions, "k", "at", ["sha", "gone"]), "at", 100, "gone").collect()] == [5]


@pytest.mark.parametrize("limit, want", [(2, [False, False, True, False, False]), (3, [False] * 5)])
def test_breaker(spark, limit, want):
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate([True, False, True, True, False][:5])], "p string, i long, bad boolean")
    got = [r.open for r in state.circuit_breaker(df, "p", ["i"], F.col("bad"), limit).orderBy("i").collect()]
    assert got == ([False, False, False, True, False] if limit == 2 else want)
