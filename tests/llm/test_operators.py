"""Operators of the training-data pipeline on small literal tables, against brute force, and on odd input."""

import datetime
import hashlib
import hmac
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loomspan.llm import common, decontaminate, graph, language, licenses, lines, mixing, neardup, pii, quality, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_words long, size long, _id long, component string, u string, v string, item string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def table(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None, 0.5, True, 7, 1, -1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " ", "\n\n", "one", "one", "a b c d e", "a b c d e", "x " * 30000, "é" * 5000, "tab\tand\rothers\x0b here", "  two  blanks ", "\x01\x02", "the same line of words here\nthe same line of words here", "ß İ Σς 漢字"]


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "one"), (3, None), (4, "")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, None), (None, 1), (6, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    return {
        "quality": lambda d: quality.compression_bands(d),
        "urls": lambda d: urls.url_verdicts(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), "kept", "u")),
        "licenses": lambda d: licenses.license_scan(d),
        "neardup": lambda d: neardup.near_duplicates(d),
        "lines": lambda d: lines.line_dedup(d),
        "language": lambda d: language.identify(d),
        "mixing": lambda d: mixing.cube_mix(d),
        "decontaminate": lambda d: decontaminate.winnow_overlap(d, bench),
        "decontaminate_joined": lambda d: decontaminate.winnow_overlap(d, bench, broadcast_bytes=0),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "pii": lambda d: pii.pseudonymise(d, "k"),
    }


@pytest.mark.parametrize("name", ["quality", "urls", "licenses", "neardup", "lines", "language", "mixing", "decontaminate", "decontaminate_joined", "toxicity", "pii"])
def test_odd_and_empty_input(spark, name):
    op = operators(spark)[name]
    docs = table(spark, ODD)
    # Repeated rows, a null id, and nulls in all columns.
    extra = spark.createDataFrame([(None,) * 14, (None, "one", *(None,) * 12)], SCHEMA)
    docs = docs.union(docs.where("doc_id in (4, 8)")).union(extra)
    assert op(docs).count() == docs.count()
    empty = op(docs.limit(0))
    assert empty.count() == 0
    assert sorted(empty.columns) == sorted(op(docs).columns)


def test_quality_against_brute_force(spark):
    rng = random.Random(1)
    texts = [words(rng, 60), words(rng, 80) + "\n" + words(rng, 3) * 9, "same words again " * 40, " ".join("%032x" % rng.getrandbits(128) for _ in range(200)), words(rng, 700) + "\n#a\n\n#a\n" + words(rng, 9), None]
    texts[3] = " ".join("".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(8)) for _ in range(900))
    got = {r.doc_id: r for r in quality.compression_bands(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        triples = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j in range(len(w) - 2) if triples[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        if t:
            b = t.encode()
            ratio = len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False).compress(b)) / len(b)
            assert r.ratio == pytest.approx(ratio)
            low, high = quality.band(len(b))
            if not low <= ratio <= high:
                assert not r.kept
            # The verdict, by plain reading of the bands: the whole text, and the share of bytes in chunks out of band.
            squeezed = lambda x: len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False).compress(x)) / len(x)
            fits = lambda x: len(x) < 256 or quality.band(len(x))[0] <= squeezed(x) <= quality.band(len(x))[1]
            chunks = [b[k : k + 4096] for k in range(0, len(b), 4096)] if len(b) > 4096 else []
            bad = [c for c in chunks if not fits(c)]
            assert r.kept == (not r.base_failed and fits(b) and sum(map(len, bad)) <= 0.4 * len(b))
            assert (r.n_chunks, r.n_bad_chunks) == (sum(len(c) >= 256 for c in chunks), len(bad))
    assert not got[2].kept and not got[3].kept


def test_quality_bands_reject_junk_and_keep_good_texts(sf):
    """On labelled texts that the base rules keep: nearly no good one is rejected, and half of the junk is."""
    import duckdb

    folder = sf.replace("sf0.001", "sf0.01")
    compress = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False).compress
    rows = duckdb.sql(f"select text, quality from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) where text is not null").fetchall()
    kept = {0: [], 1: []}
    for text, good in rows:
        m = quality.measures(text.encode(), compress)
        if m[0] >= 50 and 100 * m[4] <= 50 * m[0]:
            kept[good].append(m[8])
    assert sum(kept[1]) >= 0.995 * len(kept[1]) and sum(kept[0]) <= 0.5 * len(kept[0])


def shingles(t, k=5):
    w = (t or "").encode().translate(common.LOWER).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def family(rng, n=60, length=120):
    """Copies of copies, each with a word changed, so that similarities lie on both sides of the bound."""
    out = [words(rng, length).split()]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent):
    rng = random.Random(percent)
    texts = family(rng) + family(rng, 20, 30) + [words(rng, 50) for _ in range(20)] + ["a b", "A B", "a b c", None, "", "z " * 400, "z " * 500]
    texts += texts[:5]
    want = brute_components(texts, percent)
    for rows in (3000, 25):  # also with blocks far smaller than the family
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, texts), percent, block_rows=rows).collect()}
        assert [got[i] for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (500, 900))
    ra, rb, both = neardup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    base = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    for j in (0.3, 0.6, 0.9):
        k = int(4000 * j)
        u, v = base[: (4000 + k) // 2], base[(4000 - k) // 2 :]
        x, y = neardup.sketches([u, v])
        same, more = np.array([(x == y).sum()]), np.array([(x > y).sum()])
        _, est = neardup.could_link(more, 252 - same - more, same, float(len(u)), np.array([float(len(v))]), 0.85)
        assert abs(est[0] - len(np.intersect1d(u, v)) / len(np.union1d(u, v))) < 0.12


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (3, 4), (None, 5), (200, 300)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[300] == 200 and len(got) == 61 + 40 + 2


def brute_lines(texts, least=1):
    seen, out = [], []
    for t in texts:
        gone = []
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
            if len(s) >= least:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone.append(i)
                seen.append(s)
        out.append(gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    base = [words(rng, n, 900) for n in (5, 8, 20, 40, 90, 200)]
    texts = []
    for _ in range(60):
        part = []
        for x in rng.sample(base, 3):
            w = x.split()
            for _ in range(rng.randrange(0, max(2, len(w) // 6))):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
            part.append(" ".join(w))
        texts.append("\n".join([*part, words(rng, 12, 10**6), "", "a b", " Tab\tline  with BLANKS and words "]))
    texts += [None, "", texts[0]]
    want = brute_lines(texts)
    got = {r.doc_id: r for r in lines.line_dedup(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]._removed) == want[i]
        if t is not None:
            assert got[i].text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i])
    assert got[len(texts) - 1]._n_lines == texts[0].count("\n") + 1 and got[0].kept is True


def test_line_dedup_tells_rarity_finely_and_moves_words_as_one_string(spark):
    """Words of counts within one power of two have different classes; the words of a line travel as one string."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200) for _ in range(4 + i % 4)) + "\nTwo\twords  two")], "_doc long, _text string")
    classes = lines._rarity(docs)
    at = [r.b for r in spark.range(200).selectExpr(f"cast(xxhash64(concat('w', id)) & {lines.RARITY_BUCKETS - 1} as int) as b").collect()]
    assert classes[at[0]] < classes[at[3]] and -32 <= min(classes) and max(classes) <= 31
    got = lines._words_of(docs, spark.createDataFrame([(1, 1)], "_doc long, _ln int"), 1 << 10).collect()
    assert [(r._w, r._m) for r in got] == [("two words", 2)]


def test_line_dedup_beside_columns_of_its_own_names(spark):
    rows = [(1, "a b c d\nx", 5, "k", [9], True, 7), (2, "y\nd c b a", 6, None, None, False, 8), (None, "a b c d", 7, "z", [1], None, 9)]
    docs = spark.createDataFrame(rows, "`doc id` long, text string, _doc int, `_ln.x` string, _Removed array<int>, _emptied boolean, _gone int")
    got = lines.line_dedup(docs, id_col="doc id")
    assert got.columns == ["doc id", "text", "_doc", "_ln.x", "_gone", "_n_lines", "_removed", "_emptied"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a b c d\nx", 5, "k", 7, 2, [], False), (2, "y", 6, None, 8, 2, [1], False), (None, "a b c d", 7, "z", 9, 1, [], False)], key=repr)


def test_line_dedup_moves_all_words_once_and_texts_once(spark, monkeypatch):
    """Only one join reads the rarest words of all lines; later ones read the few that met. No text travels twice."""
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return common.stored(df, name)

    monkeypatch.setattr(lines, "stored", seen)
    line, other = words(random.Random(12), 20, 900), words(random.Random(13), 9, 900)
    out = lines.line_dedup(table(spark, [line, f"{line} extra", f"{other}\n{other} x", None]))
    assert [list(r._removed) for r in out.sort("doc_id").collect()] == [[], [0], [1], []]
    assert [name for name, plan in plans.items() if "posexplode(_p" in plan] == ["met"]
    rows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS _row" in x]
    assert rows and all("text" not in x[x.index("struct(") : x.index("AS _row")] for x in rows)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_of_short_lines_against_brute_force(spark, least):
    rng = random.Random(10)
    short = ["All rights reserved.", "Read more", "read  MORE", "more", " ", "", "\t\x0b", "a b c", "c b a", "a b c d", "a b c d e", "a b c x", "x"]
    texts = ["\n".join([*rng.choices(short, k=8), words(rng, 6, 10**6)]) for _ in range(40)] + [None, "", "more"]
    want = brute_lines(texts, least)
    got = {r.doc_id: r for r in lines.line_dedup(table(spark, texts), least_words=least).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]._removed) == [j for j in want[i] if texts[i].split("\n")[j].strip()]
    assert any(t and t.split("\n")[j].strip() == "Read more" for t, w in zip(texts, want) for j in w) or least > 2


def test_winnowing_same_by_both_ways(spark):
    rng = random.Random(11)
    items = [words(rng, n, 3000) for n in (9, 10, 11, 40, 200, 3, 1)]
    docs = [words(rng, 100, 3000) for _ in range(20)]
    for i, d in enumerate(docs[:14]):
        w, b = d.split(), items[i % 7].split()
        n = min(len(b), rng.choice((9, 10, 15, 60)))
        at = rng.randrange(len(b) - n + 1)
        docs[i] = " ".join(w[:50] + b[at : at + n] + w[50:]).upper()
    bench = spark.createDataFrame([*enumerate(items), (7, None), (None, items[3])], "item_id long, text string")
    a = sorted(map(tuple, decontaminate.winnow_overlap(table(spark, docs), bench).collect()))
    b = sorted(map(tuple, decontaminate.winnow_overlap(table(spark, docs), bench, broadcast_bytes=0).collect()))
    assert a == b

    def brute(d):
        w = re.findall("[a-z0-9]+", d.lower())
        hit, ids = set(), set()
        for k, t in enumerate(items):
            x = t.split()
            n = min(10, len(x))
            runs = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    ids.add(str(k))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    assert [r[1:] for r in a] == [brute(d) for d in docs]
    assert any(r[2] for r in a)


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, rng.randrange(1, 400)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(9000)]
    df = spark.createDataFrame([*docs, (None, "x y", "a"), (5, docs[5][1], docs[5][2])], "doc_id long, text string, source string")
    got = mixing.cube_mix(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.cube_mix(df.repartition(7)).collect()))
    by = {}
    for r in got:
        s = by.setdefault(r.mix_source, [0, 0, r.source_size, r.target, 0, 0])
        s[0] += r.size
        s[1] += r.taken
        s[4] += r.copies
        s[5] += 1
        assert r.taken in (0, r.size, 2 * r.size)
    total = sum(s[0] for s in by.values())
    assert sum(s[3] for s in by.values()) == pytest.approx(1.5 * total)
    # Water-filling by hand.
    order = [*sorted(k for k in by if k is not None), None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = 1.5 * total - sum(target.values())
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] > 2 * by[k][0]}
        if not over:
            target |= {k: level * weight[k] for k in free}
            break
        target |= {k: 2.0 * by[k][0] for k in over}
        free -= over
    for k, (size, taken, source_size, t, copies, n) in by.items():
        assert source_size == size and t == pytest.approx(target[k])
        assert abs(taken - t) <= 400 and abs(copies - n * t / size) <= 3


def test_mixing_sizes_are_word_counts(spark):
    texts = ["hello", "The cat sat on 2 zebras\nyes", "ALL CAPS", "x", "a,b;c -- d!", "\ttab\x0bvt\x0cff\rcr\u00a0nbsp ", " ", "", None, "20 x09 x0D 漢字 é"]
    got = {r.doc_id: r for r in mixing.cube_mix(table(spark, texts)).collect()}
    want = [len(re.findall(common.WORD, t or "")) for t in texts]
    assert [got[i].size for i in range(len(texts))] == want and want[:2] == [1, 7]
    by = Counter()
    for i, n in enumerate(want):
        by[got[i].mix_source] += n
    assert all(r.source_size == by[r.mix_source] for r in got.values())


def test_cube_flight_keeps_both_totals():
    rng = np.random.default_rng(4)
    size, p = rng.integers(0, 5000, 3000).astype(float), rng.random(3000)
    out = mixing.flight(size, p, 1)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-4) and (size @ out) == pytest.approx(size @ p, rel=1e-6)


def test_redirects_pass_on_blocks(spark):
    page = lambda i, url, to=None, how="link": (i, url, f'<link rel="canonical" href="{to}">' if to and how == "link" else f'<META http-equiv=refresh content="0; URL={to}">' if to else "<p>")
    rows = [
        page(1, "https://a.net/x"), page(2, "https://www.example.net/en/1"), page(3, "https://example.net/de"), page(4, "http://x.example.com/de/q?z"), page(5, "https://u.org/fr/"), page(6, "https://u.org/en/"),
        page(7, "https://p.com/1", "https://bad.net/2"), page(8, "https://p.com/2", "/1", "refresh"), page(9, "https://q.com/1", "https://u.org/fr/2"), page(10, "https://q.com/2", "https://bad.net/7"), page(11, "https://q.com/2", "https://q.com/1"),
        page(12, "https://u.org/fr/9", "https://bad.net/2"), page(13, None), page(14, "no url"), page(15, "HTTPS://A.NET"), page(16, "https://r.com/#f", "https://r.com/#g"),
    ]
    got = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(1, 7)] == [("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow")]
    # The class of 7 and 8 has an allowed alias, 12: allow comes first; so it does for 9, 10 and 11.
    assert [got[i].verdict for i in (7, 8, 9, 10, 11, 12)] == ["allow"] * 6
    assert got[13].host == "" and got[14].path == "" and got[15].rule is None and got[15].host == "a.net" and got[16].alias_of is None
    some = [r for r in rows if r[0] in (7, 8)]
    assert {r.verdict for r in urls.url_verdicts(spark.createDataFrame(some, "page_id long, url string, html string")).collect()} == {"block"}


def test_redirects_resolve_targets(spark):
    link, move = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://bad.net/d/1.html", link.format("page2.html")), (2, "https://bad.net/d/2.html", move.format("../a")), (3, "https://bad.net/d/3?x=1", link.format("?id=1&amp;n=2")),
        (4, "https://p.com/1", "<base href='//bad.net/b/'>" + link.format("c")), (5, "https://p.com/2", link.format("https://q.com/x?a=1&amp;b=2") + link.format("https://bad.net/7") + move.format("/r")),
        (6, "https://q.com/x?a=1&b=2", None), (7, "https://p.com/r", "<p>"), (8, "https://p.com/3", move.format("javascript:x()")), (9, "no url", link.format("x")), (10, "https://p.com/4?to", link.format("?u=https://bad.net/")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.src[-6:], r.dst) for r in urls.html_edges(df.where("page_id < 5")).collect()) == sorted([("1.html", "https://bad.net/d/page2.html"), ("2.html", "https://bad.net/a"), ("/3?x=1", "https://bad.net/d/3?id=1&n=2"), (".com/1", "https://bad.net/b/c")])
    got = {r.page_id: (r.verdict, r.alias_of) for r in urls.url_verdicts(df).collect()}
    assert [got[i][0] for i in (4, 5, 6, 7, 8, 10)] == ["block"] * 4 + ["allow"] * 2
    assert got[5][1] == got[6][1] == got[7][1] == "bad.net/7" and got[8][1] is None and got[9][1] is None and got[10][1] == "p.com/4?to"


def test_licenses_by_exact_wording():
    s = licenses.Scanner()
    names = lambda t: [r["license"] for r in s.scan(t.encode())]
    for name, _, text in licenses.TEMPLATES:
        for form in (text, f"Some prose before.\n{text}\nand after", "filler words of prose " * 60 + text + " more filler words of prose" * 60):
            assert set(names(form)) == {name}, form
    assert names("Licensed under the Apache License, Version 1.1.") == [None]
    assert names("He was given a license to drive.") == [None]
    assert names("SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause"]
    assert names("plain text") == [] and s.scan(None) == []


def test_license_differences_against_brute_force():
    """Whether a template matches is a matter of the words in order: missing and inserted ones are counted by a plain table of common subsequences."""
    rng = random.Random(21)
    s = licenses.Scanner()
    for _ in range(60):
        name, must, text = rng.choice([t for t in licenses.TEMPLATES if len(t[2].split()) > 8])
        want = licenses.tokens(text)
        have = list(want)
        for _ in range(rng.randrange(0, 4)):
            have.pop(rng.randrange(1, len(have) - 1)) if rng.random() < 0.5 else have.insert(rng.randrange(1, len(have)), rng.choice(["zebra", "quickly", "blue"]))
        best = [[0] * (len(want) + 1) for _ in range(len(have) + 1)]
        for i, a in enumerate(have):
            for j, b in enumerate(want):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        common = best[-1][-1]
        fixed = set(must.split()) | {w for w in want if any(c.isdigit() for c in w)}
        right = common >= 0.9 * len(want) and len(have) - common <= 0.25 * len(want) and fixed <= set(have)
        got = {r["license"]: r for r in s.scan(" ".join(have).encode())}
        if right:
            assert name in got and got[name]["missing"] <= len(want) - common + 2
        elif common < 0.85 * len(want):
            assert name not in got


def test_licenses_of_wrapped_notices():
    s = licenses.Scanner()
    prose = "Some words of prose that stand before and after it."
    for name, _, text in licenses.TEMPLATES:
        for mark in ("", "# ", " * ", "// "):
            for width in (72, 24):
                wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width))
                got = {r["license"] for r in s.scan(f"{prose}\n{mark}\n{wrapped}\n{mark}\n{prose}".encode())}
                assert name in got, (name, mark, width)
    assert {r["license"] for r in s.scan("\n".join(textwrap.wrap(licenses.TEMPLATES[6][2].replace("version 3", "version 4"), 72)).encode())} == {None}


def test_licenses_of_several_grants():
    names = lambda t: sorted(r["license"] or "" for r in licenses.Scanner().scan(t.encode()))
    assert names("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.") == ["Apache-2.0", "MIT"]
    assert names("SPDX-License-Identifier: MIT OR Apache-2.0") == ["Apache-2.0", "MIT"]
    assert names("# SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0 AND MIT) OR BSD-3-Clause. And prose") == ["BSD-3-Clause", "GPL-2.0+", "MIT"]
    assert names("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: ISC\nLicensed under CC BY 4.0.") == ["CC-BY-4.0", "ISC", "MIT"]
    assert names("SPDX-License-Identifier: MIT and then prose") == ["MIT"]
    gpl = "This work is licensed under the GNU General Public License, version 3."
    assert names(gpl.replace("General", "Affero General")) == ["AGPL-3.0"] and names(gpl.replace("General", "Lesser General")) == ["LGPL-3.0"]
    assert names(gpl.replace("General", "Affero General") + "\n" + gpl) == ["AGPL-3.0", "GPL-3.0"]
    assert names(" ".join(x[2] for x in licenses.TEMPLATES)) == sorted({x[0] for x in licenses.TEMPLATES})


def test_pseudonyms_keep_form_and_links(spark):
    texts = ["card 4111 1111 1111 1111 and 4111111111111111", "born 1999-12-31, met 2/29/2000, left 31.02.2001", "a.b@x.org a.b@x.org c.d@x.org", "call +1 (415) 555-1234", "999.1.1.1 10.0.0.1", None, "", "password=abcd1234efgh"]
    got = [r.text for r in pii.pseudonymise(table(spark, texts), "k").orderBy("doc_id").collect()]
    a, b = re.match(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})$", got[0]).groups()
    assert a.replace(" ", "") == b != "4111111111111111"
    digits = [int(c) for c in b][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.match(r"born \d{4}-\d\d-\d\d, met \d{1,2}/\d{1,2}/\d{4}, left 31.02.2001$", got[1]) and "1999-12-31" not in got[1]
    x, y, z = got[2].split()
    assert x == y != z and x != "a.b@x.org" and x.endswith("@x.org")
    assert re.match(r"call \+1 \(\d{3}\) \d{3}-\d{4}$", got[3]) and "555-1234" not in got[3]
    assert got[4].startswith("999.1.1.1 ") and got[4] != texts[4]
    assert got[5] is None and got[6] == "" and re.match(r"password=[a-z]{4}\d{4}[a-z]{4}$", got[7])
    n, k = pii.keyed(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x")), "k")
    assert n.select(pii.permuted(F.col("x"), 10, k).alias("y")).distinct().count() == 1000


def test_pseudonyms_of_dates_are_one_to_one(spark):
    """All texts of all forms over thirteen years: nothing shared, nothing changes its form."""
    day = "date_add(date'1999-12-28', cast(id as int))"
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "dd.M.yyyy", "d.MM.yyyy", "MM/dd/yyyy", "M/d/yyyy", "M/dd/yyyy", "MM/d/yyyy", "dd/MM/yyyy", "d/M/yyyy", "dd/M/yyyy"]
    texts = spark.range(5000).selectExpr(f"explode(array({', '.join(f"date_format({day}, '{f}')" for f in forms)})) as x").distinct()
    texts, k = pii.keyed(texts, "k")
    got = texts.select("x", pii._date(F.col("x"), k.of("date")).alias("y"))
    shape = lambda c: F.regexp_replace(c, "[0-9]", "9")
    r = got.agg(F.count("*").alias("n"), F.count("y").alias("m"), F.countDistinct("y").alias("d"), F.sum((shape("x") == shape("y")).cast("int")).alias("s"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("e")).first()
    assert r.n == r.m == r.d == r.s and r.n > 30000 and r.e < 50


def plain_feistel(x, kind, key=b"k", piece=0):
    """The network on decimal digits in plain Python."""
    n, u = len(x), len(x) // 2
    left, right = int(x[:u] or 0), int(x[u:])
    for i in range(8):
        mac = hmac.new(key, f"{kind}|{piece}|{i}|{n}|{right}".encode(), hashlib.sha256).hexdigest()
        left, right = right, (left + int(mac[:14], 16)) % 10 ** (u if i % 2 == 0 else n - u)
    return (str(left).zfill(u) if u else "") + str(right).zfill(n - u)


def test_pseudonyms_against_plain_python(spark):
    rng = random.Random(14)

    def luhn(d):
        s = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return d + str(-s % 10)

    def day(text):
        x = str((datetime.date.fromisoformat(text) - datetime.date(1900, 1, 1)).days)
        while True:
            x = plain_feistel(x.zfill(5), "date")
            if int(x) < 73049:
                return str(datetime.date(1900, 1, 1) + datetime.timedelta(int(x)))

    def ssn(x):
        while True:
            x = plain_feistel(x, "ssn")
            if not (x[:3] in ("000", "666") or x[0] == "9" or x[3:5] == "00" or x[5:] == "0000"):
                return f"{x[:3]}-{x[3:5]}-{x[5:]}"

    def iban(bban):
        new = plain_feistel(bban, "ibandigits")
        return "DE" + str(98 - int(new + "131400") % 97).zfill(2) + new

    cases = []
    for _ in range(30):
        c = luhn("4" + "".join(rng.choices("0123456789", k=14)))
        cases.append((c, luhn(c[:4] + plain_feistel(c[4:15], "card"))))
        d = str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049)))
        cases.append((d, day(d)))
        s = f"{rng.randrange(1, 600):03}{rng.randrange(1, 100):02}{rng.randrange(1, 10000):04}"
        cases.append((f"{s[:3]}-{s[3:5]}-{s[5:]}", ssn(s)))
        b = "".join(rng.choices("0123456789", k=18))
        cases.append(("DE" + str(98 - int(b + "131400") % 97).zfill(2) + b, iban(b)))
        p = "".join(rng.choices("0123456789", k=10))
        cases.append((f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}", "+1 ({}{}{}) {}{}{}-{}{}{}{}".format(*plain_feistel(p, "phone"))))
    left = ["4111111111111112", "9807915762804490", "000-12-3456", "DE00370400440532013000", "1999-02-29", "02/30/2020", "31.02.2001", "999.1.1.1", "v1.2.3.4", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "password: required", "117-555-1234"]
    cases += [(x, x) for x in left]
    got = pii.pseudonymise(table(spark, [f"see {a} there" for a, _ in cases]), "k").orderBy("doc_id").collect()
    assert [r.text for r in got] == [f"see {b} there" for _, b in cases]
    assert [r.pii_changed for r in got] == [1] * 150 + [0] * len(left)


def test_pseudonyms_hide_the_key_and_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a.b@x.org", 5, 6, b"7")], "id long, text string, _pii int, PII_changed int, _ik binary")
    out = pii.pseudonymise(docs, "very-secret-key")
    assert out.columns == ["id", "text", "_pii", "_ik", "pii_changed"] and out.first()[2:] == (5, b"7", 1)
    assert "very-secret" not in out._jdf.queryExecution().toString() and "76657279" not in out._jdf.queryExecution().toString()


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    odd = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, None, "en"), (-2, "12 34! \u00bd \u00b2 \u2167", "en")], "doc_id long, text string, lang string"))).where("doc_id < 0").collect()}
    assert odd[-1].lang_pred == odd[-2].lang_pred == "und"


def test_language_learns_every_language(spark):
    rng = random.Random(12)
    # Seventy codes, five of them with few rows, each with words of its own letters.
    codes = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(68)] + ["en", "de"]
    own = {c: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for c in codes}
    rows = [(i * 100 + k, " ".join(rng.choices(own[c], k=30)), c) for i, c in enumerate(codes) for k in range(8 if i < 5 else 12)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=8).collect()
    right = {i: c for i, _, c in rows}
    assert {r.lang_pred for r in got} == set(codes)
    assert sum(right[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(got)
    of = language.families([*map(str, range(1000)), "en", "de"])
    assert of["en"] == of["de"] == "germanic" and len(set(of.values())) <= 100
    assert language.families(["xa", "xb"]) == {"xa": "own:xa", "xb": "own:xb"}


def test_label_model_downweights_copies():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    good = (rng.random((2000, 3)) < np.where(y[:, None], 0.8, 0.02)).astype(np.int8)
    noise = (rng.random((2000, 1)) < 0.15).astype(np.int8).repeat(4, axis=1)
    post, found = toxicity.label_model(np.hstack((good, noise)), 0.2, np.where(np.arange(2000) < 300, y, -1))
    assert ((post > 0.5) == y)[300:].mean() > 0.95
    # Three of the four copies lean on another one, so they speak as it does and add nothing.
    copies = [i for i in range(3, 7) if found["leans_on"][i] in range(3, 7)]
    assert len(copies) == 3 and all(found["fires_if_clean"][1][i] > 0.9 and found["fires_if_clean"][0][i] < 0.1 for i in copies)


def test_label_model_against_brute_force_likelihood():
    """With voters that are independent given the label, the posterior is Bayes' rule on their true rates."""
    rng = np.random.default_rng(5)
    y = rng.random(20000) < 0.15
    on, off = np.array([0.7, 0.5, 0.4, 0.6]), np.array([0.05, 0.02, 0.01, 0.1])
    v = rng.random((20000, 4)) < np.where(y[:, None], on, off)
    post, _ = toxicity.label_model(v, 0.15, np.where(np.arange(20000) < 3000, y, -1))
    for code in range(16):
        bits = np.array([code >> i & 1 for i in range(4)], bool)
        at = (v == bits).all(1) & (np.arange(20000) >= 3000)
        if at.sum() >= 50:
            a, b = 0.15 * np.where(bits, on, 1 - on).prod(), 0.85 * np.where(bits, off, 1 - off).prod()
            assert abs(post[at].mean() - a / (a + b)) < 0.1


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = words(rng, 60, 5000)
        if bad:
            t += f" zorg{rng.choice('abcdefgh')} {rng.choice(['grubble', 'snark', 'zorgish'])}"
        texts.append(t)
        labels.append((i, int(bad)))
    got = toxicity.toxicity(table(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
