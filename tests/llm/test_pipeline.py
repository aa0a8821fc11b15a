"""Registered queries and the pipeline, end to end."""

import re

import pytest

import corpus_pipeline
from loomspan.llm import queries

from ..oracle import compare
from .test_operators import brute_components, brute_lines


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near-duplicates", "decontamination", "mixing"]

    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns and 0 < clean.count() <= docs.count()

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    gone = brute_lines([r.text for r in rows])
    want = {}
    for r, g in zip(rows, gone):
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in g)
        if not g or re.search(r"[^\x20\x09-\x0D]", text):
            want[r.doc_id] = text
    got = stages["line dedup"](spark, docs, sf)
    assert got.columns == columns
    assert {r.doc_id: r.text for r in got.collect()} == want

    comps = brute_components([r.text for r in rows], 80)
    got = stages["near-duplicates"](spark, docs, sf)
    assert got.columns == columns
    assert sorted(r.doc_id for r in got.collect()) == [rows[i].doc_id for i, (_, c) in enumerate(comps) if c == i]

    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = {tuple(b[i : i + 10]) for b in bench for i in range(len(b) - 9)}
    short = [tuple(b) for b in bench if 0 < len(b) < 10]

    def hit(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return any(tuple(w[i : i + 10]) in runs for i in range(len(w))) or any(tuple(w[i : i + len(s)]) == s for s in short for i in range(len(w)))

    got = stages["decontamination"](spark, docs, sf)
    assert got.columns == columns
    assert sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in rows if not hit(r.text)]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {"doc_id", "taken"} <= set(out[0].asDict())
    assert len({r.doc_id for r in out}) == len(out)


def test_stages_on_odd_input(spark, sf):
    """Nulls in any column, empty texts, repeated rows, rows without an id, and an empty table, through each stage."""
    same = "alpha beta gamma delta"
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, f"{same}\n\n{same}", "en", "a", 5), (3, f"{same}\n\n{same}", "en", "a", 5), (None, "orphan text of five words", "de", None, 3), (4, same, "fr", "b", 1), (5, "é" * 30000, "fr", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf).collect()
        ids = sorted((r.doc_id for r in got), key=repr)
        if name == "line dedup":
            # The repeated line goes, so does the document that only had it.
            assert ids == [1, 2, 3, 3, 5, None] and {r.text for r in got if r.doc_id == 3} == {f"{same}\n"}
        else:
            assert ids == [1, 2, 3, 3, 4, 5, None], name
        if name != "mixing":
            assert list(got[0].asDict()) == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0, name
