"""Line dedup as an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Words are ordered by rarity; two lines of similarity 0.8 or more share one of their
rarest words, at positions and with lengths that leave room for the overlap. A line that is similar to an earlier one,
by document id and then line number, is removed.

Only the existence of an earlier line matters, so all joins on words are semi joins: none emits pairs, and a hot group
gives a row for each of its lines at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, dropped, longs, maybe_among, quoted, stored

#: Buckets of word hashes that are counted for rarity; the bound is fixed.
RARITY_BUCKETS = 1 << 16
#: Lines of fewer distinct words are left alone. One: every line that is not blank takes part.
LEAST_WORDS = 1
#: Sets of fewer words than this are similar to equal sets only, so they needn't meet others.
LEAST_UNEQUAL = 4
#: Earlier lines of each word of which the likeliest is tried first. No cap: lines that fail meet all others afterwards.
TRIED = 16
#: Words up to which the parities of a set fit one long; those of larger sets take two.
ONE_LONG = 100

_BLANKS = r"'[\\t\\r\\f\\x0B]'"
_HAS_BLANKS = " or ".join(f"contains(_text, char({c}))" for c in (9, 13, 12, 11))
_WORDS = "array_remove(split(_l, ' '), '')"
#: A bound on the words that differ, by parities that do; a set of two longs is folded to meet one of one.
_FOLDED = "bit_count(a._b0 ^ a._b1 ^ b._b0 ^ b._b1)"
_APART = f"if(a._n <= {ONE_LONG} or b._n <= {ONE_LONG}, {_FOLDED}, bit_count(a._b0 ^ b._b0) + bit_count(a._b1 ^ b._b1))"
#: Similar sets differ in a ninth of their summed sizes at most. The rarest common word has no more than these before it.
_MEET = f"""a._tok = b._tok and 9 * {_FOLDED} <= a._n + b._n and (a._ln <> b._ln or a._doc <> b._doc)
  and 5 * least(a._n, b._n) >= 4 * greatest(a._n, b._n) and 9 * (a._pos + b._pos) <= a._n + b._n
  and 9 * least(a._n - a._pos, b._n - b._pos) >= 4 * (a._n + b._n) and 9 * {_APART} <= a._n + b._n"""
#: The same, and b is earlier.
_SIMILAR = f"{_MEET} and (a._doc > b._doc or (a._doc = b._doc and a._ln > b._ln))"
_EXACT = "9 * size(array_intersect(split(a._w, ' '), split(b._w, ' '))) >= 4 * (a._m + b._m)"


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that are not empty, in lower case and with plain blanks; the whole text is turned at once, which costs less than by lines."""
    text = f"lower(if({_HAS_BLANKS}, regexp_replace(_text, {_BLANKS}, ' '), _text)) as _text"
    return docs.selectExpr("_doc", text).selectExpr("_doc", r"posexplode(split(_text, '\n')) as (_ln, _l)").where("_l <> ''")


def _rarity(own: DataFrame) -> list[int]:
    """A class from -32 to 31 for each bucket of word hashes, by its rank in how often its words occur in all documents.

    48 classes share the lower 31 of 32 parts of the buckets evenly, the others halve what is left, one after another.
    """
    counts = own.selectExpr(r"explode(split(replace(lower(_text), '\n', ' '), ' ')) as _w").groupBy(F.expr(f"cast(xxhash64(_w) & {RARITY_BUCKETS - 1} as int)").alias("_b")).count().toArrow()
    often = np.zeros(RARITY_BUCKETS, np.int64)
    often[counts.column("_b").to_numpy()] = counts.column("count").to_numpy()
    below = np.searchsorted(np.sort(often), often) / RARITY_BUCKETS
    return np.where(below < 31 / 32, below * 32 / 31 * 48 - 32, np.minimum(31, 11 - np.log2(1 - below))).astype(np.int64).tolist()


def _measured(own: DataFrame) -> DataFrame:
    """Each line: _n words, digests _s1 and _s2 of their set and _h of the line in lower case, parities, and the rarest words _p.

    A word is its class of rarity and 58 bits of its hash, so plain order is order by rarity. Nothing in the words'
    expression may be null, as arrays without nulls are sorted as primitives.
    """
    token = f"shiftleft(coalesce(get({longs(_rarity(own))}, cast(h & {RARITY_BUCKETS - 1} as int)), 0L), 58) | shiftrightunsigned(h, 6)"
    flip = "m ^ shiftleft(1L, cast(x & 63 as int))"
    parity = [
        f"if(size(_t) <= {ONE_LONG}, aggregate(_t, 0L, (m, x) -> {flip}), aggregate(_t, 0L, (m, x) -> if((x & 64) = 0, {flip}, m))) as _b0",
        f"if(size(_t) <= {ONE_LONG}, 0L, aggregate(_t, 0L, (m, x) -> if((x & 64) = 0, m, {flip}))) as _b1",
    ]
    sets = _lines(own).selectExpr("_doc", "_ln", "xxhash64(_l) as _h", f"array_distinct(sort_array(transform(transform({_WORDS}, x -> xxhash64(x)), h -> {token}))) as _t")
    return sets.selectExpr("_doc", "_ln", "_h", "size(_t) as _n", "xxhash64(_t) as _s1", "xxhash64(_t, 1) as _s2", *parity, "slice(_t, 1, size(_t) - (4 * size(_t) + 4) div 5 + 1) as _p")


def _words_of(own: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """_doc, _ln, the distinct words of the wanted lines, as one string _w with blanks between, and their number _m; only lines that may be wanted are moved."""
    some = _lines(own.where(maybe_among(wanted, bits, "_doc")("_doc"))).where(maybe_among(wanted, bits, "_doc", "_ln")("_doc", "_ln"))
    return some.join(wanted, ["_doc", "_ln"], "left_semi").dropDuplicates(["_doc", "_ln"]).selectExpr("_doc", "_ln", f"array_distinct({_WORDS}) as _w").selectExpr("_doc", "_ln", "array_join(_w, ' ') as _w", "size(_w) as _m")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """_doc, _ln of each line that repeats an earlier one (similarity 0.8 or more of their sets of words)."""
    own = docs.select(F.col(quoted(id_col)).alias("_doc"), F.col(quoted(text_col)).alias("_text")).where("_doc is not null and _text is not null")
    table = stored(_measured(own), "lines")
    measured = table.where(f"_n >= {max(1, least_words)}")  # not before: the sets would be made once more for it

    # Lines of the same set: the first stands for the others. A copy of the first is surely the same; others are looked at.
    sets = measured.groupBy("_s1", "_s2").agg(F.min(F.struct("_doc", "_ln", "_h", "_n", "_b0", "_b1", "_p")).alias("_f"), F.count("*").alias("_k")).select("_s1", "_s2", "_k", "_f.*")
    sets = stored(sets, "sets")
    firsts = sets.where("_k > 1").selectExpr("_s1 as _c1", "_s2 as _c2", "_doc as _fd", "_ln as _fl", "_h as _fh")
    same = measured.select("_doc", "_ln", "_h", "_s1", "_s2").join(firsts, (F.col("_s1") == F.col("_c1")) & (F.col("_s2") == F.col("_c2"))).where("_doc <> _fd or _ln <> _fl")
    same = stored(same.selectExpr("_doc", "_ln", "_fd", "_fl", "_h = _fh as _sure"), "same")
    dropped(table)

    # All words meet once, whichever line is earlier; of the few that pass the filters with any other line, those with an
    # earlier one that passes, and the earlier ones.
    words = sets.where(f"_n >= {LEAST_UNEQUAL}").selectExpr("_doc", "_ln", "_n", "_b0", "_b1", "posexplode(_p) as (_pos, _tok)")
    met = stored(words.alias("a").join(words.alias("b"), F.expr(_MEET), "left_semi"), "met")
    part = stored(met.alias("a").join(met.alias("b"), F.expr(_SIMILAR), "left_semi"), "candidates")
    near = stored(met.alias("b").join(part.alias("a"), F.expr(_SIMILAR), "left_semi"), "near")
    dropped(met)

    # The likeliest of the first few earlier lines of its words is tried for each line; nearly all repeats show there.
    few = near.withColumn("_r", F.expr("row_number() over (partition by _tok order by _doc, _ln)")).where(f"_r <= {TRIED}")
    tried = part.alias("a").join(few.alias("b"), F.expr(_SIMILAR)).selectExpr("a._doc", "a._ln", f"struct({_APART} - abs(a._n - b._n) as d, b._doc, b._ln) as _o")
    best = tried.groupBy("_doc", "_ln").agg(F.min("_o").alias("_o")).selectExpr("_doc", "_ln", "_o._doc as _fd", "_o._ln as _fl")
    pairs = stored(best.union(same.where("not _sure").select("_doc", "_ln", "_fd", "_fl")), "pairs")
    ids = lambda df, *names: df.select(*names).toDF("_doc", "_ln")
    wanted = stored(ids(part, "_doc", "_ln").union(ids(near, "_doc", "_ln")).union(ids(pairs, "_doc", "_ln")).union(ids(pairs, "_fd", "_fl")).distinct(), "wanted")
    texts = stored(_words_of(own, wanted, filter_bits), "words")
    a = pairs.join(texts, ["_doc", "_ln"]).select("_fd", "_fl", F.struct("_doc", "_ln", "_w", "_m").alias("a"))
    b = a.join(texts.selectExpr("_doc as _fd", "_ln as _fl", "struct(_w, _m) as b"), ["_fd", "_fl"])
    settled = stored(b.where(_EXACT).select("a._doc", "a._ln").union(same.where("_sure").select("_doc", "_ln")).distinct(), "settled")

    # The others meet all earlier lines that pass the filters, in a semi join on whole sets that ends at the first repeat.
    open_ = stored(part.join(settled, ["_doc", "_ln"], "left_anti").join(texts, ["_doc", "_ln"]), "open")
    rest = near.where(maybe_among(open_, filter_bits, "_tok")("_tok")).alias("b").join(open_.drop("_w", "_m").alias("a"), F.expr(_SIMILAR), "left_semi").join(texts, ["_doc", "_ln"])
    similar = open_.alias("a").join(rest.alias("b"), F.expr(f"{_SIMILAR} and {_EXACT}"), "left_semi").select("_doc", "_ln").distinct()
    out = stored(similar.union(settled), "repeated")
    for df in (sets, same, part, near, pairs, wanted, texts, settled, open_):
        dropped(df)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with the text less its repeated lines, all columns kept; then _n_lines, _removed (line numbers, from 0) and _emptied.

    The first of similar lines stays, in order of document id and line number. A document that repeats a line within
    itself loses the later one too. Lines of under least_words distinct words, and blank ones, stay. Null texts and
    rows without an id are not touched. Rows that repeat an id and text lose the same lines; of different texts under
    one id, lines are told apart by their number only. _emptied: the removal left no word. Columns of docs by the names
    of the three new ones are replaced, whatever their case; other names can't clash. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, id_col, text_col, least_words, filter_bits)
    lists = gone.groupBy(F.col("_doc").alias("_gone")).agg(F.sort_array(F.collect_set("_ln")).alias("_removed"))
    names = [c for c in docs.columns if c.lower() not in ("_n_lines", "_removed", "_emptied")]
    # The row travels as one struct, so its names meet none of ours.
    rows = docs.select(F.col(quoted(id_col)).alias("_doc"), F.col(quoted(text_col)).alias("_text"), F.struct(*(F.col(quoted(c)) for c in names if c.lower() != text_col.lower())).alias("_row"))
    hit = F.coalesce(maybe_among(gone, filter_bits, "_doc")("_doc"), F.lit(False))
    none = F.expr("cast(array() as array<int>)")
    left = rows.where(hit).join(lists, F.col("_doc") == F.col("_gone"), "left").select("_text", "_row", F.coalesce("_removed", none).alias("_removed"))
    out = left.union(rows.where(~hit).select("_text", "_row", none.alias("_removed")))
    lines = F.split("_text", "\n")
    cleaned = F.when(F.size("_removed") > 0, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_removed", i)), "\n")).otherwise(F.col("_text"))
    out = out.select("_row", "_removed", F.coalesce(F.size(lines), F.lit(0)).alias("_n_lines"), cleaned.alias("_left"))
    kept: list[Column] = [(F.col("_left") if c.lower() == text_col.lower() else F.col("_row").getField(c)).alias(c) for c in names]
    return out.select(*kept, "_n_lines", "_removed", ((F.size("_removed") > 0) & ~F.coalesce(F.col("_left").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).alias("_emptied"))


#: DuckDB SQL of the op5 query.
OP5_SQL = r"""
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as ln, unnest(string_split(text, chr(10))) as line from documents),
t as materialized (select doc_id, ln, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) as w from l),
s as materialized (select doc_id, ln, w, len(w) as n from t where len(w) >= 1),
f as materialized (select distinct list_sort(w) as w, min((doc_id, ln)) as first from s group by list_sort(w)),
r as materialized (select first[1] as doc_id, first[2] as ln, w, len(w) as n from f),
k as materialized (select doc_id, ln, n, w, unnest(w) as k from r),
c as materialized (select k, count(*) as df from k group by k),
o as materialized (select doc_id, ln, n, w, k.k, row_number() over (partition by doc_id, ln order by df, k.k) as pos from k join c on k.k = c.k),
p as materialized (select * exclude (pos) from o where pos <= n - (4 * n + 4) // 5 + 1),
gone as (select s.doc_id, s.ln from s anti join r using (doc_id, ln)
  union select distinct a.doc_id, a.ln from p a join p b on a.k = b.k and (b.doc_id, b.ln) < (a.doc_id, a.ln) and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) where 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
x as (select l.doc_id, count(*) as n_lines, count(gone.ln) as n_removed, string_agg(case when gone.ln is null then line end, chr(10) order by l.ln) as text from l left join gone on l.doc_id = gone.doc_id and l.ln = gone.ln group by l.doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when d.text is null then null else sha256(coalesce(x.text, '')) end as text_sha256
from documents d left join x using (doc_id)
"""
