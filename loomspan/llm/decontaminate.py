"""Benchmark decontamination by winnowing: the least k-gram hash of each window of texts and items meet, and hits are extended.

k + WINDOW - 1 is the length of a benchmark window, so each shared span of that many words holds a fingerprint that
both sides select. Items with fewer words are windows of their own length and are looked up at every position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WordHashes, as_bytes, grams, mix, pieces, quoted, stored, texts_map, without

SPAN = 10
GRAM = 6
WINDOW = SPAN - GRAM + 1
#: Bytes of benchmark text up to which its fingerprints are broadcast; beyond it, fingerprints are joined.
BROADCAST_BYTES = 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k-grams that are the (last) least of some window; for SPAN words or more."""
    g = grams(h, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.unique(np.arange(len(view)) + WINDOW - 1 - view[:, ::-1].argmin(axis=1))
    return at, g[at]


def short_key(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n words, apart for each n."""
    return mix(grams(h, n) + np.uint64(n))


def spans_on(doc_h: np.ndarray, item_h: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Runs of least or more equal words where item word i stands at document word i + shift."""
    lo, hi = max(0, -shift), min(len(item_h), len(doc_h) - shift)
    if hi - lo < least:
        return []
    same = np.concatenate(([False], doc_h[lo + shift : hi + shift] == item_h[lo:hi], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(int(a) + lo + shift, int(b) + lo + shift) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def pair_spans(doc: list[bytes], doc_h: np.ndarray, item: list[bytes], item_h: np.ndarray, shifts) -> list[tuple[int, int]]:
    least = min(SPAN, len(item))
    return [(a, b) for s in shifts for a, b in spans_on(doc_h, item_h, s, least) if doc[a:b] == item[a - s : b - s]]


class Index:
    """Fingerprints of the items that the driver holds."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]]):
        hashes = WordHashes()
        self.ids, self.words, self.h = [], [], []
        keys, where = [], []
        short: dict[int, list] = {}
        for name, text in rows:
            words = words_of(text)
            if not words:
                continue
            i, h = len(self.ids), hashes.of(words)
            self.ids.append(name)
            self.words.append(words)
            self.h.append(h)
            if len(words) >= SPAN:
                at, values = winnowed(h)
                keys.append(values)
                where += [(i, int(p)) for p in at]
            else:
                short.setdefault(len(words), []).append((short_key(h, len(words))[0], i))
        values = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.where = np.array(where, np.int64).reshape(-1, 2)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.short = {}
        for n, found in short.items():
            found.sort()
            self.short[n] = np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found], np.int64)

    def matches(self, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into values, index into keys (sorted) of all equal pairs."""
        lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(values)), n)
        return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[at]

    def hits(self, words: list[bytes], h: np.ndarray) -> tuple[int, set[int]]:
        """Words inside benchmark windows, and the items."""
        spans, items = [], set()
        if len(words) >= SPAN and len(self.values):
            at, values = winnowed(h)
            maybe = self.seen[(values & np.uint64(0xFFFFF)).astype(np.int64)]
            at, values = at[maybe], values[maybe]
            if len(at):
                a, b = self.matches(values, self.values)
                if len(a):
                    for i, shift in np.unique(np.stack((self.where[b, 0], at[a] - self.where[b, 1]), 1), axis=0).tolist():
                        if got := pair_spans(words, h, self.words[i], self.h[i], (shift,)):
                            spans += got
                            items.add(i)
        for n, (keys, owner) in self.short.items():
            if len(words) >= n:
                a, b = self.matches(short_key(h, n), keys)
                for p, i in zip(a.tolist(), owner[b].tolist()):
                    if words[p : p + n] == self.words[i]:
                        spans.append((p, p + n))
                        items.add(i)
        if not spans:
            return 0, items
        hit = np.zeros(len(words), bool)
        for a, b in spans:
            hit[a:b] = True
        return int(hit.sum()), items


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("words"))


def index_of(benchmark: DataFrame, item_col: str, item_text: str, broadcast_bytes: int):
    """The items' index, broadcast; None if their text is larger than the bound."""
    items = _items(benchmark, item_col, item_text)
    if (items.agg(F.sum(F.length("words"))).first()[0] or 0) > broadcast_bytes:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(Index([(r.item, bytes(r.words or b"")) for r in items.collect()]))


def winnow_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts or items have no words and hit nothing. Items that repeat an id count once, an item without
    an id is hit but not counted. Repeated rows give repeated results; other columns are not read. Either table may be
    empty. A benchmark of up to broadcast_bytes of text is indexed once and broadcast, so documents aren't shuffled;
    a larger one is joined by fingerprint, with the same results.
    """
    items = _items(benchmark, item_col, item_text)
    kind = docs.schema[id_col].dataType.simpleString()
    held = index_of(benchmark, item_col, item_text, broadcast_bytes)
    if held is None:
        return _joined(docs, items, id_col, text_col)
    none, hashes = digest(()), WordHashes()

    def work(batch: pa.RecordBatch) -> dict:
        index = held.value
        n_words, n_hit, n_items, sha = [], [], [], []
        for text in as_bytes(batch, text_col):
            words = words_of(text)
            n, found = index.hits(words, hashes.of(words))
            ids = {index.ids[i] for i in found} - {None}
            n_words.append(len(words))
            n_hit.append(n)
            n_items.append(len(ids))
            sha.append(digest(ids) if ids else none)
        long = pa.int64()
        return {id_col: batch.column(id_col), "n_words": pa.array(n_words, long), "n_hit": pa.array(n_hit, long), "n_items": pa.array(n_items, long), "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_())}

    return texts_map(docs, [id_col, text_col], work, f"{quoted(id_col)} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _fingerprints(table: DataFrame, key: str, text: str, lengths: list[int] | None) -> DataFrame:
    """Distinct fingerprints of each row; short ones of the row's own length (lengths None) or of all given lengths."""

    hashes = WordHashes()

    def work(batch: pa.RecordBatch) -> dict:
        ids, out = [], []
        for i, t in zip(batch.column(key).to_pylist(), as_bytes(batch, text)):
            words = words_of(t)
            h = hashes.of(words)
            got = [winnowed(h)[1]] if len(words) >= SPAN else []
            for n in lengths if lengths is not None else [len(words)] * (0 < len(words) < SPAN):
                if len(words) >= n:
                    got.append(short_key(h, n))
            if got:
                values = np.unique(np.concatenate(got))
                ids += [i] * len(values)
                out.append(values)
        return {key: pa.array(ids, pa.string()), "fp": pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64())}

    return texts_map(table, [key, text], work, f"{key} string, fp long")


def _joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same by a join of fingerprints. Rows are known by id and digest of the text, so repeated rows stay apart."""
    # dup keeps the joins right when rows repeat: one copy is matched, all copies get its result.
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("binary").alias("_text"))
    rows = rows.withColumn("_key", F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.sha2(F.coalesce("_text", F.lit(b"")), 256)))
    items = items.where("words is not null").withColumn("_item", F.sha2(F.concat_ws("|", F.coalesce("item", F.lit("-")), F.base64("words")), 256)).dropDuplicates(["_item"])

    def lengths_of(batch: pa.RecordBatch) -> dict:
        return {"n": pa.array([len(words_of(t)) for t in as_bytes(batch, "words")], pa.int64())}

    lengths = [r.n for r in texts_map(items, ["words"], lengths_of, "n long").where(f"n > 0 and n < {SPAN}").distinct().collect()]  # nine at most
    item_fps = stored(_fingerprints(items, "_item", "words", None), "item-fps")
    doc_fps = _fingerprints(rows.select("_key", F.col("_text").alias("words")), "_key", "words", lengths)
    pairs = doc_fps.join(item_fps, "fp").select("_key", "_item").distinct()
    texts = rows.dropDuplicates(["_key"]).select("_key", "_text")
    both = pairs.join(texts, "_key").join(items.select("_item", "item", "words"), "_item")

    hashes = WordHashes()

    def work(batch: pa.RecordBatch) -> dict:
        keys, names, starts, ends = [], [], [], []
        for key, name, doc, item in zip(batch.column("_key").to_pylist(), batch.column("item").to_pylist(), as_bytes(batch, "_text"), as_bytes(batch, "words")):
            index = Index([(name, item)])
            words, h = words_of(doc), None
            h = hashes.of(words)
            hit = np.zeros(len(words) + 2, bool)
            n, found = 0, set()
            least = min(SPAN, len(index.words[0]))
            if least == SPAN:
                at, values = winnowed(h) if len(words) >= SPAN else ([], np.empty(0, np.uint64))
                a, b = index.matches(values, index.values)
                for shift in np.unique(np.asarray(at)[a] - index.where[b, 1]).tolist() if len(a) else []:
                    for x, y in pair_spans(words, h, index.words[0], index.h[0], (shift,)):
                        hit[x + 1 : y + 1] = True
            else:
                for p in range(len(words) - least + 1):
                    if words[p : p + least] == index.words[0]:
                        hit[p + 1 : p + least + 1] = True
            edges = np.flatnonzero(hit[1:] != hit[:-1])
            keys += [key] * (len(edges) // 2)
            names += [name] * (len(edges) // 2)
            starts += edges[::2].tolist()
            ends += edges[1::2].tolist()
        return {"_key": pa.array(keys, pa.string()), "item": pa.array(names, pa.string()), "a": pa.array(starts, pa.int64()), "b": pa.array(ends, pa.int64())}

    spans = stored(texts_map(both, ["_key", "item", "_text", "words"], work, "_key string, item string, a long, b long"), "spans")
    covered = spans.selectExpr("_key", "a", "b", "max(b) over (partition by _key order by a, b rows between unbounded preceding and 1 preceding) as before")
    n_hit = covered.groupBy("_key").agg(F.sum(F.greatest(F.lit(0), F.expr("b - greatest(a, coalesce(before, 0))"))).alias("n_hit"))
    names = spans.where("item is not null").select("_key", "item").distinct().groupBy("_key").agg(F.sort_array(F.collect_list("item")).alias("ids"))

    def count(batch: pa.RecordBatch) -> dict:
        return {"_id": batch.column("_id"), "_key": batch.column("_key"), "n_words": pa.array([len(words_of(t)) for t in as_bytes(batch, "_text")], pa.int64())}

    counted = texts_map(rows, ["_id", "_key", "_text"], count, f"_id {rows.schema['_id'].dataType.simpleString()}, _key string, n_words long")
    out = counted.join(n_hit, "_key", "left").join(names, "_key", "left")
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns kept. With a broadcast index nothing is shuffled."""
    index = index_of(benchmark, "item_id", "text", broadcast_bytes)
    if index is None:
        found = stored(winnow_overlap(docs, benchmark, id_col, text_col, broadcast_bytes=broadcast_bytes), "overlaps")
        return without(docs, id_col, found.where("contaminated").select(id_col))

    def work(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            clean = []
            for text in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist():
                words = words_of(text)
                clean.append(not index.value.hits(words, hashes.of(words))[0])
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


#: DuckDB SQL of the op8 query.
OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from bi)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
m as (select doc_id, dw.n, i, item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from m)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
