"""Near-duplicates by SetSketch: registers of exponentially spaced truncated minima are banded, judged jointly by
likelihood, and links are confirmed on full shingle sets.

Steps: (1) sketch every text; (2) texts with the same set are one class; (3) classes that share a band are linked to the
least of them, and the components of those links hold every possible link; (4) inside each component, cut into
blocks of bounded size, pairs that the registers don't rule out are confirmed exactly until all links are settled;
only a spanning forest of confirmed links leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, as_bytes, in_slices, mix, quoted, runs, shingle_set, stored, texts_map, without
from .graph import connected_components

REGISTERS = 252
#: Base of the register scale, and the rate at which a register's minimum is truncated to 0.
BASE = 1.2
RATE = 20.0
#: Chance that a link at the threshold shares no band.
MISS = 1e-5
#: Twice the log-likelihood by which a pair must speak against the threshold to be left unread: over six sigma.
REJECT = 36.0
#: Shingles, and texts, of one block; a pair of blocks is held in memory at once.
BLOCK_SHINGLES = 3_000_000
BLOCK_ROWS = 3000
_DOUBLE = 1.0 / (1 << 53)


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of registers for each set; an empty set has zeros.

    Each element sends arrivals of a Poisson process to registers drawn from its hash; a register keeps the first
    arrival. Arrivals later than a bound that nearly always fills all registers need not be made, so a set costs about
    m log m draws, however large it is. Registers of a union are the larger of both, element by element.
    """
    x = np.full((len(sets), m), np.inf)
    todo = [i for i, s in enumerate(sets) if len(s)]
    spread = 3.0
    while todo:
        n = np.array([len(sets[i]) for i in todo])
        x[todo] = np.inf
        e = np.concatenate([sets[i] for i in todo])
        doc = np.repeat(np.array(todo), n)
        until = np.repeat((math.log(m) + spread) / n, n)
        at = np.zeros(len(e))
        step = 0
        while len(e):
            step += 1
            u = mix(e + np.uint64(0x9E3779B97F4A7C15 * step & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * _DOUBLE) / m
            on = at < until
            e, doc, until, at, u = e[on], doc[on], until[on], at[on], u[on]
            np.minimum.at(x.reshape(-1), doc * m + (mix(u ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64), at)
        todo = [i for i in todo if np.isinf(x[i]).any()]
        spread *= 3
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(x / RATE) / math.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0.0), 0, 255).astype(np.uint8)


def _p(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(j, more, less, same, nu, nv):
    """Of similarity j, given how many registers of u are larger, smaller and the same, and both set sizes."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    a, b = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
    return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def could_link(more, less, same, nu, nv, threshold: float):
    """False where the registers' likelihood rules out a similarity of the threshold or more; and the likeliest one."""
    best, most = np.full(len(same), -np.inf), np.zeros(len(same))
    limit = np.minimum(nu, nv) / np.maximum(nu, nv)
    for j in np.linspace(0.0, 1.0, 41):
        ll = np.where(j <= limit, log_likelihood(np.minimum(j, limit), more, less, same, nu, nv), -np.inf)
        most = np.where(ll > best, j, most)
        best = np.maximum(best, ll)
    at = log_likelihood(np.minimum(threshold, limit), more, less, same, nu, nv)
    return (most >= threshold) | (2 * (best - at) <= REJECT), most


def band_rows(threshold: float, m: int = REGISTERS, miss: float = MISS) -> int:
    """Registers of a band: as many as leave a miss at the threshold rarer than asked."""
    return max(r for r in range(1, 20) if r == 1 or (1 - threshold**r) ** (m // r) <= miss)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], regs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between members of left and right (both: indices; may be the same)."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []

    def settle(pairs) -> None:
        for x, y in pairs:
            a, b = root(x), root(y)
            if a != b and linked(sets[x], sets[y], percent):
                parent[b] = a
                out.append((x, y))

    size = np.array([len(s) for s in sets])
    threshold = percent / 100
    if len(left) * len(right) <= 64:
        settle((x, y) for x in left.tolist() for y in right.tolist() if x != y and 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]))
        return out
    right = right[np.argsort(size[right], kind="stable")]
    rs = size[right]
    later = []
    # The least number of equal registers that is not beyond six sigma under the threshold.
    p0 = 1 - 2 * float(_p((1 - threshold) / 2))
    least = math.floor(regs.shape[1] * p0 - 6.5 * math.sqrt(regs.shape[1] * p0 * (1 - p0)))
    for x in left.tolist():
        lo, hi = np.searchsorted(rs, math.floor(size[x] * threshold)), np.searchsorted(rs, math.ceil(size[x] / threshold), "right")
        near = right[lo:hi]
        if not len(near):
            continue
        same = (regs[near] == regs[x]).sum(1)
        keep = (near != x) & ((same >= least) | (size[near] * 10 < size[x] * 9) | (size[x] * 10 < size[near] * 9))
        near, same = near[keep], same[keep]
        if not len(near):
            continue
        more = (regs[near] < regs[x]).sum(1)
        ok, most = could_link(more, regs.shape[1] - same - more, same, float(size[x]), size[near].astype(float), threshold)
        near, most = near[ok], most[ok]
        order = np.argsort(-most, kind="stable")
        sure = most[order] >= (1 + threshold) / 2
        settle((x, y) for y in near[order][sure].tolist())
        later += [(x, y) for y in near[order][~sure].tolist() if root(x) != root(y)]
        if len(later) > 200_000:
            settle(later)
            later = []
    settle(later)
    return out


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_id, n_shingles, _set (digest of the set; null if empty), _regs of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    hashes = WordHashes()

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch, text_col)
        n, digests, regs = [], [], []
        for lo, hi in in_slices(texts):
            sets = [shingle_set(hashes.of(word_list(t)), words) for t in texts[lo:hi]]
            n += [len(s) for s in sets]
            digests += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            regs += [r.tobytes() for r in sketches(sets)]
        return {"_id": batch.column(id_col), "n_shingles": pa.array(n, pa.int64()), "_set": pa.array(digests, pa.binary()), "_regs": pa.array(regs, pa.binary())}

    return texts_map(docs, [id_col, text_col], work, f"_id {kind}, n_shingles long, _set binary, _regs binary")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable over links), kept (is it the id itself).

    Texts with fewer words than a shingle are one shingle; null and empty ones have no set, are linked with nothing and
    kept. Rows that repeat an id with the same text share its component; rows without an id have no component and are
    kept. Ids compare as their type does. Other columns of docs are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = stored(sketch_documents(docs, id_col, text_col, words), "sketches")
    known = sketched.where("_id is not null and _set is not null")
    classes = stored(known.groupBy("_set").agg(F.min("_id").alias("_rep"), F.first("_regs").alias("_regs"), F.first("n_shingles").alias("_n")).select("_rep", "_set", "_regs", "_n"), "classes")

    r = band_rows(percent / 100)
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("_regs", 1 + i * r, r)) for i in range(REGISTERS // r)))
    banded = classes.select("_rep", F.explode(bands).alias("_band"))
    # A class whose sets differ can have the same least id only where an id repeats; it is linked by the id itself.
    buckets = banded.groupBy("_band").agg(F.min("_rep").alias("_least"), F.max("_rep").alias("_most")).where("_least <> _most").select("_band", "_least")
    edges = banded.join(buckets, "_band").where("_rep <> _least").select("_rep", "_least").distinct()
    groups = stored(connected_components(edges, "_rep", "_least"), "groups")
    sizes = groups.join(classes, groups["node"] == classes["_rep"]).groupBy("component").agg(F.count("*").alias("_count"), F.sum("_n").alias("_total"))
    cut = sizes.selectExpr("component", f"cast(greatest(ceil(_count / {block_rows}), ceil(_total / {block_shingles})) as int) as _blocks")
    members = groups.join(cut, "component").join(classes, F.col("node") == F.col("_rep")).selectExpr("component", "node", "_regs", "_blocks", "cast(pmod(xxhash64(node, 7), _blocks) as int) as _b")
    # A component of several blocks is met by each pair of its blocks; a block goes to as many tasks as there are blocks.
    dealt = members.selectExpr("component", "node", "_regs", "_b", "explode(sequence(0, _blocks - 1)) as _o").selectExpr("xxhash64(component, least(_b, _o), greatest(_b, _o)) as _task", "component", "node", "_regs", "_b", "_o")
    texts = docs.select(F.col(quoted(id_col)).alias("_tid"), F.col(quoted(text_col)).alias("_text"))
    if docs.columns.count(id_col) == 1:
        texts = texts.where("_tid is not null and _text is not null")
    full = dealt.join(texts, dealt["node"] == texts["_tid"]).select("_task", "component", "node", "_regs", "_b", "_o", "_text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        a, b = [], []
        for t in runs(batches, "_task"):
            ids, comp = t.column("node").to_pylist(), t.column("component").to_pylist()
            block, other = t.column("_b").to_numpy(), t.column("_o").to_numpy()
            sets = [shingle_set(hashes.of(word_list(x)), words) for x in t.column("_text").cast(pa.binary()).to_pylist()]
            regs = np.stack([np.frombuffer(x, np.uint8) for x in t.column("_regs").to_pylist()])
            for c in set(comp):  # more than one only if two hashes met
                at = np.array([i for i, x in enumerate(comp) if x == c])
                lo = np.minimum(block[at], other[at])
                left = at[block[at] == lo]
                right = at[block[at] != lo] if (block[at] != other[at]).any() else left
                for x, y in forest(sets, regs, left, right, percent):
                    a.append(ids[x])
                    b.append(ids[y])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], names=["_a", "_b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], names=["_a", "_b"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(groups.schema["node"].dataType)
    links = stored(full.repartition("_task").sortWithinPartitions("_task").mapInArrow(confirm, f"_a {kind}, _b {kind}"), "links")
    # A set that another row of the same id also has joins its class by the id.
    own = stored(known.select("_id", "_set").distinct(), "own").join(classes.select("_set", "_rep"), "_set")
    split = own.where("_id <> _rep").select(F.col("_id").alias("_a"), F.col("_rep").alias("_b"))
    multi = own.groupBy("_id").agg(F.countDistinct("_set").alias("_k")).where("_k > 1").select("_id")
    extra = split.join(multi, split["_a"] == multi["_id"], "left_semi")
    comps = connected_components(links.union(extra), "_a", "_b")
    component = own.groupBy("_id").agg(F.min("_rep").alias("_rep")).join(comps, F.col("_rep") == F.col("node"), "left").select(F.col("_id").alias("_key"), F.coalesce("component", "_rep").alias("component_id"))
    out = sketched.join(component, sketched["_id"] == component["_key"], "left")
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "_id") == F.col("_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a near-duplicate of a smaller id; all columns kept.

    Null and empty texts, and rows without an id, stay. Rows that repeat an id and its text stay or go together. An empty
    table stays empty. No column is added, so none can clash.
    """
    found = stored(near_duplicates(docs, percent, words, id_col, text_col), "near-duplicates")
    return without(docs, id_col, found.where("not kept").select(id_col))


#: DuckDB SQL of the op4 query.
OP4_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as materialized (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as materialized (select x, y from p join n u on u.doc_id = x join n v on v.doc_id = y where 100 * c >= 85 * (u.n + v.n - c)),
ways as materialized (select x, y from e union all select y, x from e),
r as (select x as node, x as seen from ways union select r.node, ways.y from r join ways on r.seen = ways.x),
c as (select node, min(seen) as m from r group by node)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.m, doc_id)::bigint as component_id, coalesce(c.m, doc_id) = doc_id as kept
from documents left join n using (doc_id) left join c on c.node = doc_id
"""
