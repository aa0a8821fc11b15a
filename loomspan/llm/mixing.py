"""Mixing sources to target weights by the cube method: balanced sampling of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, dropped, runs, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of one flight. A source of more rows is dealt over several flights by the hash of the id.
FLIGHT = 4096
_EPS = 1e-9
#: The flight of a row: a chunk of its source.
_GROUP = "xxhash64(source, pmod(xxhash64(_id, size, _copy, 2), _chunks), 3)"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rows, source_size, target of each source, by water-filling in closed form.

    One row for each source is all that the windows see, however many documents there are.

    Sorted by the level most * size / weight at which a source is full, the common level c is right at the first
    source that it doesn't fill. Works on one row per source.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    ranked = by.selectExpr("*", f"element_at(array({', '.join(f'{float(w)}D' for w in weights)}), cast((row_number() over (order by source is null, source) - 1) % {len(weights)} + 1 as int)) as w", f"{most}D * source_size as cap")
    level = ranked.selectExpr(
        "*", "cap / w as full", f"{share}D * sum(source_size) over () as total",
        "coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0D) as before",
        "sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as rest",
    )
    c = level.selectExpr("*", "min(case when (total - before) / rest <= full then struct(full, (total - before) / rest as c) end) over () as first")
    return c.selectExpr("source", "rows", "source_size", "case when first is null then cap else least(cap, w * first.c) end as target")


def flight(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Moves fractions through the null space of the two totals until at most two stay between 0 and 1."""
    p = p.astype(float).tolist()
    size = (size / max(1.0, float(size.max(initial=1)))).tolist()
    rng = np.random.default_rng(seed)
    draw = rng.random(2 * len(p) + 4).tolist()
    open_ = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            open_.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(open_) == 3:
            a, b, c = open_
            # A vector u with u.size = 0 and u.1 = 0.
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if max(map(abs, u)) < 1e-15:
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u) if x)
            step = up if draw[i % len(draw)] * (up + down) < down else -down
            for k, x in zip(open_, u):
                p[k] += step * x
            stays = []
            for k in open_:
                if p[k] <= _EPS or p[k] >= 1 - _EPS:
                    p[k] = float(round(p[k]))
                else:
                    stays.append(k)
            open_ = stays
    return np.array(p)


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the few fractions that are left to the nearest token total, then document total."""
    p = p.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    want, count = float((size[left] * p[left]).sum()), float(p[left].sum())
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda x: (abs(float((size[left] * x).sum()) - want), abs(sum(x) - count), x))
    p[left] = best
    return p


def _fly(rows: DataFrame, last: bool) -> DataFrame:
    """One flight for each (source, chunk); the last lands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "_group"):
            size = np.array(t.column("size").to_pylist(), float)
            p = t.column("_p").to_numpy()
            order = np.array(sorted(range(len(p)), key=list(zip(t.column("_order").to_pylist(), t.column("_tie").to_pylist(), size.tolist())).__getitem__), int)
            got = np.empty(len(p))
            flown = flight(size[order], p[order], int(t.column("_group")[0].as_py()) & 0x7FFFFFFF)
            got[order] = landing(size[order], flown) if last else flown
            out = t.set_column(t.schema.get_field_index("_p"), "_p", pa.array(got))
            yield from out.combine_chunks().to_batches()

    return rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(work, rows.schema)


def cube_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Each document of a source is expected target / source_size times: the whole part is taken as it is, the fraction
    is settled by the cube method, balanced on words and documents. Null texts have size 0 and take nothing. Null is a
    source of its own, last in order. Repeated rows are units of their own. Chunks, order and seeds come from hashes of
    the ids, so reruns agree; a source of any size is dealt over many chunks, whose few open units meet in later rounds.
    """
    sized = stored(docs.select(F.col(_q(id_col)).alias("_id"), F.col(_q(source_col)).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(_q(text_col)), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = stored(source_targets(sized, weights, share, most), "targets")
    t = targets.withColumnRenamed("source", "_source")
    # Equal rows are told apart by a number, so that rows without an id, or with one that repeats, don't meet in one flight.
    each = sized.groupBy("_id", "source", "size").agg(F.count("*").alias("_copies")).select("_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    rows = each.join(t, each["source"].eqNullSafe(t["_source"])).drop("_source")
    rows = rows.selectExpr(
        "*", "case when source_size > 0 then target / source_size else 0D end as _pi", f"cast(ceil(rows / {FLIGHT}) as long) as _chunks", "xxhash64(_id, 1) as _order", "coalesce(cast(_id as string), '') as _tie",
    ).selectExpr("*", "_pi - floor(_pi) as _p", f"{_GROUP} as _group")
    most_chunks = targets.agg(F.max(F.ceil(F.col("rows") / FLIGHT))).first()[0] or 1
    done = None
    while True:
        last = most_chunks <= 1
        flown = _fly(rows, last)
        if last:
            done = flown if done is None else done.union(flown)
            break
        flown = stored(flown, "flown")
        settled = f"_p <= {_EPS} or _p >= {1 - _EPS}"
        done = flown.where(settled) if done is None else done.union(flown.where(settled))
        # Two units at most stay open in each chunk, so every round has a small part of the chunks of the one before.
        most_chunks = -(-2 * most_chunks // FLIGHT)
        rows = flown.where(f"not ({settled})").withColumn("_chunks", F.ceil(F.col("_chunks") * 2 / FLIGHT)).withColumn("_group", F.expr(_GROUP))
    return done.selectExpr(f"_id as {_q(id_col)}", "size", "source_size", "target", "cast((floor(_pi) + round(_p)) * size as long) as taken", "source as mix_source", "cast(floor(_pi) + round(_p) as long) as copies")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
