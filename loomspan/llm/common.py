"""Shared pieces: shared-folder tables, word hashing and grouping of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from ..sources.shared import dropped  # noqa: F401  beside stored

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)
#: Words of a text as a regular expression that Spark and DuckDB both read.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a filter on ids, 512 KiB at any size of the data.
FILTER_BITS = 1 << 22

_CACHE_WORDS = 150_000
#: Rows that a Python worker turns into objects at once; an Arrow batch may hold many more.
_PIECE = 512
_GOLDEN = 0x9E3779B97F4A7C15


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage and survives the loss of executors."""
    # Lets Spark's cleaner remove the shuffle files of queries that have ended; else they stay until the driver is full.
    df.sparkSession._jvm.System.gc()
    return shared.stored(df, name)


def longs(values: list[int]) -> str:
    """An array of a bounded number of values, folded to a constant when the query is planned."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def maybe_among(ids: DataFrame, bits: int, *columns: str) -> Callable[..., Column]:
    """A condition on as many columns: it holds for every row whose values are among those of ids, by a bit for each hash.

    bits / 8 bytes at any size of the data. They reach the executors as the value of a scalar subquery, so no plan's
    text holds them.
    """
    at = lambda cols: F.pmod(F.xxhash64(*(F.col(c) if isinstance(c, str) else c for c in cols)), F.lit(bits))
    rows = ids.select(at(columns).alias("_h")).groupBy(F.expr("_h div 64").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_h % 64 as int)))").alias("_b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("_w").to_numpy()] = rows.column("_b").to_numpy()
    held = ids.sparkSession.createDataFrame([(words.tolist(),)], "b array<bigint>").scalar()
    return lambda *cols: F.getbit(F.get(held, (at(cols) / 64).cast("int")), (at(cols) % 64).cast("int")) == 1


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever marks it has."""
    return "`" + name.replace("`", "``") + "`"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out = mix(out + words[i : i + n] + np.uint64(_GOLDEN * i & 0xFFFFFFFFFFFFFFFF))
    return mix(out) if k == 1 else out


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(grams(words, min(k, len(words))))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that the objects made of a batch stay few whatever its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, _PIECE):
            yield batch.slice(at, _PIECE)


def texts_map(df: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """mapInArrow over the named columns. work(batch) returns a dict of columns, in the order of the schema."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = work(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (got[n] for n in names)], names=names)

    return df.select(*(F.col(quoted(c)) for c in columns)).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def in_slices(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about most bytes each, so that scratch arrays stay small."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def flat(lists: list[list]) -> list:
    return list(chain.from_iterable(lists))


def without(docs: DataFrame, id_col: str, gone: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """docs without the rows whose id is in the one column of gone; only rows that may go are shuffled. Rows without an id stay."""
    gone = gone.toDF("_gone").where("_gone is not null").distinct()
    maybe = F.coalesce(maybe_among(gone, bits, "_gone")(quoted(id_col)), F.lit(False))
    return docs.where(~maybe).union(docs.where(maybe).join(gone, docs[quoted(id_col)] == gone["_gone"], "left_anti"))
