"""Runs of characters that occur in a given set of strings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that are broadcast at most; more are joined.
BROADCAST = 200_000


def char_grams(docs: DataFrame, doc: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """doc, _gram, _g for the distinct runs of n characters of each text that are among wanted._s (with _g, its hash).

    Up to BROADCAST strings are held by every task and texts are searched in place; more are met by a join of all runs.
    """
    strings = [r[0] for r in wanted.select("_s").distinct().limit(BROADCAST + 1).collect()]
    kind = docs.schema[doc].dataType.simpleString()
    if len(strings) <= BROADCAST:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(strings))

        def search(batches):
            for batch in batches:
                ids, out = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got = held.value.intersection({t[j : j + n] for j in range(len(t) - n + 1)}) if held.value else ()
                    ids += [i] * len(got)
                    out += got
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.string())], names=[doc, "_gram"])

        return docs.select(doc, text).mapInArrow(search, f"{doc} {kind}, _gram string").withColumn("_g", F.xxhash64("_gram"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    return docs.where(F.length(text) >= n).select(doc, F.explode(runs).alias("_gram")).withColumn("_g", F.xxhash64("_gram"))
