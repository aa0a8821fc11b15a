"""Language identification in two levels: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, held_out, quoted, texts_map

FEATURES = 1 << 13
ORDERS = (1, 2, 3, 4)
#: Documents of each language that the classifiers are fitted on, at most.
SAMPLE = 400
#: Codes that are in no listed family are families of their own up to this number; more are dealt over groups.
OWN = 32
#: Families of language codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es pt it ca ro gl oc rm sc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi bn mr gu pa ur ne si or as",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu se",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(code: str) -> str:
    base = re.split(r"[-_]", code.lower())[0]
    return _FAMILY.get(base, f"own:{code}")


def families(codes: list[str]) -> dict[str, str]:
    """The family of each code. Many unlisted codes are put in groups of neighbours in order, so that machines between and within groups stay few."""
    of = {c: family(c) for c in codes}
    alone = sorted(c for c in of if of[c].startswith("own:"))
    if len(alone) > OWN:
        # g groups of n codes need about g * g / 2 + n * n / (2 * g) machines, least at this g.
        groups = np.array_split(np.array(alone, object), max(OWN, math.ceil((len(alone) ** 2 / 2) ** (1 / 3))))
        of |= {c: f"group:{i}" for i, part in enumerate(groups) for c in part}
    return of


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, over the whole text in lower case."""
    b = np.frombuffer(b" ".join(text.lower().encode("utf-8", "surrogatepass").split()), np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES, np.float64)
    key = np.zeros(len(b), np.uint32)
    for n in ORDERS:
        if len(b) < n:
            break
        key = key[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(n)
        out += np.bincount((key * np.uint32(2654435761)) >> np.uint32(19), minlength=FEATURES)
    return np.sqrt(out / max(1.0, out.sum())).astype(np.float32)


def _sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(x).astype(np.uint16)
    return at, x[at]


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The rows of one machine; all rows at once would grow with the number of languages."""
    out = np.zeros((len(rows), FEATURES), np.float32)
    for row, (at, v) in zip(out, rows):
        row[at] = v
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge support vector machine, by dual coordinate descent. y: 1 or -1."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    w, a = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    q = np.array([np.square(r, dtype=np.float64).sum() for r in x]) + 0.5 / c
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + a[i] * 0.5 / c
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


class Hierarchy:
    """Families apart by one-versus-one machines, and languages within each family likewise."""

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        """x: places and values of the features of each sampled text."""
        self.languages = sorted(set(langs))
        of = families(self.languages)
        by = np.array(langs, object)
        fam = np.array([of[v] for v in langs], object)
        self.families: dict[str, list[str]] = {}
        for v in self.languages:
            self.families.setdefault(of[v], []).append(v)
        self.top = self._fit(x, fam, sorted(self.families))
        self.within = {f: self._fit(x, by, members) for f, members in self.families.items()}

    @staticmethod
    def _fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, names: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        pairs = list(combinations(range(len(names)), 2))
        rows = np.zeros((len(pairs), FEATURES + 1), np.float64)
        for row, (i, j) in zip(rows, pairs):
            at = np.flatnonzero((y == names[i]) | (y == names[j]))
            row[:] = linear_svm(_dense([x[k] for k in at]), np.where(y[at] == names[i], 1.0, -1.0))
        return names, pairs, rows

    @staticmethod
    def _vote(model, x: np.ndarray) -> tuple[str, float]:
        names, pairs, w = model
        if len(names) == 1:
            return names[0], 1.0
        p = 1 / (1 + np.exp(-3.0 * (w[:, :-1] @ x + w[:, -1])))
        total = np.zeros(len(names))
        for (i, j), v in zip(pairs, p):
            total[i] += v
            total[j] += 1 - v
        best = int(total.argmax())
        return names[best], float(total[best] / (len(names) - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text).astype(np.float64)
        name, a = self._vote(self.top, x)
        lang, b = self._vote(self.within[name], x)
        return lang, min(1.0, max(0.0, a * b))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Hierarchy:
    """Fits on up to sample documents of each language, the first by a hash of the id; never on held out rows."""
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(lang_col)).alias("_lang"), F.col(quoted(text_col)).alias("_text")).where("_lang is not null and _text is not null").where(~held_out("_id"))
    # The smallest hashes of each language by a bound on the hash: no window over all rows, no text is moved for it.
    n = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not n:
        return Hierarchy([], [])
    part = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)).cast("long")
    bounds = docs.sparkSession.createDataFrame([(v, min(1 << 30, int((sample + 6 * sample**0.5 + 10) / k * (1 << 30)))) for v, k in n.items()], "_l string, _bound long")
    near = rows.withColumn("_part", part).join(F.broadcast(bounds), (F.col("_lang") == F.col("_l")) & (F.col("_part") < F.col("_bound")))
    picked = near.withColumn("_r", F.row_number().over(W.partitionBy("_lang").orderBy("_part", "_id", F.xxhash64("_text")))).where(f"_r <= {sample}")

    # Tasks make the features; the driver gets some thousand numbers of a text, not the text.
    def work(batch: pa.RecordBatch) -> dict:
        made = [_sparse(features(t.decode("utf-8", "replace"))) for t in as_bytes(batch, "_text")]
        return {"_lang": batch.column("_lang"), "_r": batch.column("_r"), "_at": pa.array([a.tobytes() for a, _ in made], pa.binary()), "_v": pa.array([v.astype(np.float16).tobytes() for _, v in made], pa.binary())}

    got = texts_map(picked, ["_lang", "_r", "_text"], work, "_lang string, _r int, _at binary, _v binary").orderBy("_lang", "_r").toArrow()
    x = [(np.frombuffer(a, np.uint16), np.frombuffer(v, np.float16).astype(np.float32)) for a, v in zip(got.column("_at").to_pylist(), got.column("_v").to_pylist())]
    return Hierarchy(x, got.column("_lang").to_pylist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (0 to 1). Every language of rows that aren't held out is learned.

    A null text, one without a letter, and every text when no language could be learned are und with score 0. Texts are
    read whole; long ones cost no more memory than a few times their size. Repeated rows give repeated results.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, sample))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        got = [model.value.predict(None if t is None else t.decode("utf-8", "replace")) for t in as_bytes(batch, "_text")]
        return {"_id": batch.column("_id"), "_held": batch.column("_held"), "lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([x for _, x in got], pa.float64())}

    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text")).withColumn("_held", held_out("_id"))
    return texts_map(rows, ["_id", "_held", "_text"], work, f"_id {kind}, _held boolean, lang_pred string, score double").select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score")
