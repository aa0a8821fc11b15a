"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their accuracies and
correlations, and a linear classifier that learns from the posterior labels.

Voters are fixed lexicons and patterns, and lexicons that are mined by how much oftener a word stands in texts that
are labelled toxic, or that a fixed voter speaks on. The generative model is fitted on a sample of labelled and
unlabelled documents alike; labels are no voter: they give the share of toxic documents and hold the posterior of the
rows that have one, which anchors the model's two classes. Tasks turn texts into counts
and into the few features that matter; no text reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, dropped, held_out, pieces, quoted, stored, texts_map

#: Labelled documents of each class that are learned from, at most, and twice as many others.
SAMPLE = 3000
#: Features that the classifier may choose from, and that it keeps, at most.
CANDIDATES = 20_000
FEATURES = 3000
#: Mined lexicons.
FOLDS = 8
THRESHOLD = 0.3
#: Words of abuse by language, each list a voter.
LEXICONS = {
    "en": "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool jerk imbecile bastard retard pervert filth vermin parasite coward liar creep",
    "de": "idiot dummkopf trottel arschloch depp abschaum versager blöd ekelhaft mistkerl schwachkopf widerlich",
    "fr": "idiot imbécile connard crétin salaud minable débile ordure stupide abruti dégoûtant pourriture",
    "es": "idiota imbécil estúpido basura cabrón asqueroso patético gilipollas tonto escoria inútil payaso",
}
#: Patterns of abuse, each a voter.
PATTERNS = {
    "you_are": r"\byou(?:'re| are) (?:a |an |such |so )?(?:stupid|idiot|dumb|worthless|pathetic|nothing|trash|ugly|loser)",
    "shut_up": r"\bshut up\b|\bgo to hell\b|\bhalt die klappe\b|\bferme[- ]la\b|\bcállate\b",
    "hate": r"\bi hate (?:you|them|those|these)\b|\bich hasse (?:dich|euch)\b|\bje te déteste\b|\bte odio\b",
    "harm": r"\bkill (?:yourself|you)\b|\bdrop dead\b|\bnobody (?:likes|wants) you\b",
    "masked": r"\b[a-z][*#@$]{2,}[a-z]*\b",
}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
#: Cheap words without which no pattern can match.
_HINTS = ("you", "shut", "hell", "klappe", "ferme", "cállate", "hate", "hasse", "déteste", "odio", "kill", "drop dead", "**", "##", "@@", "$$", "*#", "#*", "@*", "$*")
_EDGE = ".,;:!?\"'()[]{}<>«»“”„’‘…*#@$%&|-_/\\~`+="


def key_of(feature: str) -> int:
    """A feature's hash, below 2 ** 63."""
    return xxhash.xxh3_64_intdigest(feature.encode()) >> 1


def word_keys(word: str) -> tuple[int, ...]:
    """The word without marks at its edges, and its beginnings."""
    w = word.strip(_EDGE)
    if not w or w.isdigit():
        return ()
    return (key_of(f"w:{w}"), *(key_of(f"p:{w[:n]}") for n in (4, 5, 6) if len(w) >= n))


LEXICON_KEYS = [frozenset(key_of(f"w:{w}") for w in v.split()) for v in LEXICONS.values()]
PATTERN_KEYS = {name: key_of(f"r:{name}") for name in PATTERNS}
SEEDS = frozenset().union(*LEXICON_KEYS, PATTERN_KEYS.values())


class Found(dict):
    """Keys of words that matter to a caller, remembered up to a bound."""

    def __init__(self, keep=None, most: int = 100_000):
        self.keep, self.most = keep, most

    def __missing__(self, word: str):
        if len(self) > self.most:
            self.clear()
        out = word_keys(word)
        if self.keep is not None:
            out = tuple(k for k in out if k in self.keep)
        self[word] = out
        return out


def text_keys(text: str, found: Found) -> set[int]:
    low = text.lower()
    out = set()
    for w in set(low.split()):
        if k := found[w]:
            out.update(k)
    if any(h in low for h in _HINTS):
        out.update(PATTERN_KEYS[name] for name, p in _PATTERNS.items() if p.search(low))
    return out


def _mutual(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Information of each pair of voters about one another, given the label."""
    total = np.zeros((v.shape[1],) * 2)
    for w in (post, 1 - post):
        s = w.sum() + 1e-9
        both = (v * w[:, None]).T @ v / s
        one = np.diag(both)
        for x in (0, 1):
            for y in (0, 1):
                p = both if x and y else one[:, None] - both if x else one[None, :] - both if y else 1 - one[:, None] - one[None, :] + both
                q = (one if x else 1 - one)[:, None] * (one if y else 1 - one)[None, :]
                p, q = np.maximum(p, 1e-12), np.maximum(q, 1e-12)
                total += s / len(v) * np.where(p > 1e-9, p * np.log(p / q), 0)
    np.fill_diagonal(total, 0)
    return total


def _tree(info: np.ndarray) -> np.ndarray:
    """The voter that each one leans on (-1: none), by the strongest spanning tree of the pairs that inform at all."""
    m = len(info)
    parent, best, at = np.full(m, -1), np.full(m, -1.0), np.full(m, -1)
    left = set(range(m))
    while left:
        i = max(left, key=lambda k: (best[k], -k))
        left.discard(i)
        if best[i] > 1e-4:
            parent[i] = at[i]
        for k in left:
            if info[i, k] > best[k]:
                best[k], at[k] = info[i, k], i
    return parent


def label_model(v: np.ndarray, prior: float, known: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of the label by expectation maximisation; v: 1 where a voter speaks, else 0.

    A voter speaks with a probability that depends on the label and on the one voter it leans on most: accuracies and
    pairwise correlations are parameters of one likelihood, so voters that copy each other count once. A voter never
    speaks for a clean text more readily than for a toxic one. prior is the share of toxic texts; known, where given, is
    each text's label, or -1 for none: labels are believed but for a small share of slips.
    """
    v = np.asarray(v, float)
    n, m = v.shape
    prior = min(0.9, max(0.002, prior))
    known = np.full(n, -1) if known is None else np.asarray(known)
    held = lambda post: np.where(known == 1, 0.97, np.where(known == 0, 0.01, post))
    post = held(np.where(v.any(1), 0.9, prior / 4))
    parent = np.full(m, -1)
    rate = np.zeros((2, 2, m))
    for r in range(rounds):
        if r % 10 == 0:
            parent = _tree(_mutual(v, post))
        led = np.where(parent[None, :] >= 0, v[:, parent], 0.0)
        for y, w in ((1, post), (0, 1 - post)):
            for on in (0, 1):
                mask = (led == on) * w[:, None]
                # A weak belief in advance: toxic texts make a voter speak, clean ones hardly do.
                rate[y, on] = ((mask * v).sum(0) + (0.5 if y else 0.02)) / (mask.sum(0) + (1.0 if y else 1.0))
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        rate[1] = np.maximum(rate[1], rate[0])
        chance = [np.where(led > 0, rate[y, 1], rate[y, 0]) for y in (0, 1)]
        ll = np.where(v > 0, np.log(chance[1] / chance[0]), np.log((1 - chance[1]) / (1 - chance[0]))).sum(1) + np.log(prior / (1 - prior))
        new = held(1 / (1 + np.exp(-np.clip(ll, -30, 30))))
        done = r > 25 and np.abs(new - post).max() < 1e-4
        post = new
        if done:
            break
    return post, {"fires_if_toxic": rate[1], "fires_if_clean": rate[0], "leans_on": parent}


class Rows:
    """Sets of features as a sparse matrix of ones, with a last column of ones for the bias."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.n, self.width = len(sets), width + 1
        self.row = np.repeat(np.arange(self.n), [len(s) + 1 for s in sets])
        self.at = np.concatenate([np.append(s, width) for s in sets]) if sets else np.empty(0, int)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, u[self.row], self.width)


def logistic(x: Rows, target: np.ndarray, weight: np.ndarray, l2: float = 0.02, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft targets, by accelerated gradient steps."""
    total = float(weight.sum())
    w = y = np.zeros(x.width)
    # A bound on the curvature by the power method.
    u, size = np.full(x.width, x.width**-0.5), 1.0
    for _ in range(15):
        u = x.back(weight * x.times(u))
        size = float(np.linalg.norm(u))
        u = u / max(size, 1e-12)
    step = 1 / (0.25 * size / total + l2)
    reg = np.full(x.width, l2 / 10)
    reg[-1] = 0
    t = 1.0
    for _ in range(rounds):
        g = x.back(weight * (1 / (1 + np.exp(-x.times(y))) - target)) / total + reg * y
        new = y - step * g
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - w)
        w, t = new, s
    return w


class Model:
    """Weights by key of the features that the classifier keeps, and what the label model found."""

    def __init__(self, weights: dict[int, float], bias: float, voters: dict | None = None):
        self.weights, self.bias, self.voters = weights, bias, voters or {}

    @classmethod
    def fixed(cls) -> Model:
        """Where nothing can be learned the fixed lexicons and patterns decide."""
        return cls(dict.fromkeys(sorted(SEEDS), 4.0), -3.0)

    @classmethod
    def learned(cls, sets: list[np.ndarray], keys: list[int], voters: list[set[int]], mined: np.ndarray, prior: float, known: np.ndarray, most: int = FEATURES) -> Model:
        """From the places in keys of each sampled text's features; mined: which of keys the mined lexicons hold."""
        place = {k: i for i, k in enumerate(keys)}
        fixed = np.zeros((len(voters), len(keys)), bool)
        for i, v in enumerate(voters):
            fixed[i, [place[k] for k in v if k in place]] = True
        seed, fold = fixed.any(0), np.array(keys) % FOLDS
        speaks = np.vstack([fixed, *(((fold == f) & mined & ~seed)[None, :] for f in range(FOLDS))])
        post, found = label_model(np.array([speaks[:, s].any(1) for s in sets]), prior, known)
        on = post > 0.5
        if not on.any() or on.all():
            return cls.fixed()
        pos, neg = (np.bincount(np.concatenate([s for s, o in zip(sets, on) if o == y]), minlength=len(keys)) for y in (True, False))
        a, b = pos / on.sum(), neg / (~on).sum()
        # Features that stand mostly in texts that are likely toxic, the most telling first.
        gain = np.where((pos + neg >= 3) & (a > 5 * b), (a - b) / np.sqrt(np.maximum(pos + neg, 1) / len(sets)), 0)
        kept = [i for i in sorted(range(len(keys)), key=lambda i: (-gain[i], keys[i]))[:most] if gain[i] > 0]
        at = np.full(len(keys), -1)
        at[kept] = np.arange(len(kept))
        x = Rows([p[p >= 0] for p in (at[s] for s in sets)], len(kept))
        # A wrong hit costs twice a missed one.
        w = logistic(x, post, np.where(on, 0.5 / on.sum(), 1.0 / (~on).sum()))
        return cls({keys[i]: float(w[j]) for j, i in enumerate(kept)}, float(w[-1]), found)

    def scorer(self):
        found, weights = Found(self.weights), self.weights

        def score(text: str | None) -> float:
            on = text_keys(text or "", found)
            return float(1 / (1 + np.exp(-(self.bias + sum(weights[k] for k in sorted(on) if k in weights)))))

        return score


def _text(t: bytes | None) -> str:
    return "" if t is None else t.decode("utf-8", "replace")


def _counted(sample: DataFrame) -> DataFrame:
    """_k, _g, _n: how many texts of group _g have the feature; -1 stands for any text. _g: 1 clean, 2 toxic, 0 not labelled; 3 more if a fixed voter speaks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(most=30_000)
        held: list[list[np.ndarray]] = [[] for _ in range(6)]

        def sums() -> Iterator[pa.RecordBatch]:
            for g, arrays in enumerate(held):
                if arrays:
                    k, n = np.unique(np.concatenate(arrays), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), g, np.int64)), pa.array(n.astype(np.int64))], names=["_k", "_g", "_n"])
                    arrays.clear()

        size = 0
        for batch in pieces(batches):
            for t, y in zip(as_bytes(batch, "_text"), batch.column("_y").to_pylist()):
                keys = text_keys(_text(t), found)
                g = (0 if y is None else 1 + y) + 3 * (not keys.isdisjoint(SEEDS))
                held[g].append(np.fromiter((-1, *keys), np.int64))
                size += len(keys)
                if size > 500_000:
                    yield from sums()
                    size = 0
        yield from sums()

    return sample.select("_text", "_y").mapInArrow(work, "_k long, _g long, _n long").groupBy("_k", "_g").agg(F.sum("_n").alias("_n"))


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, sample: int) -> tuple[DataFrame, float]:
    """The stored sample (_id, _text, _y; one row for each id) and the share of toxic ones among all labels that may be learned from."""
    known = labels.select(F.col(quoted(label_id)).alias("_lid"), F.col(quoted(label_col)).cast("double").alias("_v")).where("_lid is not null and _v is not null").where(~held_out("_lid"))
    known = known.groupBy("_lid").agg((F.avg("_v") >= 0.5).cast("int").alias("_y"))
    share = known.agg(F.avg("_y")).first()[0]
    order = (F.xxhash64("_lid", F.lit(5)), "_lid")
    texts = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text")).where("_id is not null and _text is not null")
    picked = texts.select(F.col("_id").alias("_lid"), F.lit(None).cast("int").alias("_y")).where(~held_out("_lid")).orderBy(*order).limit(2 * sample)
    for y in (0, 1):
        picked = picked.union(known.where(F.col("_y") == y).orderBy(*order).limit(sample))
    ids = F.broadcast(picked.groupBy("_lid").agg(F.max("_y").alias("_y")))  # 4 * sample rows at most
    rows = texts.join(ids, F.col("_id") == F.col("_lid")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    # Copies would make each of their words look telling: of texts with the same least hash of three words one stays.
    rows = rows.withColumn("_w", F.split("_text", r"\s+"))
    rows = rows.withColumn("_near", F.expr("if(size(_w) < 3, xxhash64(_text), array_min(transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)))))"))
    one = rows.groupBy("_near").agg(F.min(F.struct(F.col("_y").isNull().alias("_n"), "_id", "_y", "_text")).alias("_one")).select("_one._id", "_one._y", "_one._text")
    return stored(one, "toxicity-sample"), 0.1 if share is None else share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from up to sample labelled documents of each class and 2 * sample of any kind, the first by a hash of the id; never from held out rows.

    The driver gets up to CANDIDATES counted features, and of each sampled document the places of those it has.
    """
    drawn, share = _drawn(docs, labels, id_col, text_col, label_id, label_col, sample)
    counts = stored(_counted(drawn), "toxicity-counts")
    n = {r._g: r._n for r in counts.where("_k = -1").collect()}
    if not n:
        return Model.fixed()
    of = lambda *gs: max(1, sum(n.get(g, 0) for g in gs))
    sums = {"_pos": (2, 5), "_neg": (1, 4), "_seen": (3, 4, 5), "_rest": (0, 1, 2)}
    by = counts.where("_k >= 0").groupBy("_k").agg(*(F.sum(F.when(F.col("_g").isin(*gs), F.col("_n")).otherwise(0)).alias(c) for c, gs in sums.items()))
    lift = lambda a, b: (F.col(a) / of(*sums[a])) / ((F.col(b) + 0.3) / of(*sums[b]))
    told = by.select("_k", "_pos", "_seen", lift("_pos", "_neg").alias("_a"), lift("_seen", "_rest").alias("_b")).where("(_pos >= 3 and _a > 2) or (_seen >= 4 and _b > 4)")
    worth = F.greatest(F.col("_pos") * F.log(F.greatest("_a", F.lit(1.0))), F.col("_seen") * F.log(F.greatest("_b", F.lit(1.0))))
    top = told.orderBy(worth.desc(), "_k").limit(CANDIDATES).collect()
    keys = sorted({r._k for r in top} | SEEDS)
    mined = {r._k for r in top if (r._pos >= 4 and r._a >= 20) or (r._seen >= 8 and r._b >= 50)}
    place = {k: i for i, k in enumerate(keys)}
    held = docs.sparkSession.sparkContext.broadcast(place)

    words: list = []

    def work(batch: pa.RecordBatch) -> dict:
        if not words:
            words.append(Found(held.value))
        found = words[0]
        return {"_id": batch.column("_id"), "_y": batch.column("_y"), "_at": pa.array([sorted(held.value[k] for k in text_keys(_text(t), found) if k in held.value) for t in as_bytes(batch, "_text")], pa.list_(pa.int32()))}

    kind = drawn.schema["_id"].dataType.simpleString()
    got = texts_map(drawn, ["_id", "_y", "_text"], work, f"_id {kind}, _y int, _at array<int>").orderBy("_id").toArrow().combine_chunks()
    sets = [np.asarray(x.values, int) for x in got.column("_at")]
    known = np.array([-1 if y is None else y for y in got.column("_y").to_pylist()])
    toxic, clean = n.get(2, 0) + n.get(5, 0), n.get(1, 0) + n.get(4, 0)
    model = Model.learned(sets, keys, [*LEXICON_KEYS, *({k} for k in PATTERN_KEYS.values())], np.array([k in mined for k in keys]), (toxic + share * (len(sets) - toxic - clean)) / len(sets), known)
    held.unpersist()
    dropped(drawn)
    dropped(counts)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts get the score of a text without any feature. Labels may repeat an id (the mean decides), lack
    documents or be empty; where no document can be learned from, or all are alike, the fixed voters decide alone. Of
    rows that repeat an id one is learned from, all are scored. Other columns are not read.
    """
    return _scored(docs, fit(docs, labels, id_col, text_col, label_id, label_col, sample), id_col, text_col, threshold)


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    scorers: list = []

    def work(batch: pa.RecordBatch) -> dict:
        if not scorers:
            scorers.append(held.value.scorer())
        score = scorers[0]
        got = [score(_text(t)) for t in as_bytes(batch, "_text")]
        return {"_id": batch.column("_id"), "_held": batch.column("_held"), "score": pa.array(got, pa.float64())}

    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text")).withColumn("_held", held_out("_id"))
    out = texts_map(rows, ["_id", "_held", "_text"], work, f"_id {kind}, _held boolean, score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns kept. The score is computed beside the row, so nothing is joined.

    Null and empty texts score as texts without any feature and stay; repeated rows go or stay together; an empty table
    stays empty. No column is added, so none can clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def work(batches):
        score = held.value.scorer()
        for batch in pieces(batches):
            keep = [score(_text(t)) < threshold for t in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
