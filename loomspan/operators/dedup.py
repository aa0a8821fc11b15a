"""Exact and near-duplicates of documents in order of arrival, and drift of their content.

Documents come as (doc, seq, text, lang) columns; raw bytes are the text's own unless given. Near-duplicates have
fingerprints within a Hamming distance, enough characters, similar lengths, the same known language and the same numbers.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import as_long, normalized, numeric_sequence, simhash64
from ..sources.shared import stored

HAMMING, MIN_CHARS, LENGTH_RATIO, SHINGLE, MAX_CHARS = 3, 100, 0.9, 5, 500_000


def fingerprints(docs: DataFrame, doc: str, text: str, lang: str, seq: str | None = None, shingle: int = SHINGLE, most_chars: int = MAX_CHARS) -> DataFrame:
    """doc, seq, lang, source_sha, text_sha (of the whole normal form), simhash, normal_chars, omitted_chars, numbers.

    A null text counts as empty. The normal form is made once for the digest and once for the part that is fingerprinted.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc).alias("doc"), F.col(seq or doc).alias("seq"), F.col(lang).alias("lang"), body.alias("_text"), normalized(body).alias("_normal"), simhash64(shingle, most_chars)(body).alias("simhash"))
    return base.select(
        "doc", "seq", "lang", F.sha2(F.col("_text").cast("binary"), 256).alias("source_sha"), F.sha2(F.col("_normal").cast("binary"), 256).alias("text_sha"), "simhash", F.length("_normal").alias("normal_chars"),
        F.greatest(F.lit(0), F.length("_text") - most_chars).alias("omitted_chars"), F.xxhash64(F.array_join(numeric_sequence(F.col("_normal")), " ")).alias("numbers"),
    )


def bands(fp: DataFrame, most: int = HAMMING, blocks: int | None = None) -> DataFrame:
    """A row for each key under which two fingerprints within the distance must meet: at most `most` of the blocks differ.

    blocks = most + 1 gives one key for each block; more blocks give longer, rarer keys of (blocks - most) blocks each, which
    keeps buckets small when there are many documents.
    """
    blocks = blocks or most + 1
    x = as_long(F.col("simhash"))
    cut = [64 * b // blocks for b in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(x, 64 - cut[b + 1]), 64 - (cut[b + 1] - cut[b])) for b in range(blocks)]
    keys = [F.concat_ws(":", *(part[b].cast("string") for b in c)) for c in combinations(range(blocks), blocks - most)]
    return fp.select("*", F.posexplode(F.array(*keys)).alias("band", "key"))


def near_condition(a: str, b: str, most: int = HAMMING, min_chars: int = MIN_CHARS, ratio: float = LENGTH_RATIO) -> Column:
    x, y = F.col(f"{a}.normal_chars"), F.col(f"{b}.normal_chars")
    return (
        (F.bit_count(as_long(F.col(f"{a}.simhash")).bitwiseXOR(as_long(F.col(f"{b}.simhash")))) <= most)
        & (F.least(x, y) >= min_chars) & (F.least(x, y) >= ratio * F.greatest(x, y)) & (F.col(f"{a}.lang") != "und") & (F.col(f"{a}.numbers") == F.col(f"{b}.numbers"))
    )


def text_classes(fp: DataFrame) -> DataFrame:
    """The first document of each (lang, text_sha)."""
    first = fp.groupBy("lang", "text_sha").agg(F.min(F.struct("seq", "doc", "source_sha", "simhash", "normal_chars", "numbers")).alias("f"), F.count("*").alias("members"))
    return first.select("lang", "text_sha", "f.*", "members")


def near_pairs(fp: DataFrame, most: int = HAMMING, min_chars: int = MIN_CHARS, ratio: float = LENGTH_RATIO, blocks: int = 6) -> DataFrame:
    """left, right (arrival order), hamming: near-duplicate pairs between first documents of different texts.

    Copies of a text are not expanded. Six blocks give 20 keys of 32 bits or so.
    """
    keyed = bands(text_classes(fp).where(F.col("lang") != "und").where(F.col("normal_chars") >= min_chars), most, blocks).select("doc", "seq", "lang", "simhash", "normal_chars", "numbers", "band", "key")
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.numbers") == F.col("b.numbers"))
    met = a.join(b, on & (F.struct("a.seq", "a.doc") < F.struct("b.seq", "b.doc")) & near_condition("a", "b", most, min_chars, ratio))
    return met.select(F.col("a.doc").alias("left"), F.col("b.doc").alias("right"), F.col("a.seq").alias("left_seq"), F.col("b.seq").alias("right_seq"), F.bit_count(as_long(F.col("a.simhash")).bitwiseXOR(as_long(F.col("b.simhash")))).cast("int").alias("hamming")).distinct()


def exact_duplicates(fp: DataFrame) -> DataFrame:
    """doc, first: each document and the first of the same language and normal form."""
    return fp.select("doc", F.first("doc").over(W.partitionBy("lang", "text_sha").orderBy("seq", "doc")).alias("first"))


def leaders(fp: DataFrame, most: int = HAMMING, min_chars: int = MIN_CHARS, ratio: float = LENGTH_RATIO, blocks: int = 6, capacity: int | None = None) -> DataFrame:
    """doc, representative, reason, hamming: each document against the representatives that came before it.

    A document that matches one is its duplicate, by bytes first, then by normal form, then by fingerprint (least distance,
    then first come); others become representatives. Representatives are found in rounds: a document is one as soon as all
    earlier documents that it matches are known duplicates. With a capacity, only the first so many are indexed; later ones
    match by bytes alone.
    """
    fp = stored(fp, "fingerprints")
    # Nodes are the first documents of each text and language; later ones of a text are never representatives, as they
    # match what their first matches, or the first itself. Two nodes of the same bytes differ in language.
    node = stored(text_classes(fp), "nodes")
    same = node.alias("a").join(node.alias("b"), (F.col("a.source_sha") == F.col("b.source_sha")) & (F.struct("a.seq", "a.doc") < F.struct("b.seq", "b.doc"))).select(F.col("a.doc").alias("left"), F.col("b.doc").alias("right"))
    near = stored(near_pairs(fp, most, min_chars, ratio, blocks), "near")
    edges = stored(same.union(near.select("left", "right")).distinct(), "edges")
    # state: true for representatives, false for duplicates; documents without an earlier match are representatives at once.
    open_ = edges.select(F.col("right").alias("doc")).distinct()
    state = edges.select(F.col("left").alias("doc")).distinct().join(open_, "doc", "left_anti").select("doc", F.lit(True).alias("rep"))
    state = stored(state, "state")
    left = stored(edges, "left")
    while True:
        known = left.join(state.select(F.col("doc").alias("left"), F.col("rep").alias("left_rep")), "left", "left")
        verdict = known.groupBy("right").agg(F.bool_or(F.coalesce("left_rep", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("left_rep"), F.lit(False))).alias("free"))
        new = stored(verdict.where("hit or free").select(F.col("right").alias("doc"), (~F.col("hit")).alias("rep")), "decided")
        if new.limit(1).count() == 0:
            break
        state = stored(state.union(new), "state")
        left = stored(left.join(new.select(F.col("doc").alias("right")), "right", "left_anti").select("left", "right"), "left")
    duplicate = state.where("not rep").select("doc")
    reps = stored(node.join(duplicate, "doc", "left_anti"), "representatives")
    if capacity is not None:
        place = reps.orderBy("seq", "doc").limit(capacity)
        indexed = stored(place, "indexed")
    else:
        indexed = reps
    # Each document takes its best earlier representative.
    d, by_bytes, by_text = fp.alias("d"), reps.alias("r"), indexed.alias("r")
    earlier = F.struct("r.seq", "r.doc") < F.struct("d.seq", "d.doc")
    pick = lambda rank, h: F.struct(F.lit(rank).alias("rank"), h.alias("hamming"), F.col("r.seq").alias("seq"), F.col("r.doc").alias("doc"))
    zero = F.lit(0)
    content = d.join(by_bytes, (F.col("d.source_sha") == F.col("r.source_sha")) & earlier).select(F.col("d.doc").alias("doc"), pick(0, zero).alias("m"))
    words = d.join(by_text, (F.col("d.lang") == F.col("r.lang")) & (F.col("d.text_sha") == F.col("r.text_sha")) & earlier).select(F.col("d.doc").alias("doc"), pick(1, zero).alias("m"))
    texts = text_classes(fp).select("lang", "text_sha", F.col("doc").alias("first"))
    own = fp.join(texts, ["lang", "text_sha"]).select("first", "doc", "seq")
    both = near.select(F.col("left").alias("p"), F.col("right").alias("q"), "hamming").union(near.select("right", "left", "hamming"))
    finger = both.join(own.alias("d"), F.col("p") == F.col("d.first")).join(indexed.alias("r"), F.col("q") == F.col("r.doc")).where(earlier).select(F.col("d.doc").alias("doc"), pick(2, F.col("hamming")).alias("m"))
    best = content.union(words).union(finger).groupBy("doc").agg(F.min("m").alias("m"))
    out = fp.join(best, "doc", "left")
    reason = F.when(F.col("m").isNull(), "representative").when(F.col("m.rank") == 0, "content_sha256").when(F.col("m.rank") == 1, "normalized_text").otherwise("simhash")
    return out.select("doc", F.coalesce("m.doc", "doc").alias("representative"), reason.alias("reason"), F.coalesce("m.hamming", F.lit(0)).alias("hamming"))


def occurrences(assigned: DataFrame, docs: DataFrame, doc: str, url: str, sha: Column, seq: str) -> DataFrame:
    """representative, urls (distinct, in order of arrival), copies: where the content of a representative was found."""
    placed = docs.select(F.col(doc).alias("doc"), F.col(url).alias("url"), sha.alias("sha"), F.col(seq).alias("seq")).join(assigned, "doc")
    once = placed.groupBy("representative", "url", "sha").agg(F.min("seq").alias("seq"))
    return once.groupBy("representative").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "url"))), lambda x: x["url"]).alias("_urls"), F.count("*").alias("copies")).select("representative", F.array_distinct("_urls").alias("urls"), "copies")


def content_drift(revisions: DataFrame, key: str, seq: str, source_sha: str, text_sha: str) -> DataFrame:
    """A row where a revision differs from the one before it under the same key: previous and own digest, and the reason."""
    w = W.partitionBy(key).orderBy(seq)
    prev = revisions.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(source_sha).alias("source_sha"), F.col(text_sha).alias("text_sha"), F.lag(F.struct(F.col(seq).alias("seq"), F.col(source_sha).alias("source_sha"), F.col(text_sha).alias("text_sha"))).over(w).alias("p"))
    changed = prev.where("p is not null and (p.source_sha <> source_sha or p.text_sha <> text_sha)")
    return changed.select("key", F.col("p.seq").alias("previous_seq"), "seq", F.when(F.col("p.text_sha") != F.col("text_sha"), "changed_native_text").otherwise("changed_source_bytes").alias("reason"))


def current_revisions(revisions: DataFrame, key: str, seq: str) -> DataFrame:
    """The last revision of each key, all columns."""
    best = revisions.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*revisions.columns), seq).alias("r"))
    return best.select("r.*")
