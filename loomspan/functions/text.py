"""Column functions on text: normal form, tokens, fingerprints, scores and digests."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts written without blanks between words; their words are cut into characters and pairs of characters.
_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "LAO", "KHMER", "MYANMAR")
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """Compatibility form, case folded, blanks collapsed. Null stays null."""
    return text.map(lambda t: None if t is None else normal(t))


def text_digest(text: Column) -> Column:
    """SHA-256 of the normal form, lower-case hex."""
    return F.sha2(normalized(text).cast("binary"), 256)


def _unspaced(c: str) -> bool:
    return ord(c) > 0x0E00 and unicodedata.name(c, "").startswith(_UNSPACED)


def tokens_of(text: str) -> list[str]:
    out = []
    for w in _WORD.findall(unicodedata.normalize("NFKC", text).casefold()):
        if w.isascii() or not any(map(_unspaced, w)):
            out.append(w)
        else:
            out += list(w) + [w[i : i + 2] for i in range(len(w) - 1)]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def native_tokens(text: pd.Series) -> pd.Series:
    """Words of the folded text; words of scripts without blanks become characters and character pairs."""
    return text.map(lambda t: [] if t is None else tokens_of(t))


def simhash_of(text: str, k: int = 5, known: dict | None = None) -> int:
    """64 votes of the character shingles of a normal form, counted with repeats; a bit is set by more votes for than against."""
    known = _Digests() if known is None else known
    counts = Counter([text[i : i + k] for i in range(max(1, len(text) - k + 1))])
    bits = np.unpackbits(np.frombuffer(b"".join(map(known.__getitem__, counts)), np.uint8).reshape(-1, 8), axis=1)
    weight = np.fromiter(counts.values(), np.float64, len(counts))
    votes = 2 * (weight @ bits.astype(np.float64)) - weight.sum()
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


class _Digests(dict):
    """The first eight bytes of SHA-256 of shingles, remembered up to a bound."""

    def __missing__(self, shingle: str) -> bytes:
        if len(self) > 500_000:
            self.clear()
        self[shingle] = out = hashlib.sha256(shingle.encode("utf-8", "surrogatepass")).digest()[:8]
        return out


def simhash64(shingle: int = 5, most_chars: int = 500_000):
    """Column function: the fingerprint as 16 hex digits, of the normal form of the first most_chars characters."""

    @F.pandas_udf(T.StringType())
    def f(text: pd.Series) -> pd.Series:
        known = _Digests()
        return text.map(lambda t: None if t is None else f"{simhash_of(normal(t[:most_chars]), shingle, known):016x}")

    return f


def as_long(hexed: Column) -> Column:
    """16 hex digits as a signed long of the same bits."""
    return F.conv(hexed, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def numeric_sequence(normal_text: Column) -> Column:
    """All numbers of a normal form in order, marks between digits kept."""
    return F.regexp_extract_all(normal_text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*"), F.lit(0))


def truncated_query(text: Column, limit: int) -> Column:
    """text cut to the limit at its last blank inside, unless the cut falls on one; a longer word is cut hard."""
    head = F.substring(text, 1, limit)
    after = F.substring(text, limit + 1, 1)
    word = F.regexp_extract(head, r"(?s)^(.*)[ \t\n]", 1)
    cut = F.when(after.isin(" ", "\t", "\n") | (F.length(word) == 0), head).otherwise(word)
    return F.when(F.length(text) <= limit, text).otherwise(F.rtrim(cut))


def folded(text: Column) -> Column:
    """Lower case, with the letters that fold to others: sharp s to ss, final sigma to sigma, long s to s."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def keyword_score(goal: Column, url: Column, anchor: Column) -> Column:
    """1.0 if a word of the goal occurs in the url or the anchor, cases folded; else 0.0."""
    hay = folded(F.concat_ws(" ", url, anchor))
    words = F.filter(F.split(folded(F.trim(goal)), r"\s+"), lambda t: t != "")
    return F.when(F.exists(words, lambda t: F.contains(hay, t)), 1.0).otherwise(0.0)


def frontier_score(keyword: Column, cosine: Column, weight: float) -> Column:
    return F.lit(weight) * keyword + F.lit(1.0 - weight) * F.greatest(F.lit(0.0), cosine)


def scoring_anchor(url: Column, title: Column, snippet: Column) -> Column:
    """The title, unless it is empty or only the host; then title, words of the path, and snippet."""
    host = F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))), r"^www\.", "")
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"^www\.", "")
    rest = F.coalesce(F.try_url_decode(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)), F.lit(""))
    words = F.filter(F.split(rest, r"[/_.+\-%=?&]"), lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~F.lower(w).isin("html", "htm", "php", "aspx"))
    long = F.array_join(F.filter(F.array(F.trim(F.coalesce(title, F.lit(""))), F.array_join(words, " "), F.trim(F.coalesce(snippet, F.lit("")))), lambda p: p != ""), " ")
    return F.when((bare == "") | (bare == host), long).otherwise(F.trim(title))


def link_input(url: Column, anchor: Column, bound: int) -> Column:
    """struct<text, cut>: url and anchor within the bound. First query and fragment go, then the anchor is cut, then the url."""
    whole = F.concat(url, F.lit("\n"), anchor)
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    head = F.substring(bare, F.lit(1), F.greatest(F.lit(1), F.least(F.length(bare), F.lit(bound - 1))))
    room = F.greatest(F.lit(0), F.lit(bound - 1) - F.length(head))
    text = F.when(F.length(whole) <= bound, whole).otherwise(F.concat(head, F.lit("\n"), F.substring(anchor, F.lit(1), room)))
    return F.struct(text.alias("text"), (F.length(whole) - F.length(text)).alias("cut"))


def unit_vector(v: Column) -> Column:
    """v scaled by its largest size and then to length 1; null for zero, empty or non-finite vectors."""
    big = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    scaled = F.transform(v, lambda x: x.cast("double") / big)
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x))
    ok = (F.size(v) > 0) & (big > 0) & (big < float("inf")) & ~F.isnan(big)
    return F.when(ok, F.transform(scaled, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, clamped to -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def prefixed_digest(role: str, *parts: Column) -> Column:
    """role: and the SHA-256 of the parts, each after its length in bytes, so no two lists of parts look the same."""
    named = F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))
    return F.concat(F.lit(f"{role}:"), F.sha2(named.cast("binary"), 256))


def pair_id(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b)).cast("binary"), 256)


def json_digest(value: Column) -> Column:
    """SHA-256 of a struct as JSON, in the order of its fields, nulls kept."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}).cast("binary"), 256)


def occurrence(text: Column, surface: Column, k: Column) -> Column:
    """0-based start of the k-th (from 0) occurrence of surface in text, overlaps not counted; null if there is none."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), surface, F.lit(r"\E")), -1)
    ok = (F.length(surface) > 0) & (k >= 0) & (F.size(parts) > k + 1)
    return F.when(ok, F.aggregate(F.slice(parts, F.lit(1), F.greatest(k + 1, F.lit(1))), F.lit(0), lambda a, p: a + F.length(p)) + k * F.length(surface))


def charset(content_type: Column) -> Column:
    """The charset that a content type names, lower case; utf-8 if none."""
    got = F.lower(F.regexp_extract(content_type, r"""(?i)charset\s*=\s*["']?([^\s;"']+)""", 1))
    return F.when(got != "", got).otherwise("utf-8")


def date_bounds(start: Column, end: Column) -> Column:
    """struct<low, high, unknown>: a missing bound is open; text that is no date in full is null in both."""
    low, high = F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd")
    ok = (start.isNull() | (F.date_format(low, "yyyy-MM-dd") == start)) & (end.isNull() | (F.date_format(high, "yyyy-MM-dd") == end))
    lo, hi = F.coalesce(low, F.lit("0001-01-01").cast("date")), F.coalesce(high, F.lit("9999-12-31").cast("date"))
    return F.struct(F.when(ok & (lo <= hi), lo).alias("low"), F.when(ok & (lo <= hi), hi).alias("high"), (start.isNull() | end.isNull()).alias("unknown"))


def valid_at(start: Column, end: Column, as_of: Column) -> Column:
    """Without a date only what has no dates; at a date what includes it, open where a bound is missing."""
    undated = start.isNull() & end.isNull()
    inside = (start.isNull() | (start <= as_of)) & (end.isNull() | (as_of <= end))
    return F.when(as_of.isNull(), undated).otherwise(inside)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait by a header: digits, or a date with a zone; never negative; null if it is neither."""
    seconds = F.when(value.rlike("^[0-9]{1,9}$"), value.cast("double"))
    at = F.try_to_timestamp(F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.coalesce(seconds, F.when(at.isNotNull(), F.greatest(F.lit(0.0), at.cast("double") - now.cast("double"))))


def retry_schedule(first: float = 1.0, longest: float = 30.0, total: float = 180.0) -> list[float]:
    """Waits that double from first to longest while their sum stays within total."""
    out, wait = [], first
    while sum(out) + wait <= total:
        out.append(wait)
        wait = min(longest, 2 * wait)
    return out


def safe_run_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")
