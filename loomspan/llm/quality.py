"""Quality rules: zstandard compression bands over whole texts and fixed chunks, beside a few word and line rules."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import as_bytes, quoted, texts_map

#: (least bytes, lowest ratio, highest ratio) of compressed to plain bytes. Below the first length no ratio is judged:
#: the frame's own bytes outweigh the text. Short texts compress less, so both limits fall with the length. The lowest
#: ratios lie two hundredths under those of labelled good texts; marks after every word, lists and repeats go below.
BANDS = ((256, 0.50, 0.95), (512, 0.485, 0.84), (1024, 0.455, 0.76), (2048, 0.437, 0.72), (4096, 0.415, 0.71), (8192, 0.388, 0.70), (65536, 0.32, 0.70))
CHUNK = 4096
LEVEL = 3
#: A text is rejected when chunks that are out of band hold more than this share of its chunked bytes.
BAD_SHARE = 0.4
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_SPACE = bytes(range(9, 14)) + b" "


def band(n: int, bands=BANDS) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, a, b in bands:
        if n >= least:
            low, high = a, b
    return low, high


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = dict(zip(dict.fromkeys(words), range(n)))
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pairs = w[:-1] * len(ids) + w[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, at, count = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = count[at] > 1
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : n - 2 + i] |= hit
    return int(cover.sum())


def measures(text: bytes | None, compress, bands=BANDS, chunk=CHUNK) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, chunks, bad_chunks, method's verdict."""
    text = text or b""
    words = text.split()
    blank = len(text) - len(text.translate(None, _SPACE))
    trailing = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    lines = Counter(x for x in text.split(b"\n") if x.strip(_SPACE)) if b"\n" in text else {}
    ratio = len(compress(text)) / len(text) if text else None
    low, high = band(len(text), bands)
    good = ratio is None or low <= ratio <= high
    n = bad = bad_bytes = 0
    if len(text) > chunk:
        for i in range(0, len(text), chunk):
            part = text[i : i + chunk]
            if len(part) >= bands[0][0]:
                a, b = band(len(part), bands)
                n += 1
                if not a <= len(compress(part)) / len(part) <= b:
                    bad += 1
                    bad_bytes += len(part)
        good = good and bad_bytes <= BAD_SHARE * len(text)
    return len(words), len(text) - blank - trailing, len(text) - len(text.translate(None, SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words), ratio, n, bad, good


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: the id, base measures, ratios, and kept.

    A null text counts as empty; both fail the base rule (under 50 words) and have a null ratio. Repeated rows give
    repeated results. Other columns of docs are not read, so their names can't clash. No shuffle; each text is
    measured whole, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    made: list = []

    def work(batch: pa.RecordBatch) -> dict:
        made or made.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress)
        rows = [measures(t, made[0], bands, chunk) for t in as_bytes(batch, text_col)]
        n, chars, symbols, dup, rep, ratio, chunks, bad, good = map(list, zip(*rows))
        failed = [a < MIN_WORDS or 100 * r > REPEAT_PERCENT * a for a, r in zip(n, rep)]
        long = pa.int64()
        return {
            id_col: batch.column(id_col), "n_words": pa.array(n, long), "word_chars": pa.array(chars, long), "n_symbols": pa.array(symbols, long), "n_dup_lines": pa.array(dup, long),
            "n_repeat_words": pa.array(rep, long), "base_failed": pa.array(failed, pa.bool_()), "kept": pa.array([g and not f for g, f in zip(good, failed)], pa.bool_()),
            "ratio": pa.array(ratio, pa.float64()), "n_chunks": pa.array(chunks, long), "n_bad_chunks": pa.array(bad, long),
        }

    return texts_map(docs, [id_col, text_col], work, f"{quoted(id_col)} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")
