"""Reading of html pages: title, author, date, text, links, images, each with what was left out. One Arrow pass over the pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import joined

#: Defaults: elements whose text is no part of a page's body, and where the body is looked for, in order.
DROPPED = ("script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe")
BODIES = ("article", "main", "body")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


class _Page(HTMLParser):
    """Events of one page. Text is kept for every open body candidate, so the page is read once."""

    def __init__(self, dropped, bodies):
        super().__init__(convert_charrefs=True)
        self.dropped, self.bodies = frozenset(dropped), tuple(bodies)
        self.open: list[str] = []
        self.skip = 0
        self.meta: dict[str, str] = {}
        self.canonical = self.time = self.lang = None
        self.seen: set[str] = set()
        self.titles: dict[str, list[str]] = {}
        self.text: dict[str, list[str]] = {}
        self.links: dict[str, list[list]] = {}
        self.images: list[dict] = []
        self.anchor: list | None = None

    def _places(self):
        return [b for b in self.bodies if b in self.open]

    def _add(self, piece: str) -> None:
        for b in self._places():
            self.text.setdefault(b, []).append(piece)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = self.lang or a.get("lang")
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and "content" in a:
                self.meta.setdefault(name, a["content"].strip())
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href")
        if tag == "time" and self.time is None:
            self.time = a.get("datetime") or None
        if tag in _BLOCK and not self.skip:
            self._add("\n")
        if tag not in _VOID:
            if not self.skip and tag not in self.dropped:
                self.seen.add(tag)
            self.open.append(tag)
            if tag in self.dropped:
                self.skip += 1
            if tag in ("h1", "title") and tag not in self.titles:
                self.titles[tag] = []
        if tag == "a" and "href" in a and not self.skip:
            self.anchor = [a["href"], []]
            for b in self._places():
                self.links.setdefault(b, []).append(self.anchor)
        if tag == "img" and not self.skip:
            self.images.append({k: a.get(k, "") for k in ("src", "srcset", "alt", "width", "height")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchor = None
        if tag in self.open:
            while self.open:
                t = self.open.pop()
                if t in self.dropped:
                    self.skip -= 1
                if t == tag:
                    break
        if tag in _BLOCK and not self.skip:
            self._add("\n")

    def handle_data(self, data):
        for t in ("h1", "title"):
            if t in self.open and t in self.titles:
                self.titles[t].append(data)
        if self.skip:
            return
        self._add(re.sub(r"\s+", " ", data))
        if self.anchor is not None:
            self.anchor[1].append(data)


def _flat(text: str) -> str:
    return " ".join(text.split())


def written_chars(html: str) -> int:
    """Characters of a closed article as its source has them: tags are blanks, references like &amp; count as written."""
    at, end = html.find("<article>"), html.rfind("</article>")
    return len(re.sub(r"[ \t\n\f\r]+", " ", re.sub(r"<[^>]*>", " ", html[at + len("<article>") : end])).strip(" ")) if 0 <= at < end else 0


def read(html: str, url: str, dropped=DROPPED, bodies=BODIES, most_chars: int = 250_000, most_links: int = 200, least_chars: int | None = 30) -> dict | None:
    """What a page says; None if it has no title, or its first body has fewer characters than asked (another reader may do better).

    With least_chars None every page is read, titled or not. Links are resolved against the page's own address.
    """
    page = _Page(dropped, bodies)
    page.feed(html)
    page.close()
    body = next((b for b in bodies if b in page.seen), None)
    lines = [_flat(x) for x in "".join(page.text.get(body, ())).split("\n")]
    text = "\n".join(x for x in lines if x)
    if least_chars is not None and len(text) < least_chars:
        return None
    heading = _flat("".join(page.titles.get("h1", ())))
    title = page.meta.get("og:title") or heading or _flat("".join(page.titles.get("title", ()))) or None
    if title is None and least_chars is not None:
        return None
    first: dict[str, str] = {}
    for href, parts in page.links.get(body, ()):
        to = joined(url, href)
        if to and to not in first:
            first[to] = _flat("".join(parts))
    links = list(first.items())
    return {
        "title": title, "author": page.meta.get("author"), "published": page.meta.get("article:published_time") or page.time, "canonical": joined(url, page.canonical) if page.canonical else None,
        "declared_lang": page.lang, "text": text[:most_chars], "omitted_chars": max(0, len(text) - most_chars), "links": [{"target": t, "anchor": x} for t, x in links[:most_links]], "omitted_links": max(0, len(links) - most_links),
    }


def plain(html: str, url: str, most_chars: int = 250_000) -> dict:
    """Any page as its text without marks; the title is its first line, or the host."""
    page = _Page(("script", "style", "noscript", "template"), ("_",))
    page.open.append("_")
    page.feed(html)
    page.close()
    text = "\n".join(x for x in (_flat(v) for v in "".join(page.text.get("_", ())).split("\n")) if x)
    title = text.split("\n")[0][:200] or re.sub(r"^[a-z]+://([^/?#]*).*$", r"\1", url)
    return {"title": title, "author": None, "published": None, "canonical": None, "declared_lang": page.lang, "text": text[:most_chars], "omitted_chars": max(0, len(text) - most_chars), "links": [], "omitted_links": 0}


_SCHEMA = "tier string, title string, author string, published string, canonical string, declared_lang string, text string, omitted_chars long, links array<struct<target:string,anchor:string>>, omitted_links long"


def page_readings(pages: DataFrame, page: str, url: str, html: str, most_bytes: int = 8 << 20, enough: Callable[[str], bool] | None = None, **options) -> DataFrame:
    """One row for each page: its id, the tier that read it (fast, or plain where that found too little), and the reading; null html gives nulls.

    Input beyond most_bytes characters is cut before reading. enough, asked about the whole input, decides the tier in place
    of the text's length and title. Parsing is a tree walk, which no SQL function does.
    """
    kind = pages.schema[page].dataType.simpleString()
    link = pa.list_(pa.struct([("target", pa.string()), ("anchor", pa.string())]))
    types = {"links": link, "omitted_chars": pa.int64(), "omitted_links": pa.int64()}
    options |= {"least_chars": None} if enough else {}

    def work(batches):
        for batch in batches:
            out = []
            for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got = None if h is None or (enough and not enough(h)) else read(h[:most_bytes], u or "", **options)
                out.append({"tier": None} if h is None else {"tier": "fast", **got} if got else {"tier": "plain", **plain(h[:most_bytes], u or "")})
            names = [x.split()[0] for x in re.split(r", (?![^<]*>)", _SCHEMA)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(n) for r in out], types.get(n, pa.string())) for n in names)], names=[page, *names])

    return pages.select(page, url, html).mapInArrow(work, f"{page} {kind}, {_SCHEMA}")


def page_links(readings: DataFrame, page: str) -> DataFrame:
    """page, ordinal, target, anchor of each link of a reading."""
    return readings.select(page, F.posexplode("links").alias("ordinal", "l")).select(page, "ordinal", "l.target", "l.anchor")


def language(readings: DataFrame, detect: Column, confidence: Column, margin: Column, text: str, declared: str, least_chars: int = 30, least: float = 0.5, least_margin: float = 0.1) -> DataFrame:
    """readings with language (und if the text is short, unsure or close) and whether the declared one disagrees."""
    ok = (F.length(text) >= least_chars) & (confidence >= least) & (margin >= least_margin)
    out = readings.withColumn("language", F.when(F.coalesce(ok, F.lit(False)), detect).otherwise("und"))
    return out.withColumn("disagrees", (F.col("language") != "und") & F.col(declared).isNotNull() & (F.lower(F.split(declared, "[-_]")[0]) != F.col("language")))


def text_references(text: Column, most: int) -> Column:
    """Distinct http(s) addresses of a text, in order: up to a blank, bracket or backtick, without marks at the end."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\[\]`]+"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:)]+$", ""))), 1, most)


_DESCRIPTORS = re.compile(r"(?:\([^)]*(?:\)|$)|[^,(])*")
_WORDS = re.compile(r"(?:\([^)]*(?:\)|$)|[^ \t\n\f\r(])+")


#: srcset: candidates of an image, as browsers read them.
def srcset(value: str) -> list[dict]:
    """url, width, density of each valid candidate; one with a wrong descriptor is left out."""
    out, at = [], 0
    while True:
        while at < len(value) and value[at] in " \t\n\f\r,":
            at += 1
        if at >= len(value):
            return out
        end = at
        while end < len(value) and value[end] not in " \t\n\f\r":
            end += 1
        url = value[at:end]
        words: list[str] = []
        if url.endswith(","):
            url = url.rstrip(",")
            at = end
        else:
            # A bracket holds until the next closing one: brackets don't nest, and commas and blanks inside are plain.
            held = _DESCRIPTORS.match(value, end)[0]
            words, at = _WORDS.findall(held), end + len(held)
        width = [w for w in words if re.fullmatch(r"[0-9]+w", w) and int(w[:-1]) > 0]
        density = [w for w in words if re.fullmatch(r"(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?x", w)]
        height = [w for w in words if re.fullmatch(r"[0-9]+h", w)]
        if url and len(width) <= 1 and len(density) <= 1 and len(width) + len(density) + len(height) == len(words) and not (width and density) and not (height and not width):
            out.append({"url": url, "width": int(width[0][:-1]) if width else None, "density": float(density[0][:-1]) if density else (None if width else 1.0)})


def srcset_variants(rows: DataFrame, key: str, value: str, most_width: int = 4096, most_density: float = 4.0) -> DataFrame:
    """key, ordinal, url, width, density, chosen: the widest candidate within bounds, else the densest; the first of equal ones."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            out = [(k, i, c["url"], c["width"], c["density"]) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, c in enumerate(srcset(v or ""))]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=[key, "ordinal", "url", "width", "density"])

    out = rows.select(key, value).mapInArrow(work, f"{key} {kind}, ordinal long, url string, width long, density double")
    from pyspark.sql import Window as W

    fits = F.coalesce(F.col("width") <= most_width, F.col("density") <= most_density)
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.coalesce(fits, F.lit(False))), F.desc(F.coalesce("width", F.lit(-1))), F.desc(F.coalesce("density", F.lit(-1.0))), "ordinal"))
    return out.withColumn("chosen", (best == 1) & F.coalesce(fits, F.lit(False)))


def image_candidates(images: DataFrame, terms: list[str], least_width: int, least_height: int, excluded: list[str]) -> DataFrame:
    """images (url, caption, attributes, width, height) and admitted: no excluded token, large enough where declared, and a term in url, caption or attributes."""
    hay = F.lower(F.concat_ws(" ", "url", "caption", "attributes"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)) if words else F.expr("cast(array() as array<string>)"), lambda w: F.contains(hay, F.lower(w)))
    big = (F.coalesce("width", F.lit(least_width)) >= least_width) & (F.coalesce("height", F.lit(least_height)) >= least_height)
    return images.withColumn("admitted", ~has(excluded) & big & has(terms))
