"""License scans by conditional compression: a block that compresses much better with a template as its dictionary is
likely that license; the exact differences of wording confirm it."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import LOWER, as_bytes, quoted, texts_map

#: License, words that a match must have, wording. Public notices and the usual short statements.
TEMPLATES = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "This project is licensed under the MIT License."),
    ("MIT", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "gnu lesser 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "neither", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "isc", "Licensed under the ISC License."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "attribution-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "attribution-noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0 1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "rights reserved", "All rights reserved."),
)
#: One of these opens a candidate block.
TRIGGERS = (b"licens", b"licenc", b"copyright", b"spdx", b"permission", b"redistribut", b"public domain", b"rights reserved", b"cc by", b"cc0", b"warrant")
#: Words that a block takes on either side of a trigger, at least; more where a template with words put in is longer.
AROUND = 60
#: Least share of the template's words. All templates are compared, best reductions first.
LEAST_COVER = 0.9
#: Words put in between, as a share of the template's.
MOST_EXTRA = 0.25
#: A word may be broken after a hyphen, with comment marks before its rest.
_TOKEN = re.compile(r"[a-z0-9]+(?:(?:\.|-(?:[ \t\r]*\n[\s*#/;%!|>-]*)?)[a-z0-9]+)*")
_BREAK = re.compile(r"-[^a-z0-9]+")
_SPDX = re.compile(r"spdx-license-identifier:\s*", re.I)
_PART = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+(?::LicenseRef-[A-Za-z0-9.-]+)?)")
_FIND = re.compile(b"|".join(t.replace(b" ", rb"[\W_]+") for t in TRIGGERS))
_FIND_TEXT = re.compile(_FIND.pattern.decode(), re.A)


def tokens(text: str) -> list[str]:
    return [_BREAK.sub("-", w) for w in _TOKEN.findall(text.lower())]


def spdx(text: str) -> list[str]:
    """Licenses of all SPDX expressions in a text, in order: operands of AND and OR, without the exceptions after WITH."""
    names = []
    for tag in _SPDX.finditer(text):
        at, before = tag.end(), "OR"
        while m := _PART.match(text, at):
            part, at = m[1], m.end()
            if part in ("AND", "OR", "WITH"):
                if before in ("AND", "OR", "WITH", "("):
                    break
            elif part == "(":
                if before not in ("AND", "OR", "("):
                    break
            elif part == ")":
                if before in ("AND", "OR", "WITH", "("):
                    break
            elif before in ("AND", "OR", "("):
                if (name := part.rstrip(".-")) and name not in names:
                    names.append(name)
            elif before != "WITH":
                break
            before = part
            if part.endswith("."):
                break
    return names


def blocks(text: bytes, around: int = AROUND) -> list[tuple[int, int, str]]:
    """(first line, lines, text) of each candidate: the words around each trigger, across line ends; blocks that meet are one."""
    low = text.translate(LOWER)
    if not _FIND.search(low):
        return []
    # ASCII is lowered byte by byte, so places in both are the same. Triggers are looked for as bytes and placed by words.
    text, low = text.decode("utf-8", "replace"), low.decode("utf-8", "replace")
    starts, ends = array("q"), array("q")
    for m in _TOKEN.finditer(low):
        starts.append(m.start())
        ends.append(m.end())
    spans: list[list[int]] = []
    for m in _FIND_TEXT.finditer(low):
        first, last = max(0, bisect_right(starts, m.start()) - 1 - around), min(len(starts), bisect_right(starts, m.end() - 1) + around)
        if spans and first <= spans[-1][1]:
            spans[-1][1] = last
        else:
            spans.append([first, last])
    out, at, line = [], 0, 0
    for first, last in spans:
        lo, hi = starts[first], ends[last - 1]
        line += low.count("\n", at, lo)
        at = lo
        out.append((line, low.count("\n", lo, hi) + 1, text[lo:hi]))
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 19):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.templates = []
        self.around = AROUND
        for name, must, text in templates:
            d = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.templates.append((name, set(must.split()), tokens(text), own))
            self.around = max(self.around, math.ceil((1 + MOST_EXTRA) * len(self.templates[-1][2])))
        #: Words that tell licenses apart; put into another's wording they make it a different one.
        self.telling = {w for _, must, _, _ in self.templates for w in must if not any(c.isdigit() for c in w)} - {"rights", "reserved", "neither", "redistribution"}

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """Share of the compressed size that each template as a dictionary saves; best first."""
        raw = " ".join(block.lower().split()).encode()
        if not raw:
            return []
        size = len(self.plain.compress(raw))
        return sorted(((1 - len(own.compress(raw)) / size, -i) for i, (_, _, _, own) in enumerate(self.templates)), reverse=True)

    def matches(self, have: list[str], i: int) -> list[tuple[int, int, int, int]]:
        """(first word, end, missing words, words put in between) of each place where the wording is the template's."""
        _, must, want, _ = self.templates[i]
        # Words with digits tell versions apart and may not differ; nor may the words that name the license.
        fixed = must | {w for w in want if any(c.isdigit() for c in w)}
        if not fixed <= set(have):
            return []
        size, width = Counter(want), len(want) + int(MOST_EXTRA * len(want))
        least = math.ceil(LEAST_COVER * len(want) - 1e-9)
        # Words that the window has in common with the template, in any order: a bound on those in order.
        seen, common, end, found, at = Counter(), 0, 0, [], 0
        match = SequenceMatcher(None, autojunk=False)
        match.set_seq2(want)
        for s, word in enumerate(have):
            while end < min(len(have), s + width):
                seen[have[end]] += 1
                common += seen[have[end]] <= size[have[end]]
                end += 1
            if s >= at and common >= least and word in size and (got := self._in_window(match, have[s : s + width], want, fixed, self.telling - set(want))):
                found.append((s, s + got[0], got[1], got[2]))
                at = s + got[0]
            common -= seen[word] <= size[word]
            seen[word] -= 1
        return found

    @staticmethod
    def _in_window(match: SequenceMatcher, window: list[str], want: list[str], fixed: set[str], foreign: set[str]) -> tuple[int, int, int] | None:
        """End, missing words and words put in of the best match that begins with the window; None if there is none."""
        match.set_seq1(window)
        pieces = [m for m in match.get_matching_blocks() if m.size]
        if not pieces or pieces[0].a:
            return None
        best, hit, matched, end = None, 0, set(), 0
        for m in pieces:
            if foreign.intersection(window[end : m.a]):
                break
            hit += m.size
            matched |= set(want[m.b : m.b + m.size])
            end = m.a + m.size
            if hit >= LEAST_COVER * len(want) and end - hit <= MOST_EXTRA * len(want) and fixed <= matched:
                best = end, len(want) - hit, end - hit
        return best

    def scan(self, text: bytes | None) -> list[dict]:
        found = []
        for k, (line, n, block) in enumerate(blocks(text or b"", self.around)):
            row = {"block": k, "line": line, "n_lines": n, "license": None, "reduction": 0.0, "missing": 0, "extra": 0}
            names = {x: row | {"license": x, "reduction": 1.0} for x in spdx(block)}
            # In the order of reductions each template takes the places whose exact wording is its own. Where two would
            # meet, the one ranked before has won, unless the later one's wording holds it whole and says more.
            have, won = tokens(block), []
            words = lambda m: len(self.templates[m[1]][2]) - m[4]
            for reduction, at in self.ranked(block):
                row["reduction"] = max(row["reduction"], reduction)
                for m in ((reduction, -at, *m) for m in self.matches(have, -at)):
                    met = [o for o in won if o[2] < m[3] and m[2] < o[3]]
                    if all(m[2] <= o[2] and o[3] <= m[3] and words(m) > words(o) for o in met):
                        won = [o for o in won if o not in met] + [m]
            for m in won:
                name = self.templates[m[1]][0]
                if name not in names:
                    names[name] = row | {"license": name, "reduction": m[0], "missing": m[4], "extra": m[5]}
            found += names.values() or [row]
        return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: id, n_blocks, licenses (sorted, comma-joined; empty if none), n_confirmed, found.

    found lists each license of each block: first line, lines, license (one row of null if none was confirmed), reduction, and how many words
    are missing from and put into the wording. Null and empty texts have no block. Repeated rows give repeated results;
    other columns are not read. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("line", pa.int64()), ("n_lines", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64())])
    held: list[Scanner] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Scanner(templates))
        found = [held[0].scan(t) for t in as_bytes(batch, text_col)]
        names = [sorted({f["license"] for f in x if f["license"]}) for x in found]
        return {
            id_col: batch.column(id_col), "n_blocks": pa.array([len({f["block"] for f in x}) for x in found], pa.int64()), "licenses": pa.array([",".join(x) for x in names], pa.string()),
            "n_confirmed": pa.array([sum(f["license"] is not None for f in x) for x in found], pa.int64()), "found": pa.array([[{k: v for k, v in f.items() if k != "block"} for f in x] for x in found], pa.list_(item)),
        }

    return texts_map(docs, [id_col, text_col], lambda b: work(b), f"{quoted(id_col)} {kind}, n_blocks long, licenses string, n_confirmed long, found array<struct<line:bigint,n_lines:bigint,license:string,reduction:double,missing:bigint,extra:bigint>>")
