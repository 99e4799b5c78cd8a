"""License scans: lines, paragraphs and whole texts against license templates by the Dice coefficient of word bigrams.

Texts and templates are normalised alike (A-Z lower-cased, words of letters, digits and other non-ASCII characters). A
unit of distinct bigrams A can reach the threshold t with a template of bigrams B only if |B| t / (2 - t) <= |A| <=
|B| (2 - t) / t, and only if it holds one of any |B| - ceil(|B| t / (2 - t)) + 1 bigrams of B. The second bound picks a
few anchors per template; texts without any anchor, found in one scan by an automaton, are not cut into units.

Besides these units, runs of consecutive words are compared, wherever they begin and end, for the templates with an anchor
in the text: licenses of several paragraphs inside longer texts, notices inside a line of prose. A best run can be taken
to begin and end with a bigram of the template that is not found again inside it, since others add nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.decontaminate import words_of
from cardmill.llm.wordhash import TRANSLATION

DICE = 0.8

#: Short notices and standard license texts, by template name; the license is the part before the slash.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT/notice": "Released under the MIT License.",
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

LINE, PARAGRAPH = re.compile(r"[^\n]+"), re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")

SCHEMA = (
    "doc_id long, matches array<struct<template:string,unit:string,start:long,end:long,dice:double>>, "
    "runs array<struct<template:string,unit:string,start:long,end:long,dice:double>>"
)
_MATCHES = pa.list_(
    pa.struct([("template", pa.string()), ("unit", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())])
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("matches", _MATCHES), ("runs", _MATCHES)])


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(zip(words, words[1:]))


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        made = sorted((len(b), name, b) for name, text in texts.items() if (b := bigrams(words_of(text))))
        self.sizes = [n for n, _, _ in made]
        self.made = [(name, b) for _, name, b in made]
        self.grams = dict(self.made)
        self.anchors = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for k, (n, _, grams) in enumerate(made):
            least = math.ceil(n * threshold / (2 - threshold) - 1e-9)
            # Long words first: any choice is right, rare bigrams spare more texts.
            for a, b in sorted(grams, key=lambda g: (-len(g[0]) - len(g[1]), g))[: n - least + 1]:
                owners.setdefault(f" {(a + b' ' + b).decode('latin-1')} ", []).append(k)
        for anchor, which in owners.items():
            self.anchors.add_word(anchor, which)
        self.anchors.make_automaton()

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        """The template of the highest coefficient (of equal ones the first by name), if it reaches the threshold."""
        t = self.threshold
        if not self.sizes or len(words) - 1 < self.sizes[0] * t / (2 - t) - 1e-9:
            return None
        own = bigrams(words)
        low = bisect_left(self.sizes, len(own) * t / (2 - t) - 1e-9)
        high = bisect_right(self.sizes, len(own) * (2 - t) / t + 1e-9)
        scored = [(-2 * len(own & b) / (len(own) + len(b)), name) for name, b in self.made[low:high]]
        if not scored or -min(scored)[0] < t:
            return None
        score, name = min(scored)
        return name, -score

    def best_runs(self, own: list[tuple[bytes, bytes]], k: int) -> list[tuple[int, float, int, int]]:
        """(common bigrams, coefficient, first, last bigram) of the best run from each place where one reaches the threshold."""
        t, grams = self.threshold, self.made[k][1]
        most = len(grams) * (2 - t) / t + 1e-9
        least = len(grams) * t / (2 - t) - 1e-9
        hit = [g in grams for g in own]
        again = [len(own)] * len(own)  # the next place of the same bigram
        last: dict[tuple[bytes, bytes], int] = {}
        for i in range(len(own) - 1, -1, -1):
            again[i] = last.get(own[i], len(own))
            last[own[i]] = i
        held: dict[tuple[bytes, bytes], int] = {}
        end = common = 0  # bigrams first .. end - 1 are held, as many as the bound on distinct ones allows
        out = []
        for first, gram in enumerate(own):
            while end < len(own) and (own[end] in held or len(held) + 1 <= most):
                common += hit[end] and own[end] not in held
                held[own[end]] = held.get(own[end], 0) + 1
                end += 1
            if hit[first] and common >= least:
                seen: set[tuple[bytes, bytes]] = set()
                both, top = 0, None
                for i in range(first, min(end, again[first])):
                    if own[i] not in seen:
                        seen.add(own[i])
                        if hit[i]:
                            both += 1
                            score = 2 * both / (len(seen) + len(grams))
                            if score >= t and (top is None or (score, both) > (top[1], top[0])):
                                top = (both, score, first, i)
                if top:
                    out.append(top)
            if first < end:
                held[gram] -= 1
                if not held[gram]:
                    del held[gram]
                    common -= hit[first]
        return out

    def runs(self, text: str, words: list[bytes], which: set[int], units: list[dict]) -> list[dict]:
        """Runs of words by start that reach the threshold, of overlapping ones that with more of its template in it.

        A run that overlaps a unit with the same template is not listed again.
        """
        own = list(zip(words, words[1:]))
        found = [(-n, -score, self.made[k][0], a, b) for k in which for n, score, a, b in self.best_runs(own, k)]
        if not found:
            return []
        raw = text.encode("utf-8", "replace")
        inside = np.concatenate(([False], np.frombuffer(raw.translate(TRANSLATION), np.uint8) != 32, [False]))
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        starts = points[np.flatnonzero(inside[1:-1] & ~inside[:-2])].tolist()
        ends = points[np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1].tolist()
        covered: dict[str, tuple[list[int], list[int]]] = {}  # begins and ends of each template's units, overlapping ones as one
        for u in sorted(units, key=lambda u: u["start"]):
            begins, stops = covered.setdefault(u["template"], ([], []))
            if stops and u["start"] <= stops[-1]:
                stops[-1] = max(stops[-1], u["end"])
            else:
                begins.append(u["start"])
                stops.append(u["end"])
        taken: list[tuple[int, int]] = []  # words of the runs chosen so far, apart from each other, in order
        out = []
        for _, minus, name, a, b in sorted(found):
            at = bisect_left(taken, (a, a))
            if (at and taken[at - 1][1] >= a) or (at < len(taken) and taken[at][0] <= b + 1):
                continue
            low, high = taken[at - 1][1] + 1 if at else 0, taken[at][0] - 1 if at < len(taken) else len(own)
            grams = self.grams[name]
            while a > low and own[a - 1] in grams:  # bigrams found again inside belong to it as well
                a -= 1
            while b + 1 < high and own[b + 1] in grams:
                b += 1
            taken.insert(at, (a, b + 1))
            start, end = starts[a], ends[b + 1]
            begins, stops = covered.get(name, ([], []))
            before = bisect_left(begins, end) - 1  # the last covered stretch that begins before the run ends
            if before < 0 or stops[before] <= start:
                out.append({"template": name, "unit": "run", "start": start, "end": end, "dice": -minus})
        return sorted(out, key=lambda m: m["start"])

    def scan(self, text: str | None) -> tuple[list[dict], list[dict]]:
        """Matches by start, then end: lines, paragraphs, the whole text; equal spans count once, as the smaller unit.

        Second, the runs of words that match besides.
        """
        text = text or ""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        which = {k for _, ks in self.anchors.iter(joined.decode("latin-1")) for k in ks} if len(self.anchors) else set()
        if not which:
            return [], []
        spans: dict[tuple[int, int], str] = {}
        for unit, found in (
            ("line", LINE.finditer(text)), ("paragraph", PARAGRAPH.finditer(text)), ("text", re.finditer(r"(?s).+", text)),
        ):
            for m in found:
                spans.setdefault(m.span(), unit)
        out = []
        for (start, end), unit in sorted(spans.items()):
            if hit := self.best(words_of(text[start:end])):
                out.append({"template": hit[0], "unit": unit, "start": start, "end": end, "dice": hit[1]})
        return out, self.runs(text, words, which, out)


@lru_cache(maxsize=4)
def _templates(texts: tuple[tuple[str, str], ...], threshold: float) -> Templates:
    return Templates(dict(texts), threshold)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = DICE) -> DataFrame:
    """One row per document row: doc_id, its matches (template, unit, code point span, coefficient) and matching runs.

    Reads doc_id and text alone, whatever other columns are called. Null and empty texts have no match; repeated rows
    give repeated rows, an empty table none; texts are read whole. Templates are a parameter of the code, not data.
    """
    texts = tuple((TEMPLATES if templates is None else templates).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(texts, threshold)
        for batch in batches:
            found = [known.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array([x[k] for x in found], _MATCHES) for k in (0, 1))], schema=_ARROW
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
