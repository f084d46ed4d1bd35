"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Hashes of three consecutive words of every template are winnowed (in each window of ``WINDOW`` the least is kept; short
templates keep all) and go to an inverted index, whose size depends on the templates alone. A document's hits of a
template on neighbouring diagonals make a candidate, which a local alignment of words, confined to a band about those
diagonals, confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .runtime import loaded, tidy
from .textnum import char_chunks, mix, span_hash, texts, utf8_bytes
from .toxicity import words

GRAM, WINDOW = 3, 4

#: Notices, per-file headers and whole texts of common licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    **TEXTS,
}


def grams(word: np.ndarray) -> np.ndarray:
    """Hashes of every three consecutive words."""
    if len(word) < GRAM:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(word) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[j : j + len(out)]
    return mix(out, 3)


def winnow(values: np.ndarray) -> list[int]:
    """Places of the least value in each window, the rightmost of equals; all where there are few."""
    if len(values) <= 2 * WINDOW:
        return list(range(len(values)))
    view = np.lib.stride_tricks.sliding_window_view(values[::-1], WINDOW)[::-1]
    return sorted({i + WINDOW - 1 - int(k) for i, k in enumerate(np.argmin(view, axis=1))})


class Templates:
    def __init__(self, given: dict[str, str]):
        self.names = list(given)
        self.words, keys, owners, places = [], [], [], []
        self.prints = []
        for t, text in enumerate(given.values()):
            prefix, starts, ends, _ = words([text])
            word = span_hash(prefix, starts, ends)
            kept = winnow(g := grams(word))
            self.words.append(word)
            self.prints.append(len(kept))
            keys += [g[i] for i in kept]
            owners += [t] * len(kept)
            places += kept
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.owners, self.places = np.array(keys, np.uint64)[order], np.array(owners)[order], np.array(places)[order]

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word in the text, template and word in the template of every hit in the index."""
        left = np.searchsorted(self.keys, gram, "left")
        known = np.flatnonzero(self.keys[np.minimum(left, len(self.keys) - 1)] == gram)
        left = left[known]
        size = np.searchsorted(self.keys, gram[known], "right") - left
        entry = np.repeat(left, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(known, size), self.owners[entry], self.places[entry]


@loaded(4)
def templates(given: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(given))


def align(template: np.ndarray, text: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
    """Best local alignment with ``text`` whose diagonals (text less template) lie from ``first`` to ``last``: words
    matched, and the first and last place in the text. A match gives 2; a mismatch or a gap costs 1."""
    m, n = len(template), len(text)
    j = np.arange(n + 1)
    h = np.zeros((m + 1, n + 1), np.int32)
    for i in range(1, m + 1):
        row = np.zeros(n + 1, np.int32)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(text == template[i - 1], 2, -1), h[i - 1, 1:] - 1)
        row = np.maximum(row, 0)
        row[(j - i < first) | (j - i > last)] = 0
        row = np.maximum.accumulate(row + j) - j
        row[(j - i < first) | (j - i > last)] = 0
        h[i] = row
    i, k = np.unravel_index(int(np.argmax(h)), h.shape)
    matched, start, stop = 0, k, k
    while i and k and h[i, k] > 0:
        same = text[k - 1] == template[i - 1]
        if h[i, k] == h[i - 1, k - 1] + (2 if same else -1):
            if same:
                matched, start, stop = matched + 1, k - 1, max(stop, k - 1) if matched else k - 1
            i, k = i - 1, k - 1
        elif h[i, k] == h[i - 1, k] - 1:
            i -= 1
        else:
            k -= 1
    return matched, int(start), int(stop)


def find(t: Templates, word: np.ndarray, gram: np.ndarray, coverage: float) -> list[tuple[str, int, float, int, int]]:
    """Licenses in one text: name, words matched, coverage, first and last word."""
    at, owner, place = t.hits(gram)
    out = []
    for k in np.unique(owner).tolist():
        mine = owner == k
        m = len(t.words[k])
        band = max(4, m // 8)
        order = np.lexsort((at[mine], at[mine] - place[mine]))
        where = at[mine][order]
        diagonal = (at[mine] - place[mine])[order]
        found: list[tuple[str, int, float, int, int]] = []
        for group in np.split(np.arange(len(diagonal)), np.flatnonzero(np.diff(diagonal) > band) + 1):
            if len(np.unique(where[group])) < max(1, t.prints[k] // 4):
                continue
            low, high = int(diagonal[group[0]]) - band, int(diagonal[group[-1]]) + band
            a, b = max(0, low), min(len(word), high + m)
            matched, start, stop = align(t.words[k], word[a:b], low - a, high - a)
            if matched >= coverage * m:
                found.append((t.names[k], matched, matched / m, a + start, a + stop))
        end = -1
        for x in sorted(found, key=lambda x: (x[3], -x[1])):
            if x[3] > end:
                out.append(x)
                end = x[4]
    spare = lambda x: x[4] + 1 - x[3] - x[1]  # words of the span that are not the license's
    inside = lambda x, y: y[3] <= x[3] and x[4] <= y[4] and y[1] > x[1] and spare(y) < spare(x)
    fuller = lambda x, y: y[3:] == x[3:] and y[1] >= x[1] and y[2] > x[2]
    return [x for x in out if not any(inside(x, y) or fuller(x, y) for y in out)]


def scan(docs: DataFrame, given: dict[str, str] | None = None, coverage: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per license text found in a document: key, license, matched_words, coverage, start, end (characters,
    the end exclusive).

    Words are runs of letters and digits, letter case aside; ``coverage`` is the least share of a template's words. A
    notice that begins a longer text is reported beside it; a license whose words lie in a longer one's with more foreign
    words between them than that has is not, nor one whose span another covers more fully. Null and empty texts have none; repeated rows are scanned
    each for itself; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    named = tuple((given or TEMPLATES).items())
    rows = docs.select(key, text)
    schema = StructType([rows.schema[key]]).add("license", StringType()).add("matched_words", LongType()).add("coverage", DoubleType()).add("start", LongType()).add("end", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = templates(named)
        for batch in batches:
            every = texts(batch.column(1))
            take, out = [], []
            for a, b in char_chunks(every):
                prefix, starts, ends, at = words(every[a:b])
                word = span_hash(prefix, starts, ends)
                gram = grams(word)
                doc = np.repeat(np.arange(b - a), np.diff(at))
                near = t.keys[np.minimum(np.searchsorted(t.keys, gram), len(t.keys) - 1)] == gram
                data = offsets = chars = None
                for d in np.unique(doc[: len(gram)][near]).tolist():
                    s, e = at[d], at[d + 1]
                    for name, n, share, first, last in find(t, word[s:e], gram[s : max(s, e - GRAM + 1)], coverage):
                        if chars is None:
                            _, data, offsets = utf8_bytes(every[a:b])
                            chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                        zero = chars[offsets[d]]
                        take.append(a + d)
                        out.append((name, n, share, int(chars[starts[s + first]] - zero), int(chars[ends[s + last]] - zero)))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *columns], schema.names)

    return rows.where(F.col(text).isNotNull()).mapInArrow(tidy(run), schema)
