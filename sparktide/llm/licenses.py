"""Licence scan: which notice a stretch of text is, by the words it differs in and how well the notice helps to compress it.

Blocks end at sentence ends and blank lines; the lines of a block are joined, so a wrapped notice is whole.  Blocks with a
cue are candidates.  A notice is aligned word by word with a block if the words that the block lacks leave it possible that
few enough differ; notices of several sentences are aligned with the block and what follows it.  A difference must not touch
a word that tells licences apart, such as a name, a clause or a version.  The notice with the most words kept, less those
that differ, wins; equal ones are ranked by what the notice as a raw dictionary saves.  What a match leaves of a block is
matched again until no notice fits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),"
    " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or"
    " sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_ENDORSE = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
_SHOW = (
    " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed"
    " by the organization."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
    " FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
    " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
    " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE"
    " OF THIS SOFTWARE."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'


def _gnu(what: str, version: str) -> str:
    return (
        f"you can redistribute it and/or modify it under the terms of the GNU {what} as published by the Free Software Foundation, either version {version}"
        " of the License, or (at your option) any later version."
    )


#: Names of licences as sentences about several of them have them.
NAMED = [
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("ISC", "the ISC License"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("MIT", "the MIT License"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
]
#: SPDX names and the wording of common notices, whole ones and single sentences.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", _MIT),
    (
        "MIT",
        f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS'
        " FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _ENDORSE + _BSD_END),
    ("BSD-3-Clause", _BSD + _ENDORSE),
    ("BSD-4-Clause", _BSD + _SHOW + _ENDORSE + _BSD_END),
    ("0BSD", _USE + _ISC_END),
    ("ISC", _USE + _KEEP + _ISC_END),
    ("ISC", _USE + _KEEP + "."),
    (
        "Apache-2.0",
        f"{_APACHE} You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", f"This program is free software; {_gnu('General Public License', '2')}"),
    ("LGPL-2.1", f"This library is free software; {_gnu('Lesser General Public License', '2.1')}"),
    ("LGPL-3.0", f"This library is free software; {_gnu('Lesser General Public License', '3')}"),
    ("AGPL-3.0", f"This program is free software: {_gnu('Affero General Public License', '3')}"),
    *((name, f"{before} {words}.") for name, words in NAMED for before in ("under", "or", "and")),
]
#: What a candidate block has, signs and line ends counting as white space.
CUES = re.compile(r"licen|permission|redistribut|public[\W_]+domain|(?<![^\W_])cc(?:0|[\W_]+by)")
#: Words that tell licences apart; numbers do so as well.
TELLING = frozenset(
    "affero apache attribution boost bsd by cc cc0 clause eclipse general gnu isc lesser mit mozilla nc nd noncommercial public sa sharealike unencumbered domain".split()
)
#: Such words of notices of several sentences, where some of those above are common words.
TELLING_LONG = TELLING - set("by clause domain general public".split()) | {"advertising", "endorse"}

#: Words by which a block may differ, as a share of the notice's.
DIFFERENT = 0.2
LEVEL, REMEMBERED = 3, 20_000

# "v." ends no sentence; a line end does if no word is on the next line
SENTENCE = re.compile(r"(?:[^.!?\n]++|\n(?![^\w\n]*(?:\n|\Z))|(?<=\b[vV])\.|[.!?](?!\s|\Z))++[.!?]*")
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

MATCH = "struct<license:string,start:int,end:int,gain:double,differences:array<string>>"


def align(notice: list[str], block: list[str], heavy: Callable[[str], bool] | None = None) -> tuple[int, int, list[str]]:
    """First and last word of the place in block nearest to notice, and the differences there (-left out, +put in).

    Heavy words may not differ, nor may a word be put in between two of them; there is no place, (0, -1, []), if one must.
    """
    n, m = len(notice), len(block)
    left = [1 + (n + m) * (heavy is not None and heavy(w)) for w in notice]
    put = [1 + (n + m) * (heavy is not None and heavy(w)) for w in block]
    inner = [(n + m) * (heavy is not None and heavy(a) and heavy(b)) for a, b in pairwise(notice)] + [0]
    cost = [[0, *accumulate(left)]]
    for word, more in zip(block, put, strict=True):
        before, row = cost[-1], [0]
        last = 0
        for i, own in enumerate(notice):
            less = left[i]
            last = min(before[i] + (0 if own == word else less + more), last + less, before[i + 1] + more + inner[i])
            row.append(last)
        cost.append(row)
    end = min(range(m + 1), key=lambda j: (cost[j][n], j))
    i, j, said = n, end, []
    if heavy and cost[end][n] > n + m:
        return 0, -1, []
    while i:
        same = j and notice[i - 1] == block[j - 1]
        if j and cost[j][i] == cost[j - 1][i - 1] + (0 if same else left[i - 1] + put[j - 1]):
            if not same:
                said += [f"+{block[j - 1]}", f"-{notice[i - 1]}"]
            i, j = i - 1, j - 1
        elif cost[j][i] == cost[j][i - 1] + left[i - 1]:
            said.append(f"-{notice[i - 1]}")
            i -= 1
        else:
            said.append(f"+{block[j - 1]}")
            j -= 1
    return j, end - 1, said[::-1]


class Notice:
    """A notice, and where it can be."""

    def __init__(self, name: str, text: str, compressor):
        self.name, self.compressor = name, compressor
        self.words = WORD.findall(text.lower())
        self.long = sum(1 for m in SENTENCE.finditer(text) if WORD.search(m[0])) > 1
        self.most = int(DIFFERENT * len(self.words))
        self.known = frozenset(self.words)
        digits = not self.long or any(w[0].isdigit() for w in self.words)
        telling = TELLING_LONG if self.long else TELLING
        self.heavy = lambda w: w in telling or (digits and w[:1].isdigit())
        self.needed = frozenset(w for w in self.words if self.heavy(w))

    def stretches(self, words: list[str]) -> list[tuple[int, int]]:
        """Runs of words outside which it cannot be: at most self.most words are put in, so it is in a run of so many
        words more than its own; at most so many are left out, so all but these are there.
        """
        wide, least = len(self.words) + self.most, len(self.words) - self.most
        if len(words) < least:
            return []
        if len(words) <= 2 * wide:
            return [(0, len(words))]
        out: list[list[int]] = []
        sums = [0, *accumulate(w in self.known for w in words)]
        for a in range(len(words) - wide + 1):
            if sums[a + wide] - sums[a] >= least:
                if out and a <= out[-1][1]:
                    out[-1][1] = a + wide
                else:
                    out.append([a, a + wide])
        return [(a, b) for a, b in out]

    def find(self, words: list[str], there: set[str]) -> tuple[int, int, int, list[str]] | None:
        """(words kept less differences, first, last, differences) of its best place, or None."""
        if not self.needed <= there or len(self.known - there) > self.most:
            return None
        best = None
        for a, b in self.stretches(words):
            first, last, said = align(self.words, words[a:b], self.heavy)
            if len(said) <= self.most and last >= first:
                worth = len(self.words) - sum(d[0] == "-" for d in said) - len(said)
                if best is None or worth > best[0]:
                    best = (worth, a + first, a + last, said)
        return best


class Scanner:
    """Notices as dictionaries of compressors."""

    def __init__(self, notices: list[tuple[str, str]]):
        import zstandard

        frame = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain = zstandard.ZstdCompressor(compression_params=frame)
        given = []
        for name, text in notices:
            raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.append(Notice(name, text, zstandard.ZstdCompressor(dict_data=raw, compression_params=frame)))
        self.long, self.short = [g for g in given if g.long], [g for g in given if not g.long]
        self.wide = max((len(g.words) + g.most for g in self.long), default=0)
        self.seen: dict[str, list[tuple]] = {}

    def block(self, low: str) -> list[tuple]:
        """(licence, start, end, gain, differences) of all notices of one sentence in a block in lower case."""
        if low not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            places = [m.span() for m in WORD.finditer(low)]
            self.seen[low] = self._fits(low, places)
        return self.seen[low]

    def _best(self, low: str, places: list[tuple[int, int]], notices: list[Notice]) -> tuple | None:
        """(first, last, match) of the best match of the words at these places."""
        words = [low[a:b] for a, b in places]
        there, best = set(words), None
        for notice in notices:
            found = notice.find(words, there)
            if found and (best is None or found[0] >= best[0]):
                worth, first, last, said = found
                start, end = places[first][0], places[last][1]
                raw = " ".join(low[start:end].split()).encode("utf-8", "surrogatepass")
                gain = 1 - len(notice.compressor.compress(raw)) / len(self.plain.compress(raw))
                if best is None or (worth, gain) > best[:2]:
                    best = (worth, gain, first, last, (notice.name, start, end, round(gain, 6), said))
        return best and best[2:]

    def _fits(self, low: str, places: list[tuple[int, int]]) -> list[tuple]:
        """The best match of notices of one sentence, and those in what it leaves on both sides."""
        out, open_ = [], [places]
        while open_:
            own = open_.pop()
            best = self._best(low, own, self.short)
            if best:
                out.append(best[2])
                open_ += [own[: best[0]], own[best[1] + 1 :]]
        return sorted(out, key=lambda f: f[1])

    def _whole(self, low: str, candidates: list[tuple[int, int]]) -> list[tuple]:
        """Notices of several sentences that begin in a candidate block."""
        out, done = [], 0
        for start, end in candidates if self.long else ():
            while max(start, done) < end:
                places, after, before = [], 0, done
                for m in WORD.finditer(low, max(start, done)):
                    after += m.start() >= end
                    if after > self.wide:
                        break
                    places.append(m.span())
                while best := self._best(low, places, self.long):
                    if best[2][1] < end:  # others are seen whole from their own block
                        out.append(best[2])
                        done = max(done, best[2][2])
                    places = places[: best[0]]
                if done == before:
                    break
        return out

    def __call__(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of candidate blocks of a text, and its matches with character offsets."""
        low = (text or "").lower()
        if not CUES.search(low):
            return 0, []
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        candidates = [m.span() for m in SENTENCE.finditer(low) if CUES.search(m[0])]
        found = self._whole(low, candidates)
        taken = [f[1:3] for f in found]
        for start, end in candidates:
            for a, b in [*((a, b) for a, b in taken if a < end and b > start), (end, end)]:
                if start < a:
                    found += [(name, start + x, start + y, gain, said) for name, x, y, gain, said in self.block(low[start:a])]
                start = max(start, b)
        found.sort(key=lambda f: f[1])
        return len(candidates), [{"license": name, "start": a, "end": b, "gain": gain, "differences": said} for name, a, b, gain, said in found]


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: id, n_candidates, licenses (distinct names, sorted), matches (license, start, end, gain, differences).

    A null or empty text has neither; each row is scanned whole and on its own; equal gains go to the notice listed
    first.  The notices are a parameter of the caller and travel with the code.  Other columns are ignored.
    """
    given = list(NOTICES if notices is None else notices)
    kind = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("gain", pa.float64()), ("differences", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(given)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                made = [scan(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), pa.array([n for n, _ in made], pa.int64()),
                        pa.array([sorted({m["license"] for m in found}) for _, found in made], pa.list_(pa.string())), pa.array([found for _, found in made], pa.list_(kind)),
                    ],
                    names=["id", "n_candidates", "licenses", "matches"],
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_candidates long, licenses array<string>, matches array<{MATCH}>").withColumnRenamed("id", id)
