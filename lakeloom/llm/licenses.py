"""License scans: patience alignment of texts with license templates.

Words that occur once in a stretch of text and once in a template are anchors; the longest increasing run of anchors
is kept, and the gaps between are aligned in the same way. Coverage is the share of a template's words that align.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import over_texts, table

@dataclass(frozen=True)
class License:
    """A text to look for: each of its keys must stand word for word, and no bar inside the passage or right after it.

    exact: a notice of one line, where each word counts: nothing may be missing or stand between.
    """

    name: str
    text: str
    keys: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()
    exact: bool = False


#: License texts and notices as published, by SPDX identifier.
AS_IS = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
    " IN THE SOFTWARE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so"
)
MIT_TERMS = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in"
    " all copies or substantial portions of the Software."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_TERMS = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies."
)
ISC_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
    " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
    " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
    ' applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,'
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
    " governing permissions and limitations under the License."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
    " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
    " commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or"
    " authors of this software dedicate any and all copyright interest in the software to the public domain. We make this"
    " dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this"
    " dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software"
    " under copyright law."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
    " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
    " for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
    " following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote"
    " the original software. If you use this software in a product, an acknowledgment in the product documentation would be"
    " appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be"
    " misrepresented as being the original software. 3. This notice may not be removed or altered from any source"
    " distribution."
)
#: The notice of the GNU licenses: SPDX identifier, license, version, what it is about.
GNU = (
    ("GPL-2.0", "GNU General Public License", "2", "program"),
    ("GPL-3.0", "GNU General Public License", "3", "program"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "program"),
)
GNU_NOTICE = (
    "This {2} is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free"
    " Software Foundation, either version {1} of the License, or (at your option) any later version. This {2} is"
    " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
)
#: What one-line notices say before a license's name, and the names.
LEADS = ("licensed under", "released under", "distributed under", "available under", "under the terms of")
NAMES = (
    ("Apache-2.0", "the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    ("MIT", "the MIT License"),
    ("BSD-2-Clause", "the BSD 2-Clause License", "the 2-Clause BSD License"),
    ("BSD-3-Clause", "the BSD 3-Clause License", "the 3-Clause BSD License"),
    ("ISC", "the ISC License"),
    ("Unlicense", "the Unlicense"),
    ("Zlib", "the zlib License"),
    ("MPL-2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    *((name, f"the {title}, version {n}", f"the {title} v{n}") for name, title, n, _ in GNU),
    ("GPL-2.0", "the GPL version 2", "the GPL v2", "the GPLv2", "GPLv2"),
    ("GPL-3.0", "the GPL version 3", "the GPL v3", "the GPLv3", "GPLv3"),
)
#: The parts of the Creative Commons licenses: all with attribution, in version 4.0 or 3.0.
COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)


def _licenses() -> list[License]:
    disclaims = "endorse or promote products derived from this software"
    advertises = "advertising materials mentioning"
    out = [
        License("Apache-2.0", APACHE, ("apache license version 2 0",)),
        License("MIT", MIT_GRANT + MIT_TERMS + AS_IS, ("permission is hereby granted free of charge", "this permission notice")),
        License("MIT-0", MIT_GRANT + "." + AS_IS, ("permission is hereby granted free of charge",), ("this permission notice",)),
        *(License("BSD-2-Clause", BSD_TERMS + d, ("redistribution and use in source and binary forms",), (disclaims, "neither the name", advertises)) for d in ("", BSD_DISCLAIMER)),
        *(License("BSD-3-Clause", BSD_TERMS + BSD_NAMES + d, (disclaims,), (advertises,)) for d in ("", BSD_DISCLAIMER)),
        *(License("ISC", ISC_TERMS + d, ("provided that the above copyright notice",)) for d in ("", ISC_DISCLAIMER)),
        License("MPL-2.0", MPL, ("mozilla public license v 2 0",)),
        License("Unlicense", UNLICENSE, ("released into the public domain",)),
        License("Unlicense", UNLICENSE + AS_IS, ("released into the public domain",)),
        License("Zlib", ZLIB, ("origin of this software must not be misrepresented",)),
        License("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", exact=True),
        License("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", exact=True),
    ]
    for name, title, version, about in GNU:
        out.append(License(name, GNU_NOTICE.format(title, version, about), (f"{title} as published", f"version {version} of the license")))
    lines = [(name, title) for name, *titles in NAMES for title in titles]
    for version in ("4.0", "3.0"):
        for short, parts in COMMONS:
            titles = [f"CC {short} {version}", f"the CC {short} {version} License"]
            titles += [f"{a} Creative Commons {parts} {version} {kind} License" for a in ("a", "the") for kind in ("International", "Unported")]
            lines += [(f"CC-{short}-{version}", t) for t in titles]
    return out + [License(name, f"{lead} {title}", exact=True) for name, title in lines for lead in LEADS]


#: Words too common to start a search at. They are aligned like all others.
COMMON = frozenset(
    b"the of to and or in is a an this for with be that as by on it any all at not you may under without"
    b" licensed released distributed available terms license public version general".split()
)
#: Words are letters, digits and bytes past ASCII, without regard to case in A-Z; one byte stays one byte.
FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIN_COVERAGE = 0.8
#: Words within which another aligned word must be for a pair to count.
NEAR = 4
#: Share of a template's words that a stretch must hold to be aligned, and that must align for it to grow.
PARTLY = 0.3
#: Words after a passage in which a bar counts too: a further clause makes it another license.
BEYOND = 30


def anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Longest increasing run of places of words that occur once in a[a0:a1] and once in b[b0:b1]."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
    pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        spot = bisect_left(tails, j)
        before.append(ends[spot - 1] if spot else -1)
        if spot == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[spot], ends[spot] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both, by patience."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        fixed = anchors(a, b, a0, a1, b0, b1)
        if not fixed:
            continue
        last_a, last_b = a0, b0
        for i, j in fixed:
            todo.append((last_a, i, last_b, j))
            out.append((i, j))
            last_a, last_b = i + 1, j + 1
        todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def settled(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs with another one near, at most NEAR words off in both texts; the others are chance: a stray 'the'."""
    near = [b[0] - a[0] <= NEAR and b[1] - a[1] <= NEAR for a, b in zip(pairs, pairs[1:])]
    return [p for p, before, after in zip(pairs, [False, *near], [*near, False]) if before or after]


def flat_words(text: str) -> list[bytes]:
    return text.encode().translate(FLAT).split()


def _places(phrase: list[bytes], words: list[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i : i + n] == phrase]


class Template:
    def __init__(self, made: License, min_coverage: float = MIN_COVERAGE) -> None:
        self.name, self.exact = made.name, made.exact
        self.words = flat_words(made.text)
        self.counts = Counter(self.words)
        self.need = len(self.words) if made.exact else min_coverage * len(self.words) - 1e-9
        self.slack = 0 if made.exact else max(2, len(self.words) // 5)
        #: For each key the places where it stands in the template, as ranges.
        self.keys = [[range(i, i + len(flat_words(k))) for i in _places(flat_words(k), self.words)] for k in made.keys]
        self.bars = [flat_words(b) for b in made.bars]
        #: Rare and long words first, until the words left are too few to reach the coverage: each passage holds one of these.
        order = sorted(self.counts, key=lambda w: (w in COMMON, self.counts[w], -len(w), w))
        self.seeds: dict[bytes, list[int]] = {}
        rest = len(self.words)
        for w in order:
            if rest < self.need:
                break
            rest -= self.counts[w]
            self.seeds[w] = [i for i, x in enumerate(self.words) if x == w]
        #: Words by which a stretch is worth aligning, and how many of them it must hold.
        self.telling = {w: n for w, n in self.counts.items() if w not in COMMON}
        self.enough = PARTLY * sum(self.telling.values())

    def worth(self, part: list[bytes]) -> bool:
        held = Counter(part)
        return sum(min(n, held[w]) for w, n in self.telling.items()) >= self.enough

    def passage(self, words: list[bytes], begin: int, end: int) -> list[tuple[int, int]]:
        """Places of the text and of the template that align, for the stretch and what belongs to it on either side.

        The stretch grows by the template's length on a side whose words of the template are still missing, as long as
        more of them align: so insertions of up to that length are bridged wherever they stand, however many there are.
        """
        best = settled(align(words[begin:end], self.words))
        best = [(i + begin, j) for i, j in best]
        step = len(self.words) + 2 * self.slack
        while best and len(best) >= PARTLY * len(self.words) and len(best) < len(self.words):
            # What is missing inside may stand between words that are aligned already; then nothing is gained.
            left = max(0, begin - step) if best[0][1] > 0 else begin
            right = min(len(words), end + step) if best[-1][1] < len(self.words) - 1 else end
            if (left, right) == (begin, end):
                break
            begin, end = left, right
            more = [(i + begin, j) for i, j in settled(align(words[begin:end], self.words))]
            if len(more) <= len(best):
                break
            best = more
        return best

    def holds(self, words: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Whether the aligned words reach the coverage, with every key word for word and no bar inside or right after."""
        if len(pairs) < self.need:
            return False
        at = {j: i for i, j in pairs}
        whole = lambda r: all(j in at for j in r) and at[r[-1]] - at[r[0]] == len(r) - 1
        if not all(any(map(whole, places)) for places in self.keys):
            return False
        inside = words[pairs[0][0] : pairs[-1][0] + 1 + BEYOND]
        return not any(_places(b, inside) for b in self.bars if b[0] in inside)


_built: dict[float, tuple[list[Template], dict[bytes, list[int]]]] = {}


def templates(min_coverage: float = MIN_COVERAGE) -> tuple[list[Template], dict[bytes, list[int]]]:
    """The templates, and seed word -> numbers of the templates that it may start."""
    if min_coverage not in _built:
        made = [Template(x, min_coverage) for x in _licenses()]
        by_word: dict[bytes, list[int]] = {}
        for k, t in enumerate(made):
            for w in t.seeds:
                by_word.setdefault(w, []).append(k)
        _built[min_coverage] = (made, by_word)
    return _built[min_coverage]


Passage = tuple[str, int, int, float, int]


def scan(raw: bytes | None, min_coverage: float = MIN_COVERAGE) -> list[Passage]:
    """(license, start, end, coverage, words matched), spans in code points, by start.

    Each seed in the text proposes the stretch where its template would lie, with some slack; see Template.passage()
    for stretches with insertions. Passages that overlap are one: the license with most words matched stays.
    """
    if not raw:
        return []
    known, by_word = templates(min_coverage)
    flat = raw.translate(FLAT)
    words = flat.split()
    hits = [i for i, w in enumerate(words) if w in by_word]
    if not hits:
        return []
    tried: dict[int, set[int]] = {}
    found: list[tuple[int, int, float, str, int]] = []
    for i in hits:
        for k in by_word[words[i]]:
            t = known[k]
            for q in t.seeds[words[i]]:
                if t.exact:
                    if i >= q and words[i - q : i - q + len(t.words)] == t.words:
                        found.append((i - q, i - q + len(t.words), 1.0, t.name, len(t.words)))
                    continue
                begin = max(0, i - q - t.slack)
                seen = tried.setdefault(k, set())
                if begin in seen:
                    continue
                seen.add(begin)
                end = begin + len(t.words) + 2 * t.slack
                if not t.worth(words[begin:end]):
                    continue
                pairs = t.passage(words, begin, end)
                if t.holds(words, pairs):
                    found.append((pairs[0][0], pairs[-1][0] + 1, len(pairs) / len(t.words), t.name, len(pairs)))
    if not found:
        return []
    kept: list[tuple[int, int, float, str, int]] = []
    for f in sorted(found, key=lambda f: (-f[4], -f[2], f[1] - f[0], f[0], f[3])):
        if not any(f[0] < k[1] and k[0] < f[1] for k in kept):
            kept.append(f)
    places = [m.span() for m in re.finditer(rb"\S+", flat)]
    at = lambda b: len(raw[:b].decode())
    return [(n, at(places[a][0]), at(places[b - 1][1]), c, m) for a, b, c, n, m in sorted(kept)]


def _rows(ids: list, texts: list, min_coverage: float) -> list:
    out: list[list] = [ids, [], [], [], []]
    for raw in texts:
        found = scan(raw, min_coverage)
        out[1].append(len(found))
        out[2].append(",".join(sorted({f[0] for f in found})))
        out[3].append(max((f[3] for f in found), default=0.0))
        out[4].append(",".join(f"{n}:{a}:{b}:{c:.3f}" for n, a, b, c, _ in found))
    return out


def scanned(docs: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, n_passages, licenses, best_coverage, passages) for every row of docs.

    A license is named only by its own words: a text that leaves open which license or version it means names none.

    licenses: the identifiers found, in order, joined by commas; passages: license:start:end:coverage in code points of
    the whole text. A null or empty text has none and a coverage of 0; a text of any length is read whole; repeated rows
    repeat; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_passages long, licenses string, best_coverage double, passages string"
    return over_texts(docs, ["doc_id", "text!"], schema, _rows, min_coverage)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
