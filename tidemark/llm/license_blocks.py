"""Licence headers and whole licence texts: sparse TF-IDF cosine of blocks of neighbouring lines to templates.

Blocks are weighed by the words of the templates: frequencies count templates, and a word that no template has weighs most.  So a block's
cosine depends on the block alone, not on how often it is found, and is reckoned where its text lies.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

import numpy as np

#: Numbers of lines with words of a block; headers of other lengths are still covered by a good part.
SIZES = (2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Cosine from which the whole text of a licence file is a licence; different licences of one family are nearer than two texts on other things.
LEAST_WHOLE = 0.9
RESERVED = "AllRightsReserved"

_GNU = ("This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} "
        "either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General "
        "Public License along with this program; if not, see <https://www.gnu.org/licenses/>.")
_CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
_CC_OPENING = ("Creative Commons Attribution{0} 4.0 International Public License. By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
               "Creative Commons Attribution{0} 4.0 International Public License (\"Public License\"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed "
               "Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making "
               "the Licensed Material available under these terms and conditions.")
_KINDS = (("CC-BY-4.0", ""), ("CC-BY-NC-4.0", "-NonCommercial"), ("CC-BY-SA-4.0", "-ShareAlike"))
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is "
     "distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."),
    ("GPL-2.0", _GNU.format(";", "", ";", "2")), ("GPL-3.0", _GNU.format(":", "", ",", "3")), ("LGPL-2.1", _GNU.format(";", "Lesser ", ";", "2.1")), ("LGPL-3.0", _GNU.format(":", "Lesser ", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, _CC.format(kind)) for name, kind in _KINDS), *((name, _CC_OPENING.format(kind)) for name, kind in _KINDS),
)
_FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(_FOLD))


def full_texts() -> list[tuple[str, str]]:
    """The licence texts beside this module, by the name of their licence."""
    found = [f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return sorted((f.name[:-4], f.read_text("utf-8")) for f in found)


class Weigher:
    """Cosines of word lists to templates (licence, text); ``short`` ones are looked for in blocks, all in whole texts."""

    def __init__(self, notices, cues: str, least: float):
        full = full_texts()
        short = [(n, t) for n, t in notices if n != RESERVED] + list(HEADERS) + [(n, t) for n, t in full if len(words(t)) < 400]
        every = short + [(n, t) for n, t in full if len(words(t)) >= 400]
        self.names, self.short, self.least, self.cues = [n for n, _ in every], len(short), least, re.compile(cues)
        lists = [Counter(words(t)) for _, t in every]
        self.terms = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
        counted = np.zeros((len(self.terms), len(every)))
        for j, own in enumerate(lists):
            for w, n in own.items():
                counted[self.terms[w], j] = 1 + math.log(n)
        held = np.count_nonzero(counted, axis=1)
        self.idf = np.log((1 + len(every)) / (1 + held)) + 1
        self.unknown = math.log(1 + len(every)) + 1
        marks = counted * self.idf[:, None]
        self.marks = marks / np.sqrt((marks * marks).sum(axis=0))
        self.has = counted > 0

    def cosines(self, listed: list[str]) -> np.ndarray:
        own = Counter(listed)
        inside = [(self.terms[w], n) for w, n in own.items() if w in self.terms]
        if not inside:
            return np.zeros(len(self.names))
        at = np.array([i for i, _ in inside])
        weights = (1 + np.log(np.array([n for _, n in inside]))) * self.idf[at]
        rest = sum((1 + math.log(n)) ** 2 for w, n in own.items() if w not in self.terms) * self.unknown ** 2
        return weights @ self.marks[at] / math.sqrt(float(weights @ weights) + rest)

    def best(self, found: np.ndarray) -> int:
        """The template with the greatest cosine; of equal ones the first licence by name."""
        top = round(float(found.max()), 9)
        return min((self.names[j], j) for j in range(len(found)) if round(float(found[j]), 9) == top)[1]

    def judge(self, text: str, licence_file: bool):
        """(licence, cosine, whole, lines): the best block or, of a licence file, its whole text; and the numbers of the lines of blocks that match."""
        lines = [(i, w, bool(self.cues.search(line.translate(_FOLD)))) for i, line in enumerate(text.split("\n")) for w in [words(line)] if w]
        best, covered = None, set()
        if licence_file and lines:
            found = self.cosines([w for _, own, _ in lines for w in own])
            j = self.best(found)
            if found[j] >= LEAST_WHOLE:
                best = (self.names[j], round(float(found[j]), 9), True)
        # bounds of a block's weights in words of templates, and in others
        known = [sum(self.idf[self.terms[w]] ** 2 for w in own if w in self.terms) for _, own, _ in lines]
        other = [len({w for w in own if w not in self.terms}) * self.unknown ** 2 for _, own, _ in lines]
        seen: set[tuple[int, int]] = set()
        judged: dict[tuple, tuple[int, float]] = {}
        for i, (_, _, cue) in enumerate(lines):
            if not cue:
                continue
            for size in SIZES:
                step = max(1, size // 3)
                for begin in {max(0, i - back) for back in [*range(0, size, step), size - 1]}:
                    end = min(len(lines), begin + size)
                    if end - begin < 2 or (begin, end) in seen:
                        continue
                    seen.add((begin, end))
                    most, rest = 1.48 * sum(known[begin:end]), max(other[begin:end])
                    if most < self.least ** 2 * (most + rest):  # (1 + ln n)^2 < 1.48 n
                        continue
                    key = tuple(w for _, own, _ in lines[begin:end] for w in own)
                    if key not in judged:
                        found = self.cosines(key)[:self.short]
                        j = self.best(found)
                        judged[key] = j, round(float(found[j]), 9)
                    j, cosine = judged[key]
                    if cosine < self.least:
                        continue
                    if best is None or not best[2] and (-cosine, self.names[j]) < (-best[1], best[0]):
                        best = (self.names[j], cosine, False)
                    # a line beside a notice is no part of it
                    covered.update(n for n, own, _ in lines[begin:end] if 2 * sum(w in self.terms and bool(self.has[self.terms[w], j]) for w in own) >= len(own))
        return best, sorted(covered)
