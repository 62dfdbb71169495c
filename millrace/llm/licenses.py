"""License scans by template markup.

A template is license wording with two kinds of marked regions: <<optional>> ... <</optional>> may be left out, and
<<any N>> stands for up to N words of any kind. It is compiled into an automaton over words, and a stretch of a document is
accepted if the mandatory wording matches exactly. To find stretches, the longest run of plain words that no acceptance can
do without is looked up in the text; the automaton runs from the places that can lie before it.

Two kinds of templates come with it: the whole wording of short licenses, from grant to disclaimer, so that a text with other
conditions is another license; and notices, the statements by which a text says that it is under a license.

Beside that, plain phrases are counted at each place where their words stand consecutively. Words are stretches of ASCII
letters, digits and bytes above 127, with A-Z lower-cased. All of it is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces, text_bytes

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
{more}
this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_GPL = """
this <<any 4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version {n} of the license or at your option any later version
<<optional>>this <<any 4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
see the gnu general public license for more details<</optional>>
"""

#: The whole wording of licenses, by label.
LICENSES = {
    "mit": """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<</optional>> to deal in the software without restriction
including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
""",
    "bsd-2": _BSD.format(more=""),
    "bsd-3": _BSD.format(more="<<any 1>> neither the name of <<any 12>> nor the names of <<any 2>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "isc": """
permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and <<any 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall <<any 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software
""",
    "zlib": """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
<<any 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
<<any 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
<<any 1>> this notice may not be removed or altered from any source distribution
""",
}

#: Notices by label.
NOTICES = {
    "mit": ["<<optional>>this <<any 4>> is<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> mit license"],
    "apache-2": [
        "<<optional>>this <<any 4>> is<</optional>> <<optional>>licensed<</optional>> <<optional>>under<</optional>> <<optional>>the<</optional>> apache license version 2 <<optional>>0<</optional>>",
        """
licensed under the apache license version 2 0 <<optional>>the license<</optional>> you may not use this <<any 3>> except in compliance with the license
you may obtain a copy of the license at <<any 1>> www apache org licenses license 2 0
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license
""",
    ],
    "cc-by-nc": ["<<optional>>licensed<</optional>> <<optional>>under<</optional>> cc by nc <<optional>>sa<</optional>> <<optional>>4 0<</optional>>", "creative commons attribution noncommercial <<optional>>4 0<</optional>> <<optional>>international<</optional>> <<optional>>license<</optional>>"],
    "cc-by": ["licensed under cc by 4 0", "creative commons attribution 4 0 <<optional>>international<</optional>> license"],
    "gpl-2": ["<<optional>>this <<any 4>> is licensed under the<</optional>> gnu general public license version 2", _GPL.format(n=2)],
    "gpl-3": ["<<optional>>this <<any 4>> is licensed under the<</optional>> gnu general public license version 3", _GPL.format(n=3)],
}

TEMPLATES = {label: [*([LICENSES[label]] if label in LICENSES else []), *NOTICES.get(label, [])] for label in {**LICENSES, **NOTICES}}

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if _ALNUM[b] else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


@dataclass
class Automaton:
    """States 0 to `end`; a state has word steps, steps for any word, and steps without a word."""

    word: dict[int, dict[bytes, set[int]]] = field(default_factory=dict)
    any: dict[int, set[int]] = field(default_factory=dict)
    free: dict[int, set[int]] = field(default_factory=dict)
    end: int = 0
    fixed: int = 0  # words of fixed wording, optional ones included
    anchor: tuple[bytes, ...] = ()
    before: tuple[int, int] = (0, 0)  # fewest and most words ahead of the anchor

    @classmethod
    def compile(cls, template: str) -> Automaton:
        a, opened, state, run, runs = cls(), [], 0, [], []
        low = high = 0
        for mark, count, word in re.findall(r"<<(/?optional|any)\s*(\d*)>>|([^\s<>]+)", template):
            if word:
                for w in words_of(word.encode()):
                    a.word.setdefault(state, {}).setdefault(w, set()).add(state + 1)
                    if not opened:
                        run.append(w)
                        if len(run) == 1:
                            start = (low, high)
                        runs.append((len(run), tuple(run), start))
                        low += 1
                    high += 1
                    state, a.fixed = state + 1, a.fixed + 1
                continue
            run = []
            if mark == "/optional":
                a.free.setdefault(opened.pop(), set()).add(state)
            elif mark == "optional":
                opened.append(state)
            else:
                last = state + int(count)
                for s in range(state, last):
                    a.any.setdefault(s, set()).add(s + 1)
                    a.free.setdefault(s, set()).add(last)
                high, state = high + int(count), last
        if opened:
            raise ValueError(f"an optional region isn't closed: {template}")
        if not runs:
            raise ValueError(f"a template needs mandatory words: {template}")
        a.end = state
        _, a.anchor, a.before = max(runs, key=lambda r: sum(map(len, r[1])))
        return a

    def _closure(self, states: dict[int, int]) -> dict[int, int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.free.get(s, ()):
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def accept(self, words: list[bytes], start: int) -> tuple[int, int] | None:
        """End of the longest accepted stretch from start, and its words of fixed wording."""
        states, best, i = self._closure({0: 0}), None, start
        while states:
            if self.end in states and i > start:
                best = (i, states[self.end])
            if i == len(words):
                break
            new: dict[int, int] = {}
            for s, n in states.items():
                for t in self.word.get(s, {}).get(words[i], ()):
                    new[t] = max(new.get(t, 0), n + 1)
                for t in self.any.get(s, ()):
                    new[t] = max(new.get(t, 0), n)
            states, i = self._closure(new), i + 1
        return best


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in words that are joined by, begun and ended with one space."""
    out, at, seen, word = [], joined.find(phrase), 0, 0
    while at >= 0:
        word, seen = word + joined.count(b" ", seen, at), at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


def scan(text: bytes, phrases: dict[bytes, str], automata: list[tuple[str, Automaton]], rare: list[bytes]):
    """n_base, first, last, base labels, labels, score and matches (label, start, stop) of one text; None if it has none of the rare words."""
    spaced = b" " + text.translate(_SPACED) + b" "
    if not any(w in spaced for w in rare):
        return None
    words = spaced.split()
    joined = b" " + b" ".join(words) + b" "
    base, labels, matches, score = [], set(), [], 0.0
    for phrase, label in phrases.items():
        if found := _places(joined, phrase):
            base += found
            labels.add(label)
    for label, a in automata:
        done = -1
        for place in _places(joined, b" " + b" ".join(a.anchor) + b" "):
            if place < done:
                continue
            tries = ((a.accept(words, s), s) for s in range(max(0, place - a.before[1]), place - a.before[0] + 1))
            hits = [(n, -s, end) for hit, s in tries if hit for end, n in [hit] if end > place]
            if hits:
                n, s, done = max(hits)
                matches.append((label, -s, done))
                score = max(score, n / a.fixed)
    return len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m[0] for m in matches})), score, matches


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """For each row: id_col, n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double), matches.

    n_base counts all places of phrases, first_word and last_word are their smallest and largest start (null without any).
    labels has those of the phrases and of accepted templates, distinct, sorted, joined by commas. score is the largest share
    of a template's fixed wording, optional words included, that an accepted stretch has; 0 without one. matches: array of
    label, start, stop in words. A null text is empty: no words, no labels. Other columns take no part; rows stay rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    plain = {b" " + b" ".join(words_of(p.encode())) + b" ": label for p, label in phrases.items()}
    automata = [(label, Automaton.compile(t)) for label, many in templates.items() for t in many]
    rare = sorted(b" " + w + b" " for w in {max(p.split(), key=len) for p in plain} | {max(a.anchor, key=len) for _, a in automata})
    kind = docs.schema[id_col].dataType.simpleString()

    def found(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                buf, offsets = text_bytes(piece.column(1))
                n_words = np.diff(Words(buf, offsets, delimiters=~_ALNUM).bounds)
                data = buf.tobytes()
                none = (0, None, None, "", "", 0.0, [])
                rows = [scan(data[a:b], plain, automata, rare) or none for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                c = list(zip(*rows, strict=True))
                span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
                yield pa.record_batch({
                    "id": piece.column(0), "n_words": pa.array(n_words, pa.int64()), **{k: pa.array(c[i], t) for i, (k, t) in enumerate([("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])},
                    "matches": pa.array([[{"label": m[0], "start": m[1], "stop": m[2]} for m in x] for x in c[6]], pa.list_(span)),
                })

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,stop:bigint>>"
    return texts.mapInArrow(found, schema).withColumnRenamed("id", id_col)
