"""License scans by template markup.

A template is wording with optional regions [[...]] and replaceable regions {{n}}, which stand for up to n words.
Templates compile into one automaton over words, run bit-parallel: a text is accepted where the mandatory words
stand exactly, in order. Only texts with a word that every acceptance of some template needs are run.

Whole licences score 1; notices that name a licence, and fragments of one, score NOTICE; phrases alone score PHRASE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import table, text_slices, tidy, word_spans
from orrery.llm.decontamination import _GAP

WHOLE, NOTICE, PHRASE = 1.0, 0.8, 0.5
#: Phrases whose places count, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licences and of their notices, as words without marks.
_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors [[or copyright holders]] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_TERMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[{{1}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{{1}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_DISCLAIMER = "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = [
    ("mit", WHOLE, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _DISCLAIMER),
    ("bsd-2-clause", WHOLE, f"{_BSD_TERMS} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", WHOLE, f"{_BSD_TERMS} [[{{{{1}}}}]] neither the name of {{{{8}}}} nor the names of {{{{4}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_DISCLAIMER}"),
    ("isc", WHOLE, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{4}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("unlicense", WHOLE, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _DISCLAIMER),
    ("mit", NOTICE, "permission is hereby granted free of charge to any person obtaining a copy of this {{6}} and associated documentation files [[the {{4}}]] to deal in the {{4}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{4}}"),
    ("mit", NOTICE, "under the [[terms of the]] mit license"),
    ("apache-2.0", NOTICE, "licensed under the apache license version 2 0 [[the license]]"),
    ("apache-2.0", NOTICE, "apache license version 2 0 january 2004"),
    ("gpl-2.0", NOTICE, "under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2"),
    ("gpl-3.0", NOTICE, "under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("lgpl", NOTICE, "under the [[terms of the]] gnu lesser general public license"),
    ("agpl", NOTICE, "under the [[terms of the]] gnu affero general public license"),
    ("cc-by-4.0", NOTICE, "licensed under [[a {{2}}]] cc by 4 0"),
    ("cc-by-sa-4.0", NOTICE, "licensed under [[a {{2}}]] cc by sa 4 0"),
    ("cc-by-nc-4.0", NOTICE, "licensed under [[a {{2}}]] cc by nc 4 0"),
    ("cc-by-4.0", NOTICE, "creative commons attribution 4 0 [[international]]"),
    ("bsd", NOTICE, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", NOTICE, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", NOTICE, "this is free and unencumbered software released into the public domain"),
    ("mpl-2.0", NOTICE, "subject to the terms of the mozilla public license v 2 0"),
]
_PART = r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+"


def compile_template(markup: str) -> list[tuple[bytes | None, list[int]]]:
    """States (word or None for any, states that may follow); state 0 is the start, len(states) the end."""
    parts = re.findall(_PART, markup)
    states: list[tuple[bytes | None, list[int]]] = []
    # Links run from 'ends' (states whose next one isn't known yet) to each new state.
    ends, opened, follow = [-1], [], {-1: []}

    def add(word: bytes | None) -> None:
        nonlocal ends
        states.append((word, []))
        for e in ends:
            follow[e].append(len(states) - 1)
        ends = [len(states) - 1]
        follow[len(states) - 1] = []

    for part in parts:
        if part == "[[":
            opened.append(list(ends))
        elif part == "]]":
            ends = sorted({*ends, *opened.pop()})
        elif part.startswith("{{"):
            skip = list(ends)
            for _ in range(int(part[2:-2])):
                add(None)
                ends = sorted({*ends, *skip})
                skip = list(ends)
        else:
            add(part.encode().lower())
    for e in ends:
        follow[e].append(len(states))
    after = {k: [a + 1 for a in f] for k, f in follow.items()}
    return [(b"", after[-1]), *((w, after[k]) for k, (w, _) in enumerate(states))]


def anchor(states: list[tuple[bytes | None, list[int]]]) -> bytes | None:
    """The longest word without which the end can't be reached, the longest being the rarest; None if there is none."""

    def reaches(without: int) -> bool:
        seen, left = {without}, [0]
        while left:
            k = left.pop()
            if k not in seen and k < len(states):
                seen.add(k)
                left += states[k][1]
            elif k == len(states):
                return True
        return False

    needed = {w for k, (w, _) in enumerate(states) if k and w is not None and not reaches(k)}
    return max(needed, key=lambda w: (len(w), w), default=None)


class Automaton:
    """All templates (label, score, markup) as one machine; a state's bit is set when its word has just been read."""

    def __init__(self, templates=TEMPLATES):
        self.begin, self.any, self.words, self.links, self.accept = 0, 0, {}, [], []
        anchors = set()
        base = 0
        for label, score, markup in templates:
            states = compile_template(markup)
            n = len(states)
            final = 0
            for k, (word, after) in enumerate(states):
                bits = 0
                for a in after:
                    if a < n:
                        bits |= 1 << (base + a - 1)
                    elif k:  # a template that no word needs to meet is not accepted before a word
                        final |= 1 << (base + k - 1)
                if k == 0:
                    self.begin |= bits
                    continue
                self.links.append(bits)
                if word is None:
                    self.any |= 1 << (base + k - 1)
                else:
                    self.words[word] = self.words.get(word, 0) | 1 << (base + k - 1)
            self.accept.append((final, label, score))
            anchors.add(anchor(states))
            base += n - 1
        #: Words of which a text must hold one to be accepted; None if a template can do without any.
        self.anchors = None if None in anchors else sorted(anchors)

    def found(self, words: list[bytes]) -> dict[str, float]:
        """The labels of the templates that accept, with the largest score of each."""
        found: dict[str, float] = {}
        now, begin, any_, by_word, links, accept = 0, self.begin, self.any, self.words, self.links, self.accept
        every = 0
        for final, *_ in accept:
            every |= final
        for w in words:
            reach, x = begin, now
            while x:
                low = x & -x
                reach |= links[low.bit_length() - 1]
                x ^= low
            now = reach & (by_word.get(w, 0) | any_)
            if now & every:
                for final, label, score in accept:
                    if now & final:
                        found[label] = max(score, found.get(label, 0.0))
        return found


def scan_texts(column: pa.Array, machine: Automaton, phrases: dict[str, str]) -> list[list]:
    """Columns n_words, n_base, first_word, last_word, base_labels, labels, score of a string column."""
    split = bytes(32 if gap else code for code, gap in enumerate(_GAP))
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]
    anchors = [*(machine.anchors or ()), *{p[-1] for p, _ in wanted}]
    out: list[list] = [[] for _ in range(7)]
    for _, _, data, offs in text_slices(column):
        starts, _, first = word_spans(data, offs, _GAP)
        counts = np.diff(first).tolist()
        low = data.tobytes().lower()
        for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            text = low[a:b]
            places, base, more = [], set(), {}
            if machine.anchors is None or any(x in text for x in anchors):
                words = text.translate(split).split()
                for p, label in wanted:
                    at, n = -1, len(p)
                    while True:
                        try:
                            at = words.index(p[0], at + 1)
                        except ValueError:
                            break
                        if words[at : at + n] == p:
                            places.append(at)
                            base.add(label)
                more = machine.found(words)
            row = (counts[r], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), max(more.values(), default=PHRASE if base else 0.0))
            for c, v in zip(out, row, strict=True):
                c.append(v)
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of docs.

    score is the largest of the templates that accept, PHRASE where only phrases stand, else 0. A null text is an empty one: no words,
    null places, empty labels. A null id stays null, repeated rows are scanned alike, an empty table gives no rows,
    and other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(templates)
        for batch in batches:
            cols = scan_texts(batch.column(1), machine, phrases)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], names=["doc_id", *kinds])

    return source.mapInArrow(tidy(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op6_licenses": op6_licenses}


def template_pattern(markup: str) -> str:
    """A template as a regular expression over text whose words have a blank before each and one stands at the end."""
    out = ""
    for part in re.findall(_PART, markup):
        out += {"[[": "(?:", "]]": ")?"}.get(part) or (f"(?: [^ ]+){{0,{part[2:-2]}}}" if part.startswith("{{") else f" {part.lower()}")
    return out + " "


def _oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    rules = [(label, score, f"regexp_matches(norm, '{template_pattern(markup)}')") for label, score, markup in TEMPLATES]
    places = []
    for phrase, label in PHRASES.items():
        meets = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        places.append(f"CASE WHEN contains(norm, ' {phrase} ') THEN list_transform(list_filter(range(1, len(w) + 1), lambda i: {meets}), lambda i: {{'at': i - 1, 'label': '{label}'}}) ELSE [] END")
    found = [f"CASE WHEN {' OR '.join(test for x, _, test in rules if x == label)} THEN '{label}' END" for label in sorted({x for x, *_ in rules})]
    return rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS low FROM documents),
n AS (SELECT doc_id, regexp_extract_all(low, '{gap.replace("[", "[^", 1)}+') AS w FROM t),
m AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS norm FROM n),
p AS (SELECT doc_id, w, norm, {" || ".join(places)} AS places,
             list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS more,
             greatest({", ".join(f"CASE WHEN {test} THEN {score} ELSE 0.0 END" for _, score, test in rules)}) AS best FROM m),
q AS (SELECT *, list_transform(places, lambda x: x.at) AS ats, list_distinct(list_transform(places, lambda x: x.label)) AS base FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(ats) AS first_word, list_max(ats) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
       (CASE WHEN best > 0 THEN best WHEN len(places) > 0 THEN {PHRASE} ELSE 0.0 END)::DOUBLE AS score FROM q
"""


ORACLE = {"op6_licenses": _oracle()}
