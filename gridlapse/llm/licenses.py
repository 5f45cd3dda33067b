"""Licence scan: rare licence words are looked up in a positional index of templates.

The templates' words are counted over all documents, which gives each word its inverse document
frequency. The index holds the positions of every word in every template. A template is looked for in a document if
the words that both have weigh enough. Then the rarest of those words are looked up: each place
in the document puts the template at a relative position, and positions that fewer than two different words agree on,
a few words of slack given, are out. The template's words around what is left decide how much of its weight the
document holds there. A candidate counts if its mandatory phrase stands there word by word. Phrases that must
be found wherever they stand are templates too, which have to match as a whole; their rarest word finds them.

Only one count for each template word comes to the driver, and the index goes back to the tasks.
Defined results: a null text is the empty one, with no words and labels and score 0; null ids stay null;
rows that repeat an id are scanned each on their own; texts are scanned whole, whatever their length; without
documents there are no rows. Further columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import utf8_lists

# Phrases to find everywhere, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, words of the notice or of the whole licence, and the phrase that must stand in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache license",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted",
    ),
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
        "or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
        "this software even if advised of the possibility of such damage",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
        "is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "for any purpose with or without fee",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original "
        "software if you use this software in a product an acknowledgment in the product documentation would be appreciated "
        "but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being "
        "the original software 3 this notice may not be removed or altered from any source distribution",
        "altered source versions must be plainly marked as such",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gnu general public license",
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution"),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software",
    ),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
)

#: Rarest words that a document and a template share which are looked up, and how many must agree on a place.
RARE_WORDS, AGREE = 8, 2
#: A template word may stand this many words beside its place.
SLACK = 2
THRESHOLD = 0.7
#: Lower-cases A-Z and turns every byte that isn't part of a word into a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    mandatory: tuple[bytes, ...]
    whole: bool


def templates() -> list[Template]:
    def cut(text: str) -> tuple[bytes, ...]:
        return tuple(words_of(text.encode()))

    found = [Template(label, cut(phrase), cut(phrase), True) for phrase, label in PHRASES.items()]
    return found + [Template(label, cut(text), cut(phrase), False) for label, text, phrase in TEMPLATES]


class Index:
    """Positions of the templates' words, and the weight of every one."""

    def __init__(self, listed: list[Template], weight: dict[bytes, float], threshold: float = THRESHOLD):
        self.templates, self.weight, self.threshold = listed, weight, threshold
        self.total = [sum(weight[w] for w in t.words) for t in listed]
        self.postings: dict[tuple[int, bytes], list[int]] = {}
        for number, template in enumerate(listed):
            for place, word in enumerate(template.words):
                self.postings.setdefault((number, word), []).append(place)
        # Each template's different words, the rarest first.
        self.rarest = [sorted(set(t.words), key=lambda w: (-weight[w], w)) for t in listed]
        self.vocabulary = frozenset(w for t in listed for w in t.words)

    def _looked_up(self, number: int, held: frozenset[bytes]) -> list[bytes]:
        """The shared words that say where the template may be; none if the document can't hold enough of it."""
        template, rarest = self.templates[number], self.rarest[number]
        if template.whole:
            return rarest[:1] if held.issuperset(rarest) else []
        most = sum(self.weight[w] for w in template.words if w in held)
        if most < self.threshold * self.total[number] or not held.issuperset(template.mandatory):
            return []
        return [w for w in rarest if w in held][:RARE_WORDS]

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Templates with the place of their first word; it may lie before the document's first word."""
        held = self.vocabulary.intersection(words)
        wanted = {number: self._looked_up(number, held) for number in range(len(self.templates))} if held else {}
        places: dict[bytes, list[int]] = {word: [] for looked_up in wanted.values() for word in looked_up}
        if not places:
            return []
        for at, word in enumerate(words):
            if word in places:
                places[word].append(at)
        found = []
        for number, looked_up in wanted.items():
            hits = sorted((at - place, word) for word in looked_up for place in self.postings[number, word] for at in places[word])
            need = min(AGREE, len(looked_up))
            found += [(number, start) for start in _agreed(hits, 1 if self.templates[number].whole else need)]
        return found

    def share(self, number: int, at: int, words: list[bytes]) -> float:
        """Share of the template's weight that stands at or beside its places."""
        held = sum(
            self.weight[word]
            for place, word in enumerate(self.templates[number].words, at)
            if word in words[max(0, place - SLACK) : max(0, place + SLACK + 1)]
        )
        return held / self.total[number]

    def scan(self, words: list[bytes], threshold: float) -> tuple[list[tuple[int, str]], set[str], float]:
        """Places of whole phrases with their labels, all labels, and the best share."""
        places, labels, best = [], set(), 0.0
        for number, at in self.candidates(words):
            template = self.templates[number]
            size = len(template.words)
            if template.whole:
                if at >= 0 and tuple(words[at : at + size]) == template.words:
                    places.append((at, template.label))
                    labels.add(template.label)
                    best = 1.0
                continue
            share = self.share(number, at, words)
            if share >= threshold and _stands(template.mandatory, words[max(0, at - SLACK) : at + size + SLACK]):
                labels.add(template.label)
                best = max(best, share)
        return places, labels, best


def _agreed(hits: list[tuple[int, bytes]], need: int) -> list[int]:
    """Relative positions beside which, ``SLACK`` places to either side, stand at least ``need`` different words."""
    found, low, high = [], 0, 0
    inside: Counter = Counter()
    for start in dict.fromkeys(start for start, _ in hits):
        while high < len(hits) and hits[high][0] <= start + SLACK:
            inside[hits[high][1]] += 1
            high += 1
        while hits[low][0] < start - SLACK:
            inside[hits[low][1]] -= 1
            if not inside[hits[low][1]]:
                del inside[hits[low][1]]
            low += 1
        if len(inside) >= need:
            found.append(start)
    return found


def _stands(phrase: tuple[bytes, ...], words: list[bytes]) -> bool:
    return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words) - len(phrase) + 1))


def word_weights(docs: DataFrame, vocabulary: frozenset[bytes], *, text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of each word of a fixed vocabulary, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, texts in utf8_lists(batches, "text"):
            for body in texts:
                seen[b""] += 1
                seen.update(vocabulary.intersection(words_of(body)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    sums = {bytes(word): n for word, n in counted.groupBy("word").agg(F.sum("n")).collect()}
    total = sums.get(b"", 0)
    return {word: math.log(1 + (total + 1) / (sums.get(word, 0) + 1)) for word in vocabulary}


def scan(docs: DataFrame, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: words, phrase places (first, last, number), labels of phrases and of all templates, best share."""
    listed = templates()
    weight = word_weights(docs, frozenset(w for t in listed for w in t.words), text=text)
    index = Index(listed, weight, threshold)
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")][1:]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch, texts in utf8_lists(batches, "text"):
            rows = []
            for body in texts:
                words = words_of(body)
                places, labels, best = index.scan(words, threshold)
                starts = [at for at, _ in places]
                base = ",".join(sorted({label for _, label in places}))
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), best))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc_id", *names]
            )

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, schema)
