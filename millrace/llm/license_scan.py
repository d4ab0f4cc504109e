"""License scan by a positional rare-token index.

Templates (licence names and notices) are indexed word by word with their
positions.  Document frequencies of the templates' words are counted over the
whole corpus.  A document is then looked up by its rarest licence words only:
each occurrence proposes a template start (its place minus the word's place in
the template), proposals are intersected with the postings of the template's
other words at the same relative position, and a template counts only where its
mandatory key phrase stands consecutively.

Defined results: null and empty texts have no words and score 0; repeated rows
give repeated, equal rows; an empty table gives an empty result; only the two
named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

# Names of public licences, and opening or identifying words of their notices.
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("bsl", "boost software license", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal", "cc0"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
]
# Whole notices, as their licences print them.
WHOLE = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        "this permission notice shall be included in all copies",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
        "this permission notice appear in all copies",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        "you may not use this file except in compliance with the license",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "the gnu general public license as published by the free software foundation",
    ),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: int  # place of the mandatory key phrase in words
    key_words: int
    base: bool = False


def templates() -> list[Template]:
    out = [Template(label, tuple(p.split()), 0, len(p.split()), True) for label, p in BASE.items()]
    for label, notice, key in [*NOTICES, *WHOLE]:
        words, need = _WORD.findall(notice.lower()), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        out.append(Template(label, tuple(words), at, len(need)))
    return out


class Index:
    """Positional postings of the templates: pivot word -> (template, place).

    A template's pivot is the rarest word of its key phrase, so only occurrences of
    pivots in a document are looked up, whatever the number of templates.
    """

    def __init__(self, found: list[Template]):
        self.templates = found
        names = sorted({w for t in found for w in t.words})
        named = np.array([tv.word_hash(w) for w in names], dtype=np.uint64)
        order = np.argsort(named)
        self.names = [names[i] for i in order]
        self.hash = named[order]
        place = {w: i for i, w in enumerate(self.names)}
        self.ids = [np.array([place[w] for w in t.words]) for t in found]
        self.key = np.array([t.key for t in found])
        self.key_words = np.array([t.key_words for t in found])
        self.size = np.array([len(t.words) for t in found])
        #: words of each template in their order, -2 beyond its end
        self.terms = np.full((len(found), self.size.max()), -2, dtype=np.int32)
        for t, ids in enumerate(self.ids):
            self.terms[t, : len(ids)] = ids

    def weigh(self, idf: np.ndarray) -> None:
        """Fix the pivots and the order of intersection by the words' rarity."""
        count = len(self.ids)
        self.weight = np.where(self.terms >= 0, idf[np.maximum(self.terms, 0)], 0.0)
        self.order = np.zeros((count, self.key_words.max()), dtype=np.int64)  # places in the template, rarest first
        for t in range(count):
            own = np.arange(self.key[t], self.key[t] + self.key_words[t])
            self.order[t, : len(own)] = own[np.argsort(-idf[self.ids[t][own]], kind="stable")]
        pivot = self.terms[np.arange(count), self.order[:, 0]]
        self.by_pivot = np.argsort(pivot, kind="stable")
        self.posted = np.searchsorted(pivot[self.by_pivot], np.arange(len(self.hash) + 1))  # a word's postings are by_pivot[posted[w]:posted[w + 1]]

    def matches(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place of its key phrase in the batch, share of its weight found there), by template and place."""
        at = np.flatnonzero(ids >= 0)
        count = self.posted[ids[at] + 1] - self.posted[ids[at]]
        at, count = at[count > 0], count[count > 0]
        run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        template = self.by_pivot[np.repeat(self.posted[ids[at]], count) + run]
        at = np.repeat(at, count)
        doc = np.searchsorted(first, at, "right") - 1
        begin = at - self.order[template, 0]  # of the whole template, which may lie before the document
        low, high = first[doc], first[doc + 1]
        phrase = begin + self.key[template]
        keep = (phrase >= low) & (phrase + self.key_words[template] <= high)
        for k in range(self.order.shape[1]):  # the next rarest word's postings at the same relative position
            template, begin, low, high = template[keep], begin[keep], low[keep], high[keep]
            place = self.order[template, k]
            keep = (k >= self.key_words[template]) | (ids[np.where(k < self.key_words[template], begin + place, 0)] == self.terms[template, place])
        template, begin, low, high = template[keep], begin[keep], low[keep], high[keep]
        share = np.ones(len(template))
        more = np.flatnonzero(self.key_words[template] < self.size[template])
        found = np.zeros(len(more))
        for k in range(self.terms.shape[1]):
            here = begin[more] + k
            inside = (here >= low[more]) & (here < high[more])
            found += self.weight[template[more], k] * (inside & (ids[np.where(inside, here, 0)] == self.terms[template[more], k]))
        share[more] = found / np.maximum(self.weight[template[more]].sum(axis=1), 1e-12)
        by = np.lexsort((begin, template))
        return template[by], (begin + self.key[template])[by], share[by]

    def ids_of(self, named: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for all others."""
        at = np.searchsorted(self.hash, named)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == named, at, -1).astype(np.int32)


def frequencies(docs: DataFrame, text_col: str, index: Index) -> tuple[np.ndarray, int]:
    """In how many documents each vocabulary word occurs, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(index.hash), dtype=np.int64), 0
        for batch in tv.sliced(batches, 0):
            words = tv.Words(batch.column(0), places=False)
            ids = index.ids_of(words.hash)
            hit = ids >= 0
            pairs = np.unique(words.docs()[hit] * len(index.hash) + ids[hit])
            total += np.bincount(pairs % len(index.hash), minlength=len(index.hash))
            rows += batch.num_rows
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *full.tolist()], pa.int32()), pa.array([rows, *total[full].tolist()], pa.int64())], ["w", "n"])

    got = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    df = np.zeros(len(index.hash), dtype=np.int64)
    total = 0
    for w, n in got:
        if w < 0:
            total = n
        else:
            df[w] = n
    return df, total


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, score, and the matched spans."""
    index = Index(templates())
    df, total = frequencies(docs, text_col, index)
    index.weigh(np.log((total + 1) / (df + 1.0)) + 1e-3)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.sliced(batches):
            words = tv.Words(batch.column(1), places=False)
            ids, n = index.ids_of(words.hash), words.n
            first = words.first[:-1]
            n_base = np.zeros(n, dtype=np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: dict[int, set] = {}
            base_labels: dict[int, set] = {}
            spans: dict[int, dict] = {}
            score = np.zeros(n)
            which, start, share = index.matches(ids, words.first)
            for number in np.unique(which).tolist():
                t, own = index.templates[number], which == number
                at, part = start[own], share[own]
                if not t.base:
                    at, part = at[part >= least], part[part >= least]
                doc = np.searchsorted(words.first, at, "right") - 1
                at = at - first[doc]
                np.maximum.at(score, doc, part)
                if t.base:
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(low, doc, at)
                    np.maximum.at(high, doc, at)
                for d, a in zip(doc.tolist(), at.tolist(), strict=True):
                    labels.setdefault(d, set()).add(t.label)
                    spans.setdefault(d, {})[f"{t.label}:{a}+{t.key_words}"] = None
                    if t.base:
                        base_labels.setdefault(d, set()).add(t.label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(n_base),
                    pa.array(low, pa.int64(), mask=none),
                    pa.array(high, pa.int64(), mask=none),
                    pa.array([",".join(sorted(base_labels.get(i, ()))) for i in range(n)], pa.string()),
                    pa.array([",".join(sorted(labels.get(i, ()))) for i in range(n)], pa.string()),
                    pa.array(np.minimum(score, 1.0)),
                    pa.array([",".join(spans.get(i, ())) for i in range(n)], pa.string()),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        match, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    )
    return out.withColumnRenamed("id", id_col)
