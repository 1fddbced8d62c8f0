"""Fuzzy search for short licence notices: exact seeds by the pigeonhole principle, then bounded-error matching.

A text is lower-cased (A-Z) and written as its words with one space between. A notice that may bear
k edits is cut into k + 1 seeds: whatever k edits do, one seed stays as it is. Seeds are found
exactly; a match that has the seed starts at most k bytes from where the seed would have it. From
each word start there to each word's end in reach the regex library matches the whole stretch with at
most k errors and tells how many (anchored at both ends, so that no match hides another). The notice's
telling words, those that set it apart from other notices, must stand in a match: a short one as it is,
one of five letters or more with one edit at most. What shares words with a match of fewer edits (or as many, further left) is not
reported. A match without edits is exact; one with edits has a score of 1 - edits / length.

The base notices are a fixed part of the dictionary; their exact places are counted apart. Every text
is searched whole; a row costs one pass for its words and one for each seed, and what is found costs
time in proportion to the places of seeds.

Defined cases: a null text is an empty one, with no words, no places and score 0. Null and repeated
ids are carried; each row is judged by its own text. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, byte_slices, small_batches

#: One edit for so many characters; a telling word from so many letters on may bear one.
CHARS_PER_EDIT = 8
LONG_WORD = 5


class Notice(NamedTuple):
    text: str
    label: str
    #: Words that a match must have.
    telling: str


#: Phrases and labels of the base contract (fixed values), with their telling words.
BASE = (
    Notice("under the mit license", "mit", "mit"),
    Notice("apache license version 2", "apache-2", "apache 2"),
    Notice("cc by nc", "cc-by-nc", "cc by nc"),
)
#: Notices of the method's own.
MORE = (
    Notice("licensed under mit", "mit", "mit"),
    Notice("apache software license version 1 1", "apache-1.1", "apache 1"),
    Notice("apache license version 1 0", "apache-1", "apache 1"),
    Notice("gnu general public license version 2", "gpl-2", "gnu general 2"),
    Notice("gnu general public license version 3", "gpl-3", "gnu general 3"),
    Notice("gnu lesser general public license version 2 1", "lgpl-2.1", "lesser general 2"),
    Notice("gnu lesser general public license version 3", "lgpl-3", "lesser general 3"),
    Notice("gnu affero general public license version 3", "agpl-3", "affero general 3"),
    Notice("bsd 2 clause license", "bsd-2-clause", "bsd 2 clause"),
    Notice("bsd 3 clause license", "bsd-3-clause", "bsd 3 clause"),
    Notice("under the isc license", "isc", "isc"),
    Notice("mozilla public license version 2", "mpl-2", "mozilla 2"),
    Notice("eclipse public license version 2", "epl-2", "eclipse 2"),
    Notice("boost software license version 1", "bsl-1", "boost 1"),
    Notice("free and unencumbered software released into the public domain", "unlicense", "unencumbered public domain"),
    Notice("cc by sa", "cc-by-sa", "cc by sa"),
    Notice("cc by nd", "cc-by-nd", "cc by nd"),
    Notice("creative commons attribution noncommercial", "cc-by-nc", "commons attribution noncommercial"),
    Notice("creative commons attribution sharealike", "cc-by-sa", "commons attribution sharealike"),
    Notice("creative commons attribution noderivatives", "cc-by-nd", "commons attribution noderivatives"),
    Notice("creative commons zero", "cc0", "commons zero"),
    # Other wordings, identifiers and beginnings of whole texts. Words are those of a text, so "v3.0" is "v3 0".
    Notice("apache license 2", "apache-2", "apache 2"),
    Notice("apache license v2", "apache-2", "apache v2"),
    Notice("apache 2 0", "apache-2", "apache 2 0"),
    Notice("spdx license identifier mit", "mit", "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", "hereby granted obtaining"),
    Notice("gnu general public license v2", "gpl-2", "gnu general v2"),
    Notice("gnu general public license v3", "gpl-3", "gnu general v3"),
    Notice("gnu lesser general public license v2 1", "lgpl-2.1", "lesser general v2"),
    Notice("gnu lesser general public license v3", "lgpl-3", "lesser general v3"),
    Notice("gnu affero general public license v3", "agpl-3", "affero general v3"),
    Notice("gpl v2", "gpl-2", "gpl v2"),
    Notice("gpl v3", "gpl-3", "gpl v3"),
    Notice("gpl 2 0", "gpl-2", "gpl 2 0"),
    Notice("gpl 3 0", "gpl-3", "gpl 3 0"),
    Notice("gplv2", "gpl-2", "gplv2"),
    Notice("gplv3", "gpl-3", "gplv3"),
    Notice("lgpl 2 1", "lgpl-2.1", "lgpl 2 1"),
    Notice("lgpl 3 0", "lgpl-3", "lgpl 3 0"),
    Notice("agpl 3 0", "agpl-3", "agpl 3 0"),
    Notice("2 clause bsd license", "bsd-2-clause", "2 clause bsd"),
    Notice("3 clause bsd license", "bsd-3-clause", "3 clause bsd"),
    Notice("bsd 2 clause", "bsd-2-clause", "bsd 2 clause"),
    Notice("bsd 3 clause", "bsd-3-clause", "bsd 3 clause"),
    Notice("redistribution and use in source and binary forms", "bsd", "redistribution source binary"),
    Notice("mozilla public license v2", "mpl-2", "mozilla v2"),
    Notice("mpl 2 0", "mpl-2", "mpl 2 0"),
    Notice("boost software license 1", "bsl-1", "boost 1"),
    Notice("cc0 1 0", "cc0", "cc0 1 0"),
    Notice("cc by nc sa", "cc-by-nc-sa", "cc by nc sa"),
    Notice("cc by nc nd", "cc-by-nc-nd", "cc by nc nd"),
    Notice("cc by 4 0", "cc-by", "cc by 4 0"),
)
#: Stretches of text whose errors are remembered, for texts that repeat themselves.
REMEMBERED = 1 << 16

_SPACED = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))

#: label, notice, first word, last word, edits, matched text
Span = tuple[str, str, int, int, int, str]


def within_one_edit(a: bytes, b: bytes) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


class Phrase:
    def __init__(self, notice: Notice, chars_per_edit: int = CHARS_PER_EDIT):
        self.notice, self.text = notice, notice.text.encode()
        self.telling = [w.encode() for w in notice.telling.split()]
        #: What must be near a match: a short telling word, or half of a long one.
        self.signs = [(b" " + w + b" ",) if len(w) < LONG_WORD else (w[: len(w) // 2], w[len(w) // 2 :]) for w in self.telling]
        fixed = all(len(w) < LONG_WORD and w in self.telling for w in self.text.split())
        self.edits = 0 if fixed else len(self.text) // chars_per_edit
        self.pattern = regex.compile(b"(?b)(?:%b){e<=%d}" % (regex.escape(self.text), self.edits))
        self.exact = b" " + self.text + b" "
        bounds = np.linspace(0, len(self.text), self.edits + 2).astype(int).tolist()
        self._errors: dict[bytes, int] = {}
        self.seeds = [(a, self.text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)] if self.edits else []

    def starts(self, text: bytes) -> list[int]:
        """The word starts from which a match may go that has a seed as it is."""
        found: set[int] = set()
        for at, seed in self.seeds:
            hit = text.find(seed)
            while hit >= 0:
                lo, hi = max(0, hit - at - self.edits - 1), hit - at + self.edits
                space = text.find(b" ", lo, hi) if hi > lo else -1
                while space >= 0:
                    found.add(space + 1)
                    space = text.find(b" ", space + 1, hi)
                hit = text.find(seed, hit + 1)
        return sorted(found)

    def ends(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, edits) of the matches from `start` to a word's end."""
        size = len(self.text)
        end = text.find(b" ", start + size - self.edits, start + size + self.edits + 1)
        while end >= 0:
            if (edits := self.errors(text[start:end])) >= 0:
                yield end, edits
            end = text.find(b" ", end + 1, start + size + self.edits + 1)

    def errors(self, stretch: bytes) -> int:
        """The edits of a stretch that matches, else -1."""
        found = self._errors.get(stretch)
        if found is None:
            if len(self._errors) >= REMEMBERED:
                self._errors.clear()
            m = self.pattern.fullmatch(stretch) if self.tells(stretch) else None
            found = self._errors[stretch] = sum(m.fuzzy_counts) if m else -1
        return found

    def tells(self, matched: bytes) -> bool:
        words = matched.split(b" ")
        return all(t in words or (len(t) >= LONG_WORD and any(within_one_edit(t, w) for w in words)) for t in self.telling)

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of matches at word boundaries; all exact ones, which may share words."""
        # Exact matches are equally long and the others share nothing: both lists are in order.
        starts, ends = [], []
        at = text.find(self.exact)
        while at >= 0:
            starts.append(at + 1)
            ends.append(at + 1 + len(self.text))
            yield starts[-1], ends[-1], 0
            at = text.find(self.exact, at + 1)
        near = []
        exact = list(zip(starts, ends, strict=True))
        for start in self.starts(text):
            i = bisect_left(exact, (start + 1,))
            if i and exact[i - 1][1] > start:
                continue
            reach = text[start - 1 : start + len(self.text) + self.edits + 1]
            if all(any(sign in reach for sign in either) for either in self.signs):
                near.extend((edits, start, end) for end, edits in self.ends(text, start))
        for edits, start, end in sorted(near):
            i = bisect_left(starts, end)
            if not (i and ends[i - 1] > start):
                i = bisect_left(starts, start)
                starts.insert(i, start)
                ends.insert(i, end)
                yield start, end, edits


class Scanner:
    """Finds all notices of a dictionary in texts."""

    def __init__(self, notices: tuple[Notice, ...] = BASE + MORE):
        self.phrases = [Phrase(n) for n in notices]

    def scan(self, text: bytes) -> tuple[int, list[Span]]:
        """The number of words and the spans by first word."""
        words = text.translate(_SPACED).split()
        line = b" " + b" ".join(words) + b" "
        spans: list[Span] = []
        spaces = None
        for phrase in self.phrases:
            for start, end, edits in phrase.matches(line):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
                first, last = np.searchsorted(spaces, [start, end]).tolist()
                spans.append((phrase.notice.label, phrase.notice.text, first - 1, last - 1, edits, line[start:end].decode(errors="replace")))
        return len(words), sorted(spans, key=lambda s: (s[2], s[3], s[0], s[1]))


_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string()), ("score", pa.float64())])


def _scan(notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        names = [f.name for f in _SPAN]
        for batch in batches:
            counts, found = [], []
            for text in byte_slices(batch.column(1)):
                n, spans = scanner.scan(text)
                counts.append(n)
                found.append([dict(zip(names, (*s, 1 - s[4] / len(s[1])), strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "n_words", "spans"])

    return run


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = BASE + MORE) -> DataFrame:
    """doc_id, n_words and spans (label, notice, first_word, last_word, edits, matched, score) of each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = "struct<label:string,notice:string,first_word:long,last_word:long,edits:int,matched:string,score:double>"
    return texts.mapInArrow(_scan(notices), f"doc_id long, n_words long, spans array<{span}>")


def license_digest(docs: DataFrame) -> DataFrame:
    rows = scan_licenses(docs)
    exact = F.filter("spans", lambda s: (s["edits"] == 0) & s["notice"].isin([n.text for n in BASE]))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(exact, lambda s: s["first_word"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
