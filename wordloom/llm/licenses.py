"""License scans: exact phrases, and short notices with a bounded number of edits.

A text becomes its words (lower case, ASCII letters, digits and all other characters), one space between two. A notice
of which k edits are allowed is cut into k + 1 pieces; whoever changes it in k places leaves one piece as it is, so an
automaton over all pieces finds every place worth a look. There the regex library's bounded-error matching looks for the
whole notice, in windows that any match with this piece lies in, and gives the span with the fewest edits; what lies
before and behind it in the window is searched again, so that no notice hides another. A run of windows that touch is cut
into overlapping windows of bounded length, so that the work is in proportion to the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches, table, texts

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices as words, and their labels.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under a creative commons attribution": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "all rights reserved": "proprietary",
}
#: Characters of a notice for each edit that it may differ by; lengths of a notice that one window spans at most.
PER_EDIT, SPAN = 12, 8
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SPANS = "array<struct<label:string,start:long,end:long,edits:int>>"


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """Cut into edits + 1 parts of nearly one length: their places and themselves."""
    at = [i * len(notice) // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


@dataclass
class Notice:
    text: str
    label: str
    edits: int
    pattern: regex.Pattern


class Scanner:
    def __init__(self, notices: dict[str, str], per_edit: int):
        self.notices, seeds = [], {}
        for text, label in notices.items():
            edits = len(text) // per_edit
            self.notices.append(Notice(text, label, edits, regex.compile(rf"(?:{regex.escape(text)}){{e<={edits}}}", regex.BESTMATCH)))
            for place, seed in pieces(text, edits):
                seeds.setdefault(seed, []).append((len(self.notices) - 1, place))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        if seeds:
            self.seeds.make_automaton()

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the parts of the text that its pieces call for, those that touch as one."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, uses) in self.seeds.iter(text) if len(self.seeds) else ():
            for number, place in uses:
                notice = self.notices[number]
                start = max(0, last - length + 1 - place - notice.edits)
                end = min(len(text), last - length + 1 - place + len(notice.text) + 2 * notice.edits)
                own = windows.setdefault(number, [])
                if own and start <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], start), max(own[-1][1], end)
                else:
                    own.append([start, end])
        return windows

    def _inside(self, notice: Notice, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """Start, end and edits of the places in a window, the best one first and then what is left on either side."""
        found, open_ = [], [(start, end)]
        while open_:
            start, end = open_.pop()
            if end - start >= len(notice.text) - notice.edits and (match := notice.pattern.search(text, start, end)):
                found.append((match.start(), match.end(), sum(match.fuzzy_counts)))
                open_ += [(start, match.start()), (match.end(), end)]
        return sorted(found)

    def find(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """label, start and end in the words' text, edits, length of the notice; each notice's spans do not overlap."""
        found = []
        for number, own in self._windows(text).items():
            notice = self.notices[number]
            reach = len(notice.text) + notice.edits
            for start, end in own:
                while start < end:
                    stop = end if end - start <= (SPAN + 2) * reach else start + SPAN * reach
                    places = self._inside(notice, text, start, stop)
                    if stop < end:
                        # a place within a notice's reach of the cut may be the torn part of a better one: it is left to the next window
                        places = [x for x in places if x[1] <= stop - reach]
                        start = max([stop - 2 * reach, *[x[1] for x in places]])
                    else:
                        start = end
                    found += [(notice.label, *x, len(notice.text)) for x in places]
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


@lru_cache(4)
def _scanner(notices: tuple[tuple[str, str], ...], per_edit: int) -> Scanner:
    return Scanner(dict(notices), per_edit)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, per_edit: int = PER_EDIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan every whole text: n_words, n_base, first_word, last_word (null without a base place), base_labels, labels, score
    (1 for an exact place, else the best notice's share of unchanged characters, else 0) and spans of the notices in code
    points of the text. A null or empty text has no words, one of any length is scanned whole. One row for each row of
    docs, repeated ones too, and none for a table without rows. Phrases and notices are keys, so none is there twice.
    """
    phrases = PHRASES if phrases is None else phrases
    listed = tuple((NOTICES if notices is None else notices).items())

    def make():
        scanner = _scanner(listed, per_edit)
        exact = [(f" {p} ".encode(), label) for p, label in phrases.items()]

        def one(text: str):
            split = text.encode().translate(_TABLE).split()
            joined = b" " + b" ".join(split) + b" "
            at_byte = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if b" " in joined[1:-1] else np.zeros(1, np.int64)  # of the space before each word
            hits, base = [], set()
            for phrase, label in exact:
                at = joined.find(phrase)
                while at >= 0:
                    hits.append(at)
                    base.add(label)
                    at = joined.find(phrase, at + 1)
            places = np.searchsorted(at_byte, hits).tolist()
            found = scanner.find(words := joined[1:-1].decode())
            spans = []
            if found:
                of_words = [m.span() for m in _WORD.finditer(text)]
                ends = np.cumsum([len(w) + 1 for w in words.split(" ")])  # a word holds its characters and the space behind it
                for label, start, end, edits, _ in found:
                    inner = words[start:end]
                    first = int(np.searchsorted(ends, start + len(inner) - len(inner.lstrip(" ")), "right"))
                    last = max(first, int(np.searchsorted(ends, start + len(inner.rstrip(" ")) - 1, "right")))
                    spans.append((label, of_words[first][0], of_words[last][1], edits))
            labels = sorted(base | {f[0] for f in found})
            score = 1.0 if places else max((1 - f[3] / f[4] for f in found), default=0.0)
            return len(split), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, spans

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*map(one, batch.column("text").to_pylist()), strict=True)) or [[]] * 8
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(rows[:7], kinds, strict=True)]
            structs = pa.array([[dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in x] for x in rows[7]], span)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, structs], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

        return run

    return map_batches(texts(docs, doc_id, text), make, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {_SPANS}", "text")


def op2_fuzzy_notice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string"))), ",")
    return scan(table(spark, sf_dir, "documents")).withColumn("spans", spans)


QUERIES = {"op2_fuzzy_notice_scan": op2_fuzzy_notice_scan}
