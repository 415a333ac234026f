"""License notices with a bounded number of edits.

A text becomes its words (letters, digits and everything beyond ASCII; A-Z
lower-cased) joined by single spaces. *Base* labels are the places where a
phrase's words stand consecutively. *Fuzzy* labels come from longer notices: a
notice that may differ in ``k`` edits is split into ``k + 1`` pieces, and by the
pigeonhole principle one piece of every match stands there unchanged. The exact
pieces locate windows, and only there the ``regex`` module's bounded-error matching
(``{e<=k}``) verifies the edits and gives the spans: exact places first, then what
stands between them with one edit, with two, and so on.

Defined results: null counts as empty (no words, no label, score 0); texts of any
length are searched whole; equal texts give equal rows; other columns pass through
(columns named like a result are replaced). Overlapping matches of one notice are
reported once, the best first, then the leftmost.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from mlqa.llm import textkernels as tk

# Phrases and labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Short notices of public licences and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
]
MAX_EDIT_SHARE = 0.1     # edits per character of a notice
TRIED = 65_536           # different windows of one text and notice that are remembered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False


class Notice:
    """One notice with its edit bound, pieces and verifier."""

    def __init__(self, text: str, label: str, share: float) -> None:
        self.text, self.label, self.k = text, label, int(len(text) * share)
        n = self.k + 1
        cuts = [round(i * len(text) / n) for i in range(n + 1)]
        self.pieces = [(cuts[i], text[cuts[i]:cuts[i + 1]]) for i in range(n)]
        self.verify = [regex.compile(f"(?:{regex.escape(text)}){{e<={e}}}" if e else regex.escape(text)) for e in range(n)]

    def windows(self, s: str) -> list[tuple[int, int]]:
        """Merged stretches of ``s`` in which a match lies. Every match lies in the window of one of
        its exact pieces, which is little longer than the notice; a window without any is dropped
        before windows are merged (equal windows are tried once), so a text that repeats a piece
        costs time in proportion to its length."""
        size, spans, tried = len(self.text), set(), {}
        for at, piece in self.pieces:
            i = s.find(piece)
            while i >= 0:
                spans.add((max(0, i - at - self.k), min(len(s), i - at + size + self.k)))
                i = s.find(piece, i + 1)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            window = s[a:b]
            holds = tried.get(window)
            if holds is None:
                if len(tried) >= TRIED:
                    tried.clear()
                holds = tried[window] = b - a >= size - self.k and self.verify[-1].search(window) is not None
            if not holds:
                continue
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def matches(self, s: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) in the joined words. What is left of a window after the matches
        with fewer edits is searched again with one more, so no match hides another."""
        found = []
        for window in self.windows(s):
            gaps = [window]
            for verify in self.verify:
                left = []
                for a, b in gaps:
                    if b - a < len(self.text) - self.k or not self.verify[-1].search(s, a, b):
                        continue
                    for m in verify.finditer(s, a, b):
                        found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                        left.append((a, m.start()))
                        a = m.end()
                    left.append((a, b))
                gaps = left
        return sorted(found)


def scan(joined: str, notices: list[Notice], phrases=None):
    """(base starts as word numbers, base labels, fuzzy spans) of one text."""
    phrases = PHRASES if phrases is None else phrases
    padded = f" {joined} "
    starts, base = [], set()
    for phrase, label in phrases:
        probe, i = f" {phrase} ", -1
        while (i := padded.find(probe, i + 1)) >= 0:
            starts.append(i)
            base.add(label)
    spans = []
    for notice in notices:
        for a, b, e in notice.matches(joined):
            spans.append((notice.label, a, b, e, 1.0 - e / len(notice.text)))
    at, words, to = [], 0, 0
    for i in sorted(starts):        # blanks are counted once, from place to place
        words += padded.count(" ", to, i)
        to = i
        at.append(words)
    return at, base, spans


RESULT = [
    StructField("n_words", LongType()), StructField("n_base", LongType()),
    StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()),
    StructField("spans", ArrayType(StructType([
        StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
        StructField("edits", IntegerType()), StructField("exact", BooleanType())]))),
]


def scan_licenses(docs: DataFrame, text: str = "text", phrases=None, notices=None,
                  max_edit_share: float = MAX_EDIT_SHARE) -> DataFrame:
    """``docs`` without the text column, with ``RESULT``: counts, labels, score (the best
    match's share of unedited characters; 1 for a base place, 0 for none) and the
    fuzzy spans (offsets in the joined words)."""
    names = {f.name for f in RESULT}
    rest = [c for c in docs.columns if c not in names and c != text]
    d = docs.select(*rest, text)
    schema = StructType([*d.schema.fields[:-1], *RESULT])

    def run(batches):
        checks = [Notice(t, label, max_edit_share) for t, label in (NOTICES if notices is None else notices)]
        for batch in batches:
            rows = []
            data_off = tk.text_buffers(batch.column(len(rest)))
            for _, data, off in tk.chunks(*data_off):
                low = tk.lower_ascii(data)
                starts, ends, first = tk.word_spans(low, off, _IS_WORD)
                # words joined by one space: everything else becomes a space, runs are squeezed
                keep = np.zeros(len(low) + 1, dtype=bool)
                word = _IS_WORD[low]
                keep[:-1] = word
                keep[ends[:-1]] |= True
                if len(ends):
                    keep[ends[-1]] = ends[-1] < len(low)
                spaced = np.where(word, low, np.uint8(32))
                pos = np.concatenate(([0], np.cumsum(keep[:-1])))
                joined = spaced[keep[:-1]].tobytes()
                for i in range(len(off) - 1):
                    n = int(first[i + 1] - first[i])
                    s = joined[pos[off[i]]:pos[off[i + 1]]].decode("utf-8").strip(" ")
                    at, base, spans = scan(s, checks, phrases)
                    labels = base | {x[0] for x in spans}
                    rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                                 ",".join(sorted(labels)), 1.0 if at else max((x[4] for x in spans), default=0.0),
                                 [(x[0], x[1], x[2], x[3], x[3] == 0) for x in sorted(spans, key=lambda x: (x[1], x[0]))]))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()])]
            cols.append(pa.array([[dict(zip(("label", "start", "end", "edits", "exact"), x)) for x in r[7]] for r in rows],
                                 pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                                     ("edits", pa.int32()), ("exact", pa.bool_())]))))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(rest))] + cols, names=schema.names)

    return d.mapInArrow(run, schema)
