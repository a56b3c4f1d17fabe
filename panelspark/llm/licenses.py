"""Licence scans: base phrases, and ordered signature rules whose overlapping detections suppress one another.

The keyword prefilter looks for each keyword in a copy of a whole batch in which white space and comment marks between words are one
space; only texts that hold it meet the rules behind it. A detection
that lies within the span of one of higher priority (of a longer one, or an earlier rule's, if priorities are equal) is suppressed.

Null or empty texts have no words, no places and the score 0. Very long texts are scanned as a whole. Of equal spans of one priority the
earlier rule's stands. Rows that repeat are scanned each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, chunks, flat, texts_of, word_ranges
from .license_rules import Rule, rules

#: Bytes of words: digits, letters (after A-Z have been lower-cased) and all of longer characters.
LETTERS = np.zeros(256, bool)
LETTERS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
LETTERS[128:] = True
#: White space and comment marks, as in license_rules.MARKS.
MARKS = np.zeros(256, bool)
MARKS[list(b" \t\n\r\f\v*#/;")] = True
#: Phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BREAK, IN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]", rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
BASE_SCORE = 0.6


class Detection(NamedTuple):
    start: int
    end: int
    order: int
    rule: Rule


@lru_cache(1)
def compiled() -> tuple[dict[bytes, list[tuple[int, Rule]]], list[tuple[bytes, str, re.Pattern]]]:
    by_keyword = defaultdict(list)
    for i, r in enumerate(rules()):
        by_keyword[r.keyword].append((i, r))
    base = [(p.split()[0].encode(), label, re.compile(rb"(?<!" + IN + rb")" + (BREAK + rb"+").join(p.encode().split()) + rb"(?!" + IN + rb")")) for p, label in PHRASES.items()]
    return by_keyword, base


def settle(found: list[Detection]) -> list[Detection]:
    """Detections that aren't contained in one that comes before them in priority, length and rule order."""
    starts = sorted({d.start for d in found})
    furthest = [-1] * (len(starts) + 1)  # a Fenwick tree: the furthest end of what begins no later
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.order, d.start)):
        at = i = bisect_right(starts, d.start)
        reach = -1
        while i:
            reach, i = max(reach, furthest[i]), i & (i - 1)
        if reach >= d.end:
            continue
        kept.append(d)
        while at <= len(starts):
            furthest[at] = max(furthest[at], d.end)
            at += at & -at
    return sorted(kept)


def one_space(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with each run of white space and comment marks as one space, and their offsets."""
    marks = MARKS[buf]
    again = np.flatnonzero(marks[1:] & marks[:-1]) + 1
    return np.delete(np.where(marks, np.uint8(32), buf), again).tobytes(), offsets - np.searchsorted(again, offsets)


def rows_with(raw: bytes, keyword: bytes, offsets: np.ndarray) -> list[int]:
    """Rows whose text holds the keyword; a hit that reaches over a text's end doesn't count."""
    out, at = [], raw.find(keyword)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        if at + len(keyword) <= offsets[row + 1]:
            out.append(row)
            at = raw.find(keyword, int(offsets[row + 1]))
        else:
            at = raw.find(keyword, at + 1)
    return out


def scan_batch(texts: pa.Array) -> list[dict]:
    buf, offsets = flat(texts)
    buf = LOWER[buf]
    starts, _, first = word_ranges(buf, offsets, LETTERS)
    raw = buf[: offsets[-1]].tobytes()
    by_keyword, base = compiled()
    places, found = defaultdict(list), defaultdict(list)
    for key, label, pattern in base:
        for row in rows_with(raw, key, offsets):
            a, b = int(offsets[row]), int(offsets[row + 1])
            text = raw[a:b]
            places[row] += [(int(np.searchsorted(starts[first[row] : first[row + 1]], a + m.start())), label) for m in pattern.finditer(text)]
    spaced, spaced_offsets = one_space(buf[: offsets[-1]], offsets)
    for key, some in by_keyword.items():
        for row in rows_with(spaced if b" " in key else raw, key, spaced_offsets if b" " in key else offsets):
            text = raw[int(offsets[row]) : int(offsets[row + 1])]
            for i, rule in some:
                found[row] += [Detection(m.start(), m.end(), i, rule) for m in rule.pattern.finditer(text)]
    out = []
    for row in range(len(offsets) - 1):
        at, kept = places.get(row, []), settle(found.get(row, []))
        missed = 1.0
        for c in [*(d.rule.confidence for d in kept), *[BASE_SCORE] * bool(at)]:
            missed *= 1 - c
        base_labels = {label for _, label in at}
        out.append(
            {
                "n_words": int(first[row + 1] - first[row]),
                "n_base": len(at),
                "first_word": min((w for w, _ in at), default=None),
                "last_word": max((w for w, _ in at), default=None),
                "base_labels": ",".join(sorted(base_labels)),
                "labels": ",".join(sorted(base_labels | {d.rule.label for d in kept})),
                "score": 1 - missed,
                "detections": [{"label": d.rule.label, "start": d.start, "end": d.end, "priority": d.rule.priority} for d in kept],
            }
        )
    return out


TYPES = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """The base figures, labels, score and detections (label, byte span, priority) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": spans}
        for batch in chunks(batches):
            rows = scan_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in rows[0])], names=["doc_id", *rows[0]])

    return texts_of(docs).mapInArrow(run, TYPES + ", detections array<struct<label: string, start: long, end: long, priority: int>>")
