"""License scans: exact phrases and fuzzy short notices.

Texts are brought to words (A-Z lower-cased, runs of digits, letters and non-ASCII) with single spaces between.
A notice of length n may differ from the text by up to `errors` edits of single characters.  By the pigeonhole
principle a match leaves one of errors+1 pieces of the notice untouched, so an Aho-Corasick automaton over all
pieces finds every place where a match can be; there the regex library's bounded-error matching verifies the
edits and gives the span.  The parts of a notice that tell licences apart
may have one or two edits each, and no other digit.

Null text is empty: no words, no labels, score 0.  Rows are independent: repeated rows, null ids and further
columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbytes import LOWER, chunks, column_buffer

# The exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices, their labels, and the edits each may have.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this work is licensed under the gnu general public license": "gpl-notice",
    "this program is free software you can redistribute it": "gpl-notice",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-attribution",
    "licensed under cc by": "cc-notice",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved-notice",
}

# The parts of notices that tell licences apart.
TELLING = {
    "licensed under the apache license version 2 0": ("apache", "2 0"),
    "released under the mit license": ("mit",),
    "this work is licensed under the gnu general public license": ("gnu",),
    "gnu lesser general public license": ("gnu", "lesser"),
    "mozilla public license": ("mozilla",),
    "licensed under cc by": ("cc by",),
}


def allowed_errors(notice: str) -> int:
    return max(1, len(notice) // 10)


class Finder:
    """Seeds of all notices and phrases, and what verifies them.  Picklable without the automaton."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], telling: dict[str, tuple[str, ...]] = TELLING):
        self.phrases, self.notices = phrases, list(notices.items())
        self.errors = [allowed_errors(n) for n in notices]
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(n, special_only=False)}){{e<={k}}}") for n, k in zip(notices, self.errors, strict=True)]
        # Searched near the part's place: one edit in a short part, two in a longer one; digits may go, but none may be another.
        rule = lambda part: f"[^0-9]*{part[0]}?[^0-9]*{part[-1]}?[^0-9]*" if part[0].isdigit() else f"(?:{part}){{e<={1 if len(part) < 6 else 2}}}"
        self.telling = [[(n.index(part), len(part), part[0].isdigit(), regex.compile(rule(part))) for part in telling.get(n, ())] for n in notices]
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for i, (notice, k) in enumerate(zip(notices, self.errors, strict=True)):
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((i, a, b - a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (where, None))
        for phrase in phrases:
            self.automaton.add_word(phrase, (seeds.get(phrase, []), phrase))
        self.automaton.make_automaton()

    def scan(self, text: str, row_ends: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int, int]]]:
        """Over rows that a line feed ends each: (start, phrase), and (start, end, label, errors, notice's length)."""
        exact, spots = [], []
        for end, (where, phrase) in self.automaton.iter(text):
            if phrase is not None:
                start = end + 1 - len(phrase)
                if text[end + 1] in " \n" and (not start or text[start - 1] in " \n"):
                    exact.append((start, phrase))
            spots += [(i, end + 1 - size - offset, end) for i, offset, size in where]
        found, done = [], {}
        for i, at, seed in sorted(spots):
            notice, label = self.notices[i]
            k = self.errors[i]
            if at + k < done.get(i, -1):  # inside what was verified for this notice
                continue
            row = int(np.searchsorted(row_ends, seed, "left"))
            low = max(at - k, int(row_ends[row - 1]) + 1 if row else 0)
            high = min(at + len(notice) + k, int(row_ends[row]))
            if high <= low:
                continue
            m = self.verify[i].search(text, low, high)
            if m is not None and all(part.fullmatch(text, max(low, m.start() + at - k), m.end()) if digits else part.search(text, max(low, m.start() + at - k), min(high, m.start() + at + size + k)) for at, size, digits, part in self.telling[i]):
                done[i] = m.end()
                found.append((m.start(), m.end(), label, sum(m.fuzzy_counts), len(notice)))
        return exact, found


def normalized(buf: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as words with single spaces, a line feed after each: one character a byte.

    Also where rows end, where words start, and each row's first word.
    """
    low = LOWER[buf]
    word = (low >= 0x80) | (low >= 97) & (low <= 122) | (low >= 48) & (low <= 57)
    rows = len(offsets) - 1
    cuts = offsets[1:]
    # One separator more after each row, so rows never touch.
    wide = np.insert(np.where(word, low, 32).astype(np.uint8), cuts, 10)
    inside = np.insert(word, cuts, False)
    ends = cuts + np.arange(rows)
    before = np.zeros(len(wide), bool)
    before[1:] = inside[:-1]
    starts = inside & ~before
    # A space stands before each word that isn't its row's first.
    word_at = np.flatnonzero(starts)
    row_of = np.searchsorted(ends, word_at, "left")
    first_word = np.searchsorted(row_of, np.arange(rows + 1), "left")
    gap = np.ones(len(word_at), bool)
    gap[first_word[:-1][first_word[:-1] < first_word[1:]]] = False
    keep = inside.copy()
    keep[ends] = True
    spaces = word_at[gap] - 1
    keep[spaces] = True
    wide[spaces] = 32
    place = np.cumsum(keep) - 1
    return wide[keep].tobytes().decode("latin-1"), place[ends], place[word_at], first_word


_SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,errors:int>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """For each row: n_words, base (exact phrases) and spans (notices) as label, first word, last word, errors; score.

    score: 1 with an exact phrase, else the best notice's share of characters without an edit, else 0.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "base", "spans", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(phrases, notices)
        spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))
        for batch in batches:
            buf, offsets = column_buffer(batch.column(1))
            for i, j in chunks(offsets):
                rows = j - i
                flat, ends, word_at, first_word = normalized(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                exact, fuzzy = finder.scan(flat, ends)
                base: list[list[dict]] = [[] for _ in range(rows)]
                near: list[list[dict]] = [[] for _ in range(rows)]
                score = np.zeros(rows)
                for start, phrase in exact:
                    row = int(np.searchsorted(ends, start, "left"))
                    word = int(np.searchsorted(word_at, start)) - int(first_word[row])
                    base[row].append({"label": phrases[phrase], "first_word": word, "last_word": word + phrase.count(" "), "errors": 0})
                    score[row] = 1
                for start, end, label, errors, size in fuzzy:
                    row = int(np.searchsorted(ends, start, "left"))
                    a, b = (int(np.searchsorted(word_at, x, "right")) - 1 - int(first_word[row]) for x in (start, max(start, end - 1)))
                    near[row].append({"label": label, "first_word": max(a, 0), "last_word": b, "errors": errors})
                    score[row] = max(score[row], 1 - errors / size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), pa.array(np.diff(first_word), pa.int64()), pa.array(base, spans), pa.array(near, spans), pa.array(score)], names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, base {_SPANS}, spans {_SPANS}, score double")
