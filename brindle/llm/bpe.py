"""Byte-pair encoding and decoding by a tokenization automaton.

The ordered merges are compiled, one merge gadget after the other, into a deterministic automaton whose
arcs carry tokens and which accepts exactly the token sequences that byte-pair encoding produces.  For a
merge (u, v) the gadget takes the state q that u leads to, adds a copy of q without its arc v, sends u to the
copy, and lets the new token uv lead to where v led from q.  So every token leads to one state, named here by
that token, and a state is stored by what it lacks: gadget number k takes arc v from the states that end in u
and came after it.  Whether an arc leaves a state is read from these gadgets (a few look-ups: a token's state
descends from that of its right part, an arc from that of its left part) and kept in a transition table.

A pre-split word is encoded by running the automaton over it, longest label first.  Every prefix of a word has
exactly one accepted sequence, so no position is tried twice and the walk is linear in the word (times the
longest label).  Decoding emits the arcs' labels.

Null text counts as empty; an empty text has no tokens.  Rows are independent: repeated rows, null ids and
further columns change nothing, an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the byte-level pre-tokenizer's pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Encoded words that a worker remembers at most; beyond that the memory starts afresh.
REMEMBERED = 250_000
#: And entries of the transition table, counted when the words' memory starts afresh.
TRANSITIONS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled merges.  Picklable; its size follows the vocabulary alone."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """labels: bytes of each token; merges: (left, right, merged) in order; special: whole strings with an id."""
        self.labels, self.special = labels, special
        size = max(labels, default=-1) + 1
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.gadget: dict[tuple[int, int], int] = {}
        live = {t for t, b in labels.items() if len(b) == 1}
        for order, (u, v, merged) in enumerate(merges):
            if u in live and v in live and merged not in live and self.has(u, v):
                live.add(merged)
                self.left[merged], self.right[merged], self.made[merged] = u, v, order
                self.gadget[u, v] = order
        self.table: dict[int, bool] = {}
        self.arcs = {labels[t]: t for t in sorted(live, reverse=True)}
        self.longest = max(map(len, self.arcs), default=0)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def has(self, state: int, arc: int) -> bool:
        """Whether the arc leaves the state that the token `state` leads to."""
        gadget, made, left, right = self.gadget, self.made, self.left, self.right
        until = len(made) + len(gadget)
        while True:
            token, before = arc, until
            while True:
                order = gadget.get((state, token), -1)
                if 0 <= order < until and order <= before:
                    return False
                if left[token] < 0:
                    break
                token, before = left[token], made[token]
            if right[state] < 0:
                return True
            state, until = right[state], made[state]

    def word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        arcs, table, longest, size = self.arcs, self.table, self.longest, len(word)
        path: list[int] = []
        back: list[tuple[int, int, int]] = []
        tried = bytearray(size + 1)
        i, last, j = 0, -1, min(size, longest)
        while i < size:
            while j > i:
                if (token := arcs.get(word[i:j])) is not None and not tried[j]:
                    if last < 0:
                        break
                    if (allowed := table.get(arc := last << 32 | token)) is None:
                        allowed = table[arc] = self.has(last, token)
                    if allowed:
                        break
                j -= 1
            if j > i:
                back.append((i, last, j))
                path.append(token)
                tried[j] = 1
                i, last, j = j, token, min(size, j + longest)
            else:
                path.pop()
                i, last, j = back.pop()
                j -= 1
        return path

    def forget(self) -> None:
        if len(self.table) > TRANSITIONS:
            self.table.clear()


def load(path: str) -> Automaton:
    """Compile a byte-level vocabulary file, read where this is called: on the driver.

    Files that ask for more than this does (other pre-tokenizers, normalizers, model or token flags) are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    asked = {
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(asked.values()):
        raise ValueError(f"{path}: not a plain byte-level vocabulary: {', '.join(k for k, v in asked.items() if v)}")
    alphabet = byte_alphabet()
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    labels = {i: bytes(alphabet[c] for c in k) for k, i in vocab.items()}
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


class Encoder(dict):
    """Remembers the encoded words: maps a word to its ids as little-endian 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.emits = {t: b for t, b in automaton.labels.items()} | {i: s.encode() for s, i in automaton.special.items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
            self.automaton.forget()
        ids = self[word] = np.array(self.automaton.word(word.encode()), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        split = self.automaton.split
        if split is None or not any(s in text for s in self.automaton.special):
            return b"".join(map(self.__getitem__, WORDS.findall(text)))
        out = []
        for part in split.split(text):
            if part in self.automaton.special:
                out.append(np.array([self.automaton.special[part]], "<u4").tobytes())
            else:
                out += map(self.__getitem__, WORDS.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.emits.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", round_trip: bool = False) -> DataFrame:
    """Key, n_tokens and token_ids (little-endian unsigned 32-bit integers) of every whole text.

    round_trip adds `decoded`, the text that the emitted ids give back.
    """
    source = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)  # its memory of words ends with the task
        for batch in _slices(batches):
            ids = [coder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if round_trip:
                columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_tokens", "token_ids", *["decoded"] * round_trip]
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, token_ids binary" + ", decoded string" * round_trip)


def decode(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """Key and text of encoded rows; null ids count as none."""
    source = frame.select(key, ids)
    shared = frame.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)  # its memory of words ends with the task
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, text string")
