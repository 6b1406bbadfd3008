"""Token counts by a compiled transducer: byte-level BPE as a finite-state machine.

Pieces of a text (words, numbers, signs, white space) follow from a window of neighbouring characters
(``pieces``). Inside a piece, the split of each prefix ends in exactly one token, and a token may
follow another iff the two alone are split into just these two. So all that the rest of a piece can
depend on is, for each suffix that may still grow into a token, which token ends before it and how
many tokens there are up to there. That tuple is a state. States and transitions are compiled when
first needed; a transition carries the change of the token count.

A batch is cut into chunks of one length that run side by side as lanes of arrays. A chunk maps an
entry state to an exit state and counts. Past its first piece start that map is constant, so chunks
run from there first; a scan over chunks then hands exit states on to the heads before it, in rounds
only where a piece is longer than a chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import tables

CHUNK = 512
BATCH_BYTES = 4_000_000
MOST_STATES = 300_000
START = 0
OTHER, LETTER, NUMBER, SPACE, WHITE, END = range(6)

# Endings that stay with their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        names[chr(256 + i)] = b
    return names


def character_classes() -> np.ndarray:
    """Class of every code point."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            classes[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    classes[0xD800:0xE000] = OTHER
    classes[0x20] = SPACE
    return classes


class Transducer:
    """Compiled from a byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        names = byte_characters()
        as_bytes = lambda token: bytes(names[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        self.merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in stored["added_tokens"]]
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[bytes | None] = [None]
        for token in {bytes([b]) for b in range(256)} | {a + b for a, b in self.merges}:
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(None)
                node = self.children[node][b]
            self.token_at[node] = token
        self.made_of = {a + b: (a, b, i) for (a, b), i in self.merges.items()}
        self.partners: dict[bytes, list[tuple[bytes, int]]] = {}
        for (a, b), i in self.merges.items():
            self.partners.setdefault(a, []).append((b, i))
        self.left_kinds: dict[bytes | None, int] = {None: 0}
        self.kind_numbers: dict[frozenset, int] = {frozenset(): 0}
        self.crossing: list[dict[bytes, int]] = [{}]
        self.first_parts: dict[bytes, list[tuple[bytes, int]]] = {}
        self.allowed: dict[tuple[int, bytes], bool] = {}
        self.classes = character_classes()
        self.forget()

    def forget(self) -> None:
        """Drop compiled states, keeping memory bounded on very mixed input."""
        self.numbers = {((0, 0, 0),): START}
        self.states = [((0, 0, 0),)]
        self.shared: dict[tuple, tuple] = {}
        self.filled = 0
        self.keys = np.full(1 << 16, -1, dtype=np.int64)
        self.moves = np.zeros(1 << 16, dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """First place of each key in the open-addressed table of transitions."""
        shift = np.uint64(65 - len(self.keys).bit_length())
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def add(self, keys: np.ndarray, moves: np.ndarray) -> None:
        """Store transitions whose keys are distinct and new; the table stays at most half full."""
        self.filled += len(keys)
        if self.filled * 2 > len(self.keys):
            held = self.keys >= 0
            keys, moves = np.concatenate([self.keys[held], keys]), np.concatenate([self.moves[held], moves])
            room = 1 << (4 * len(keys)).bit_length()
            self.keys, self.moves = np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=np.int32)
        at = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one place, one is kept
            kept = self.keys[at] == keys
            self.moves[at[kept]] = moves[kept]
            keys, moves, at = keys[~kept], moves[~kept], (at[~kept] + 1) & (len(self.keys) - 1)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stored transitions, and the numbers of the keys that have none yet."""
        at = self.slots(keys)
        found = self.keys[at]
        packed = self.moves[at]
        open_ = np.flatnonzero(found != keys)
        absent = []
        while len(open_):
            none = found[open_] < 0
            absent.append(open_[none])
            open_ = open_[~none]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[at[open_]]
            packed[open_] = self.moves[at[open_]]
            open_ = open_[found[open_] != keys[open_]]
        return packed, np.concatenate(absent) if absent else open_

    def left_kind(self, token: bytes) -> int:
        """Number of the tokens that act alike on what follows them.

        While a token is put together, its last parts could merge with the right neighbour instead.
        Tokens with the same such merges, of the same ranks, are one kind.
        """
        kind = self.left_kinds.get(token)
        if kind is None:
            threats: dict[bytes, int] = {}
            part, taken = token, 1 << 30
            while part is not None:
                for right, rank in self.partners.get(part, ()):
                    if rank < taken and rank < threats.get(right, 1 << 30):
                        threats[right] = rank
                _, part, taken = self.made_of.get(part, (None, None, 0))
            named = frozenset(threats.items())
            kind = self.kind_numbers.setdefault(named, len(self.crossing))
            if kind == len(self.crossing):
                self.crossing.append(threats)
            self.left_kinds[token] = kind
        return kind

    def follows(self, left: int, right: bytes) -> bool:
        """Whether the two stay apart: no merge across the border comes before those inside."""
        known = self.allowed.get((left, right))
        if known is None:
            parts = self.first_parts.get(right)
            if parts is None:
                parts, part, taken = [], right, 1 << 30
                while part is not None:
                    parts.append((part, taken))
                    part, _, taken = self.made_of.get(part, (None, None, 0))
                self.first_parts[right] = parts
            threats = self.crossing[left]
            known = all(threats.get(part, 1 << 31) > taken for part, taken in parts)
            if len(self.allowed) > 2_000_000:
                self.allowed.clear()
            self.allowed[left, right] = known
        return known

    def compile(self, state: int, byte: int) -> int:
        """Add the transition; returns next state times 16 plus the change of the count plus 8.

        A state lists (trie node of a suffix, kind of the token that ends before it, count there less
        the count here), longest suffix first; the empty suffix at the root is last.
        """
        grown, last, count = [], None, None
        for node, before, relative in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if last is None and token is not None and self.follows(before, token):
                last, count = self.left_kind(token), relative + 1
            if self.children[child]:
                grown.append((child, before, relative))
        share = self.shared
        key = (*(share.setdefault(e, e) for e in ((n, b, r - count) for n, b, r in grown)), (0, last, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number * 16 + count + 8

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        keys = states * 256 + data
        packed, absent = self.look(keys)
        if len(absent):
            new, which = np.unique(keys[absent], return_inverse=True)
            moves = np.array([self.compile(int(k) >> 8, int(k) & 255) for k in new], dtype=np.int32)
            self.add(new, moves)
            packed[absent] = moves[which]
        return packed

    def counted(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte; ``begins`` marks bytes where a piece starts."""
        if len(self.states) > MOST_STATES:
            self.forget()
        size = len(data)
        changes = np.zeros(size, dtype=np.int8)
        lanes = -(-size // CHUNK)
        edges = np.minimum(np.arange(lanes + 1, dtype=np.int64) * CHUNK, size)
        marks = np.flatnonzero(begins)
        following = np.searchsorted(marks, edges[:-1])
        first = np.where(following < len(marks), marks[np.minimum(following, len(marks) - 1)], size)
        first = np.minimum(first, edges[1:])
        exits = np.full(lanes, -1, dtype=np.int64)
        self.run(data, begins, changes, first, edges[1:], np.zeros(lanes, dtype=np.int64), exits, np.arange(lanes))
        exits[first == edges[1:]] = -1
        heads = np.flatnonzero(first > edges[:-1])
        while len(heads):
            ready = heads[exits[heads - 1] >= 0]
            reached = np.full(lanes, -1, dtype=np.int64)
            self.run(data, begins, changes, edges[ready], first[ready], exits[ready - 1], reached, ready)
            through = ready[first[ready] == edges[ready + 1]]
            exits[through] = reached[through]
            heads = heads[~np.isin(heads, ready)]
        return changes

    def run(self, data, begins, changes, starts, stops, states, exits, lanes) -> None:
        """Run lanes from their start to their stop, longest first so that finished ones drop off."""
        order = np.argsort(starts - stops, kind="stable")
        at, length, state = starts[order].copy(), (stops - starts)[order], states[order].copy()
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, side="left"))
            here = at[:live] + i
            now = state[:live]
            now[begins[here]] = START
            packed = self.step(now, data[here])
            state[:live] = packed >> 4
            changes[here] = (packed & 15) - 8
        exits[lanes[order]] = state


def pieces(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a piece starts, given code points and classes; texts are closed by class END."""
    size = len(kinds)
    if not size:
        return np.zeros(0, dtype=bool)
    before = np.concatenate([[END], kinds[:-1]]).astype(np.uint8)
    after = np.concatenate([kinds[1:], [END]]).astype(np.uint8)
    white = (kinds == SPACE) | (kinds == WHITE)
    white_before = (before == SPACE) | (before == WHITE)
    white_after = (after == SPACE) | (after == WHITE)
    solid = ~white & (kinds != END)
    begins = solid & (before != kinds) & (before != SPACE)
    # The last character of white space before a solid one stands alone or leads the next piece.
    begins |= white & (~white_before | (~white_after & (after != END)))
    marks = np.flatnonzero((points == 0x27) & (before != OTHER) & (before != SPACE))
    ends = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
    open_ = np.concatenate([kinds != END, np.zeros(3, dtype=bool)])
    for ending in sorted(CONTRACTIONS, key=len):
        fits = np.ones(len(marks), dtype=bool)
        for i, c in enumerate(ending, 1):
            fits &= (ends[marks + i] == ord(c)) & open_[marks + i]
        found = marks[fits]
        begins[found + 1] = False
        past = found + 1 + len(ending)
        past = past[past < size]
        past = past[solid[past]]
        begins[past] = True
    begins |= kinds == END
    return begins


def count_texts(machine: Transducer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text. Special strings count one token and cut the text."""
    parts, owner, special = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        cut = [text]
        for mark in machine.special:
            if mark in text:
                cut = [p for whole in cut for p in whole.split(mark)]
                special[i] = len(cut) - 1
        parts.extend(cut)
        owner.extend([i] * len(cut))
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    kinds = machine.classes[points]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    closing = np.cumsum(lengths + 1) - 1
    kinds[closing] = END
    begins = pieces(points, kinds)
    data = np.frombuffer(joined.encode(), dtype=np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at_bytes = np.zeros(len(data), dtype=bool)
    at_bytes[lead[begins]] = True
    changes = machine.counted(data, at_bytes)
    stops = lead[closing]
    changes[stops] = 0
    sums = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
    starts = np.concatenate([[0], stops[:-1] + 1])
    tokens, sizes = special.copy(), np.zeros(len(texts), dtype=np.int64)
    np.add.at(tokens, owner, sums[stops] - sums[starts])
    np.add.at(sizes, owner, stops - starts)
    sizes += special * sum(len(m.encode()) for m in machine.special[:1])
    return sizes, tokens


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """Compiled once for each worker and kept for its later tasks."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def token_counts(documents: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` names a byte-level BPE file with at most one special string, present on every executor.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give their row, an empty table
    gives none; other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(path)
        for batch in tables(batches, BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, tokens = count_texts(compiled, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(tokens)], schema=out)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
