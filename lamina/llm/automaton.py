"""A byte-pair tokenizer as a deterministic automaton over tokens, compiled from its merges.

The automaton starts as one state with an arc for each byte. Each merge (u, v) -> w, in order
of priority, is a gadget on it: the states reached by an arc u lose their arc v, and every state
with u followed by v gains an arc w, whose target continues as the state after v did when w was
made. What remains accepts exactly the token sequences that the merges produce, so each word has
one path, and any prefix of it is the path of a shorter word.

Words are bytes, so a second table says which arc labels end at a position: the trie of all labels with
failure links. ``compile_tables`` builds both once, on the driver: transitions by byte, the last arc of every
prefix of a label, and whether each arc exists that an encoding within the vocabulary can ask for. Executors
receive these arrays (a few MB, bounded by the vocabulary) and encode by looking transitions up. States
share what they have in common: a state keeps the token it was copied from and the time of
its gadget, so an arc outside the table is settled by going back along these copies.
"""

from __future__ import annotations

import json
import os
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

TOKENIZER = "byte_bpe_50k.json"
#: Splits text into the words within which merges happen (fixed by the vocabulary).
PATTERN = r""" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: The same for texts of ASCII characters only.
_SPLIT_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Words, and arcs beyond the compiled ones, kept by one Python worker before it starts afresh.
WORDS_KEPT = 1 << 18
ARCS_KEPT = 1 << 20
#: Longer words and chunks (in characters) are encoded each time, so that the tables stay small.
LONGEST_KEPT = 200


def default_folder() -> str:
    """Where the public vocabularies are installed; every function here takes another folder too."""
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Tables:
    """The compiled automaton as arrays; states of the trie are numbered, 0 is the empty prefix."""

    #: Per token: the priority of its gadget (-1 for bytes) and the two tokens it joins.
    made: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    #: Pairs of tokens (a << 20 | b) in order of priority.
    gadgets: np.ndarray
    #: Transitions by byte (state << 8 | byte) and where they lead.
    edges: np.ndarray
    targets: np.ndarray
    #: Per state: its longest proper suffix, its length, its token (-1 if none), the next shorter suffix with a token.
    fail: np.ndarray
    depth: np.ndarray
    token: np.ndarray
    shorter: np.ndarray
    #: Per state: the last arc on the path of its prefix, and where that arc begins.
    last: np.ndarray
    start: np.ndarray
    #: Arcs (a << 20 | b) of encodings within the vocabulary, and whether they exist.
    arcs: np.ndarray
    exists: np.ndarray


class Automaton:
    """Lookup structures over Tables."""

    def __init__(self, tables: Tables) -> None:
        self.made, self.head, self.tail = tables.made.tolist(), tables.head.tolist(), tables.tail.tolist()
        self.gadget = dict(zip(tables.gadgets.tolist(), range(len(tables.gadgets))))  # noqa: B905
        self.edges = dict(zip(tables.edges.tolist(), tables.targets.tolist()))  # noqa: B905
        self.fail, self.depth, self.token, self.shorter = tables.fail.tolist(), tables.depth.tolist(), tables.token.tolist(), tables.shorter.tolist()
        self.last, self.start = tables.last.tolist(), tables.start.tolist()
        #: The compiled arcs, and those that other words asked for.
        self.arcs = dict(zip(tables.arcs.tolist(), tables.exists.tolist()))  # noqa: B905
        self.other: dict[int, bool] = {}

    def arc(self, a: int, b: int) -> bool:
        """Whether the state after token ``a`` has an arc ``b``."""
        known = self.arcs.get(a << 20 | b)
        if known is None:
            known = self.other.get(a << 20 | b)
            if known is None:
                if len(self.other) > ARCS_KEPT:
                    self.other.clear()
                known = self.other[a << 20 | b] = settle(a, b, self.made, self.head, self.tail, self.gadget)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word, by transitions: the last arc of each prefix, then back from the end."""
        edges, fail, depth, token, shorter, arcs, arc = self.edges, self.fail, self.depth, self.token, self.shorter, self.arcs, self.arc
        n, state = len(word), 0
        last, start = [0] * (n + 1), [0] * (n + 1)
        for end, byte in enumerate(word, 1):
            to = edges.get(state << 8 | byte)
            while to is None:
                state = fail[state]
                to = edges.get(state << 8 | byte)
            state = to
            if depth[state] == end:  # the prefix is one of the trie's
                last[end], start[end] = self.last[state], self.start[state]
                continue
            s = state if token[state] >= 0 else shorter[state]
            while True:
                begin, label = end - depth[s], token[s]
                known = arcs.get(last[begin] << 20 | label)
                if known or known is None and arc(last[begin], label):
                    break
                s = shorter[s]
            last[end], start[end] = label, begin
        out, end = [], n
        while end:
            out.append(last[end])
            end = start[end]
        return out[::-1]


def settle(a: int, b: int, made: list[int], head: list[int], tail: list[int], gadget: dict[int, int], before: int | None = None) -> bool:
    """Whether an arc exists, from the states it was copied from: the border between a and b must never have been a gadget's.

    ``before`` bounds the gadgets that saw the present pair: the state after a token copies the
    state after its tail at the time it was made, and an arc exists for as long as its head's did.
    Of two tokens made by one gadget (a doubled token) the left is the older, as merges run from the left.
    """
    before = len(gadget) if before is None else before
    while True:
        at = gadget.get(a << 20 | b)
        if at is not None and at < before:
            return False
        if made[a] < 0 and made[b] < 0:
            return True
        if made[a] > made[b]:
            before, a = made[a], tail[a]
        else:
            # b arose while the state after a was what it is now, up to and with b's own gadget when a isn't newer
            before, b = made[b] + 1, head[b]


def compile_tables(merges: list[tuple[str, str]], ids: dict[str, int]) -> Tables:
    """Apply all gadgets in order of priority, then compile the trie of labels and every arc it can ask for."""
    labels = labels_of(merges, ids)
    size = max(labels) + 1
    made, head, tail, gadget = [-1] * size, [-1] * size, [-1] * size, {}
    for priority, (u, v) in enumerate(merges):
        a, b, w = ids[u], ids[v], ids[u + v]
        gadget[a << 20 | b] = priority
        if made[w] < 0:
            made[w], head[w], tail[w] = priority, a, b
    # A label is used only if its gadget found its two tokens side by side; trained vocabularies have no others.
    used = {own for own in labels if made[own] < 0}
    for own in sorted(labels, key=made.__getitem__):
        if made[own] >= 0 and head[own] in used and tail[own] in used and settle(head[own], tail[own], made, head, tail, gadget, made[own]):
            used.add(own)
    edges: dict[int, int] = {}
    parent, depth, token, byte_of = [0], [0], [-1], [0]
    for own, label in labels.items():
        state = 0
        for byte in label:
            to = edges.get(state << 8 | byte)
            if to is None:
                to = edges[state << 8 | byte] = len(parent)
                parent.append(state)
                depth.append(depth[state] + 1)
                token.append(-1)
                byte_of.append(byte)
            state = to
        token[state] = own if own in used else -1
    n = len(parent)
    fail, shorter, last, start = [0] * n, [-1] * n, [-1] * n, [0] * n
    arcs: dict[int, bool] = {}
    for s in sorted(range(1, n), key=depth.__getitem__):
        if parent[s]:
            f = fail[parent[s]]
            while (to := edges.get(f << 8 | byte_of[s])) is None:
                f = fail[f]
            fail[s] = to
            shorter[s] = to if token[to] >= 0 else shorter[to]
        if token[s] >= 0:
            last[s], start[s] = token[s], 0
            continue
        t = shorter[s]
        while True:
            before = s
            for _ in range(depth[t]):
                before = parent[before]
            key = last[before] << 20 | token[t]
            if key not in arcs:
                arcs[key] = settle(last[before], token[t], made, head, tail, gadget)
            if arcs[key]:
                break
            t = shorter[t]
        last[s], start[s] = token[t], depth[s] - depth[t]
    whole = lambda values: np.array(values, np.int32)
    long = lambda values: np.fromiter(values, np.int64)
    return Tables(
        whole(made), whole(head), whole(tail), long(gadget), long(edges), whole(list(edges.values())), whole(fail), whole(depth), whole(token), whole(shorter),
        whole(last), whole(start), long(arcs), np.fromiter(arcs.values(), bool),
    )


def labels_of(merges: list[tuple[str, str]], ids: dict[str, int]) -> dict[int, bytes]:
    """Arc labels: the bytes of each token that a byte or a gadget makes; special tokens are none."""
    letters, joined = byte_letters(), {u + v for u, v in merges}
    return {i: bytes(letters[c] for c in token) for token, i in ids.items() if token in joined or len(token) == 1 and token in letters}


def _model(folder: str, name: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        model = json.load(f)["model"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["vocab"]


@lru_cache(maxsize=2)
def compiled(folder: str, name: str = TOKENIZER) -> Tables:
    """Compile a vocabulary file, once per driver."""
    return compile_tables(*_model(folder, name))


@lru_cache(maxsize=2)
def labels(folder: str, name: str = TOKENIZER) -> dict[int, bytes]:
    """Arc labels of a vocabulary file, for decoding."""
    return labels_of(*_model(folder, name))


class Words(dict):
    """Word -> its ids as little-endian 32-bit integers, filled by the automaton on demand."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
        found = struct.pack(f"<{len(ids)}i", *ids)
        if len(self) > WORDS_KEPT:
            self.clear()
        if len(word) <= LONGEST_KEPT:
            self[word] = found
        return found


class Chunks(dict):
    """White space and what follows it up to the next -> its ids, packed likewise.

    No word of the pattern reaches from a character that isn't white space into one that is, and none
    looks back, so a text may be cut before each run of white space and the pieces split alone.
    """

    def __init__(self, words: Words) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        split = _SPLIT_ASCII if chunk.isascii() else _SPLIT
        found = b"".join(map(self.words.__getitem__, split.findall(chunk)))
        if len(self) > WORDS_KEPT:
            self.clear()
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = found
        return found


_READY: dict[tuple[str, str], Chunks] = {}


def chunks(tables: Tables, folder: str, name: str = TOKENIZER) -> Chunks:
    """The lookup structures of one Python worker, made from the tables when first asked for."""
    if (folder, name) not in _READY:
        if len(_READY) > 1:
            _READY.clear()
        _READY[folder, name] = Chunks(Words(Automaton(tables)))
    return _READY[folder, name]


#: White space in the Unicode sense, as a character class.
_WHITE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def encode_text(text: str, table: Chunks) -> bytes:
    """Ids of a whole text as packed 32-bit integers."""
    return b"".join(map(table.__getitem__, _CUT.findall(text)))
