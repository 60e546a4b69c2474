"""Byte-level BPE as a lazily determinised finite-state transducer.

A piece (one match of the split pattern) is read byte by byte. The nondeterministic machine guesses where
tokens end: a guess survives only if every two neighbouring tokens are what merging their joint bytes would
give, and for each prefix of a piece exactly one last token satisfies that. A state of the determinised
machine is the set of live positions, each with its last token, its place in the vocabulary's trie and the
tokens not yet emitted; a step emits the longest common start of these, so tokens leave after a lookahead
bounded by the longest token. States and steps are made when first needed and kept in bounded tables.
Decoding streams ids through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracequarry.llm._text import lean, resident, slices, text_buffer

#: Bounds on what one worker keeps: states of the machine, pieces with their ids, joint encodings. About 250 MB in all;
#: the scale of a codec makes them larger where a worker has more memory.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 100_000, 600_000, 400_000
#: Text bytes encoded and returned at once; a longer text comes alone.
PORTION_BYTES = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State:
    __slots__ = ("items", "steps", "last")

    def __init__(self, items: tuple):
        self.items = items  # (last token or -1, trie node, tokens not yet emitted), one per live position; the newest is last
        self.steps: dict[int, tuple[tuple[int, ...], State]] = {}
        self.last = items[-1][2]


class Transducer:
    """Bytes in, token ids out, for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], scale: float = 1.0):
        self.ranks, self.most_states, self.most_pairs = ranks, int(MAX_STATES * scale), int(MAX_PAIRS * scale)
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                at = self.children[node].get(b)
                if at is None:
                    at = len(self.children)
                    self.children[node][b] = at
                    self.children.append({})
                    self.token_at.append(-1)
                node = at
            self.token_at[node] = rank
        self.inner = {i for i, below in enumerate(self.children) if below}  # nodes that some token goes on from
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.states: dict[tuple, State] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all states. Steps are cut first: they point at each other, and would outlive the table."""
        for known in self.states.values():
            known.steps.clear()
        self.states = {}
        self.begin = self.state(((-1, 0, ()),))

    def state(self, items: tuple) -> State:
        found = self.states.get(items)
        if found is None:
            found = self.states[items] = State(items)
        return found

    def merged(self, piece: bytes) -> list[int]:
        """The definition: join the neighbouring parts of lowest rank, the leftmost first, until none joins."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose joining makes this one; a token that merging never makes, and a single byte, have (-1, -1)."""
        known = self.parts.get(token)
        if known is None:
            text, limit = self.tokens[token], token
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best[0] >= limit:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            known = self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` may come after `left` (-1: at the start): merging their joint bytes gives just these two.

        The merges inside both run in order of rank; the pair fails if parts that meet at the border would be
        joined before both of them are used up. Only the parts along the border are looked at.
        """
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self.proper(right) and (left < 0 or self.apart(left, right))
        return known

    def proper(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves(token)[0] >= 0

    def apart(self, left: int, right: int) -> bool:
        ranks, tokens = self.ranks, self.tokens
        until = 1 << 60  # merges of this rank and above come after the parts now at the border are used up
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < until:
                return False
            # Undo the later of the two: equal ranks at the border run from the left, so the left one is the earlier.
            inner_left, inner_right = self.halves(left)[1], self.halves(right)[0]
            if inner_left >= 0 and (left > right or inner_right < 0):
                until, left = left, inner_left
            elif inner_right >= 0:
                until, right = right + 1, inner_right
            else:
                return True

    def step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        children, token_at, pairs, items, ended = self.children, self.token_at, self.pairs, [], None
        for last, node, rest in state.items:
            at = children[node].get(byte)
            if at is None:
                continue
            if ended is None:
                token = token_at[at]
                if token >= 0:
                    fits = pairs.get((last + 1) << 32 | token)
                    if fits or fits is None and self.follows(last, token):
                        ended = (token, 0, rest + (token,))
            if at in self.inner:
                items.append((last, at, rest))
        items.append(ended)
        first = items[0][2]
        shared = len(first)
        for _, _, rest in items:
            same = 0
            for x, y in zip(first[:shared], rest):
                if x != y:
                    break
                same += 1
            shared = same
            if not shared:
                break
        if shared:
            items = [(last, node, rest[shared:]) for last, node, rest in items]
        key = tuple(items)
        ahead = self.states.get(key)
        if ahead is None:
            ahead = self.states[key] = State(key)
        done = state.steps[byte] = (first[:shared], ahead)
        return done

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self.restart()
        state, out, states = self.begin, [], self.states
        for b in piece:
            emitted, state = state.steps.get(b) or self.step(state, b)
            if emitted:
                out += emitted
            if len(states) > self.most_states:  # within one long piece too: what is kept stays bounded
                self.restart()
                state, states = self.state(state.items), self.states
        return out + list(state.last)


class Pieces(dict):
    """Ids of each piece as little-endian 32-bit integers; made by the transducer when first asked for.

    Two generations: when the young one is full it becomes the old one, and a piece asked for again moves up, so
    frequent pieces stay and at most `most` are held.
    """

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.most, self.old = machine, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is None:
            ids = np.array(self.machine.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if 2 * len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Machine:
    """Incremental UTF-8: feed bytes in any portions; each call returns the text that is complete by then.

    The state is the sequence begun at the end of the last portion and the bytes that it still lacks. A
    sequence that goes wrong becomes U+FFFD as Python's "replace" has it.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def lacking(tail: bytes) -> int:
        """How many of the last bytes begin a sequence that is not complete but may yet be."""
        for back in range(1, min(3, len(tail)) + 1):
            lead = tail[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte is bounded more narrowly after four of the leads
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= tail[1 - back or len(tail)] <= high:
                    return 0
            return back
        return 0

    def feed(self, portion: bytes) -> str:
        portion = self.held + portion
        back = self.lacking(portion)
        self.held = portion[len(portion) - back :]
        return portion[: len(portion) - back].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str, scale: float = 1.0):
        self.machine = Transducer(load_ranks(path), scale)
        self.pieces = Pieces(self.machine, int(MAX_PIECES * scale))
        self.split = regex.compile(pattern).findall
        size = max(self.machine.tokens) + 1
        self.bytes_of = [self.machine.tokens.get(i, b"") for i in range(size)]
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def portions(self, ids: bytes, size: int = 1 << 16) -> Iterator[bytes]:
        found = np.frombuffer(ids, "<u4")
        for k in range(0, len(found), size):
            yield b"".join(map(self.bytes_of.__getitem__, found[k : k + size].tolist()))

    def decode(self, ids: bytes) -> str:
        machine = Utf8Machine()
        return "".join(map(machine.feed, self.portions(ids))) + machine.end()


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """Millions of small live objects make each run of the cycle collector slow; it waits until the batch is done."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def codec(path: str, pattern: str, scale: float = 1.0) -> Codec:
    """One codec per worker and vocabulary."""
    return resident(("bpe", path, pattern, scale), lambda: Codec(path, pattern, scale))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, others: Iterable[str] = (), scale: float = 1.0) -> DataFrame:
    """Encode every whole text and decode its ids again.

    vocabulary: a file of base64 tokens and ranks, present on every executor; pattern: its split pattern.
    Returns id_col, others (columns passed through), n_tokens long, ids_sha256 (hex of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (hex of the decoded text's bytes) and, with keep_ids, ids binary
    in that form. scale: of the bounds on what a worker keeps (1: about 250 MB). A null or empty text has no tokens. Each row gives one row, repeated rows and null ids too.
    One pass without a shuffle.
    """
    others = [c for c in others if c != id_col]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *others)) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    width = 1 + len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, pattern, scale)
        for batch in batches:
            offsets, _ = text_buffer(batch.column(width))
            for lo, hi in slices(offsets, PORTION_BYTES):
                part = batch.slice(lo, hi - lo)
                with no_collection():
                    ids = [made.encode(t) if (t := x.as_py()) else b"" for x in part.column(width)]
                back = [hashlib.sha256(made.decode(i).encode()).hexdigest() for i in ids]
                cols = [*part.columns[:width], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *others, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select(id_col, *others, docs[text_col].cast("string").alias("__text")).mapInArrow(lean(run, tables=True), schema)
