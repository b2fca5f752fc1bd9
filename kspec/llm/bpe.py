"""Byte-level BPE by a finite-state transducer, and a streaming decoder.

The merges allow two tokens side by side only if merging the bytes of both from scratch gives the two again. Of all ways to cut a
text into tokens exactly one has only allowed neighbours, and that one is the BPE encoding. So encoding is a transduction: a configuration is
(place in the trie of tokens, last finished token), and reading a byte moves each configuration down the trie and, where a token ends that may
follow the last one, adds one at the root. The transducer is determinised while it reads: a state is the set of configurations, each with
the tokens it has not yet put out; what all of them agree on is put out at once. A configuration inside a token ends or dies within the longest
token, so the lookahead is bounded. States and steps are kept in a table that is emptied when full, also in the middle of a word."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PieceEncoder
from .common import by_size, carried_id, modest_batches, restored_id, text_of


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token with its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """ranks: token bytes -> id; a lower id merges earlier. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks, self.max_states = ranks, max_states
        self.token = {i: b for b, i in ranks.items()}
        self.start = 1 << 31  # stands before the first token
        child: dict[int, int] = {}
        ends: dict[int, int] = {}
        for b, i in ranks.items():
            at = 0
            for x in b:
                at = child.setdefault(at << 8 | x, len(child) + 1)
            ends[at] = i
        inner = {key >> 8 for key in child}
        #: place in the trie and byte -> place after it, the token that ends there or -1, whether longer tokens go on
        self.down = {key: (at, ends.get(at, -1), at in inner) for key, at in child.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._allowed: dict[int, bool] = {}
        self._number: dict[tuple, int] = {}
        self._state: list[tuple] = []
        self._step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._reset()

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t last; None for a single byte or a token that merges never make."""
        if t not in self._halves:
            parts = [bytes([x]) for x in self.token[t]]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best >= t:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[t]

    def made(self, t: int) -> bool:
        """Whether merges make this token from its bytes."""
        return len(self.token[t]) == 1 or self.halves(t) is not None

    def allowed(self, a: int, b: int) -> bool:
        """Whether merges make b and keep the border between a and b."""
        key = a << 32 | b
        found = self._allowed.get(key)
        if found is None:
            if len(self._allowed) > 500_000:
                self._allowed.clear()
            found = self._allowed[key] = self.made(b) and (a == self.start or self._keeps_border(a, b))
        return found

    def _keeps_border(self, left: int, right: int) -> bool:
        """Going back through the merges of both from the last one: has no pair across the border had its turn earlier?"""
        undone = 1 << 60  # a pair of a rank below this would have merged before the step that was undone last
        token, rank_of, halves = self.token, self.ranks.get, self.halves
        while True:
            joint = rank_of(token[left] + token[right])
            if joint is not None and joint < undone:
                return False
            l, r = halves(left), halves(right)
            if r is None or (l is not None and left > right):
                if l is None:
                    return True
                undone, left = left, l[1]
            else:  # of equal ranks the leftmost pair merges first, and the border is left of right's parts
                undone, right = right + 1, r[0]

    def _reset(self) -> None:
        """Empties the tables in place: a word that is being read holds on to them."""
        first = ((0, self.start, ()),)
        self._number.clear()
        self._number[first] = 0
        self._state[:] = [first]
        self._step.clear()

    def _advance(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The step from state `at`: the state after it and what it puts out.

        Configurations are in the order of their beginnings, so the first owes the fewest tokens; one at a leaf of the trie is finished."""
        if len(self._state) > self.max_states or len(self._step) > 16 * self.max_states:  # the state stays, under a new number
            held = self._state[at]
            self._reset()
            at = self._number.setdefault(held, len(self._state))
            if at == len(self._state):
                self._state.append(held)
        down, allowed, after, owes = self.down.get, self._allowed.get, [], None
        for node, last, owed in self._state[at]:
            if found := down(node << 8 | byte):
                place, t, inner = found
                if owes is None and t >= 0:
                    ok = allowed(last << 32 | t)
                    if ok or (ok is None and self.allowed(last, t)):
                        ends, owes = t, (*owed, t)
                if inner:
                    after.append((place, last, owed))
        after.append((0, ends, owes))
        told = after[0][2]
        if told:
            n = 0
            while n < len(told) and all([c[2][n] == told[n] for c in after]):
                n += 1
            told = told[:n]
            if n:
                after = [(place, last, owed[n:]) for place, last, owed in after]
        state = tuple(after)
        number = self._number.setdefault(state, len(self._state))
        if number == len(self._state):
            self._state.append(state)
        known = self._step[at << 8 | byte] = (number, told)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern. A whole word that is a token is that token, also where merges would not make it."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        out: list[int] = []
        at, step = 0, self._step.get
        for byte in word:
            at, told = step(at << 8 | byte) or self._advance(at, byte)
            if told:
                out += told
        out += self._state[at][-1][2]  # what the configuration at the root, which has read all, still owes
        return out


class ByteBPE:
    """Encoder of texts by a rank file and the pattern that cuts them into words."""

    def __init__(self, path: str, pattern: str, remembered: int = 400_000):
        import regex

        self.transducer = Transducer(load_ranks(path))
        self.words = regex.compile(pattern).findall
        self.encode_bytes = PieceEncoder(self._encode, pattern=pattern, word=self._word, limit=remembered)

    def _encode(self, text: str) -> bytes:
        encode, out = self.transducer.encode_word, []
        for word in self.words(text):
            out += encode(word.encode())
        return np.array(out, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.transducer.encode_word(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()


def _utf8_steps() -> list[dict[int, int]]:
    """Well-formed UTF-8 as an automaton: 0 between characters, 1 to 3 so many continuation bytes to come, 4 to 7 a restricted second byte after E0, ED, F0, F4."""

    def to(*spans: tuple[int, int, int]) -> dict[int, int]:
        return {b: s for low, high, s in spans for b in range(low, high + 1)}

    return [
        to((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
        to((0x80, 0xBF, 0)), to((0x80, 0xBF, 1)), to((0x80, 0xBF, 2)),
        to((0xA0, 0xBF, 1)), to((0x80, 0x9F, 1)), to((0x90, 0xBF, 2)), to((0x80, 0x8F, 2)),
    ]


UTF8 = _utf8_steps()


class StreamDecoder:
    """Tokens in, text out, a feed at a time. Bytes of an unfinished character wait for the next feed; bytes that no character can have become U+FFFD."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.held = token, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.token.__getitem__, ids))
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", errors="replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the tail that is a proper beginning of a character. Only the last three bytes can be, so the automaton reads from the last lead byte on."""
        for n in range(1, min(3, len(data)) + 1):
            if data[-n] >= 0xC0:
                state = 0
                for b in data[-n:]:
                    if b not in UTF8[state]:
                        return 0
                    state = UTF8[state][b]
                return n if state else 0
            if data[-n] < 0x80:
                return 0
        return 0


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str, remembered: int) -> ByteBPE:
    return ByteBPE(path, pattern, remembered)


#: Ids that one feed of the decoder takes.
FEED = 1 << 16


def encode_decode(docs: DataFrame, ranks: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, remembered: int = 400_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian u32), decoded_sha256 of the bytes that the ids decode to, and with keep_ids the ids.

    A row for each row of docs, in no order; a null text is empty, an empty one has no ids. Rows that repeat get equal results, null ids stay null. Other columns are not read.
    remembered: pieces whose ids a worker remembers, twice; it changes memory and time only."""

    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks, pattern, remembered)
        for batch in by_size(batches):
            rows = []
            for t in batch["text"]:
                data = codec.encode_bytes(t)
                ids = np.frombuffer(data, dtype="<u4")
                decoded, stream = hashlib.sha256(), StreamDecoder(codec.transducer.token)
                for at in range(0, len(ids), FEED):
                    decoded.update(stream.feed(ids[at : at + FEED].tolist()).encode())
                decoded.update(stream.finish().encode())
                rows.append((len(ids), hashlib.sha256(data).hexdigest(), decoded.hexdigest(), *((ids,) if keep_ids else ())))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])
            out.insert(0, "no_id", batch["no_id"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    slim = docs.select(*carried_id(F.col(doc_id)), text_of(text).alias("text"))
    return restored_id(slim.mapInPandas(run, "doc_id long, no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids))
