"""Encodes whole texts from memorised pieces.

A byte-level pre-tokenizer always starts a token at a single space between two visible characters, and of a run of line feeds between two
it makes one token of the last and one of the others. So a text may be cut there, and a piece's tokens hold wherever it occurs. Pieces
repeat far more often than texts. A text with any other spacing at a cut is encoded in one go."""

from __future__ import annotations

from collections.abc import Callable

#: The pattern of the byte-level pre-tokenizers whose cuts these are; with another pattern a text is encoded whole. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that may follow a word in a piece; cut off, they leave a word that is likely known.
MARKS = ".,;:!?"
#: Below this character every library and Python agree what a letter is.
LATIN = "\u0250"


class Uncut(Exception):
    """The text has a space at its edge or beside another one."""


def _edge(c: str) -> bool:
    """Whether some library may take c for white space."""
    return c.isspace() or c in "\x85\u180e\u200b\ufeff"


class _Memo(dict):
    """piece -> its ids as bytes. Two generations of at most `limit` pieces bound its memory; what it returns doesn't depend on them."""

    def __init__(self, lead: str, encode: Callable[[str], bytes], word: Callable[[str], bytes], marks: _Marks, limit: int, chars: int = 64):
        super().__init__()
        self.lead, self.encode, self.word, self.marks, self.limit, self.chars, self.old = lead, encode, word, marks, limit, chars, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            if piece.isalpha() and (piece.isascii() or max(piece) < LATIN):
                out = self.word(self.lead + piece)
            else:
                if not piece or _edge(piece[0]) or _edge(piece[-1]):
                    raise Uncut
                stem = piece.rstrip(MARKS)
                if stem and stem != piece and stem.isalpha():
                    out = self[stem] + self.marks[piece[len(stem) :]]
                else:
                    out = self.encode(self.lead + piece)
        if len(piece) <= self.chars:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class _Marks(dict):
    """Ids of the marks behind a word; those of usual length are kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, marks: str) -> bytes:
        out = self.encode(marks)
        if len(marks) <= 3:  # of six marks, so a few hundred entries at most
            self[marks] = out
        return out


class PieceEncoder:
    """encode: text -> ids as bytes; word: the same for letters after at most one space, which are one match of PATTERN; whole: for a text in one go, if another way is better for that.

    The result is that of whole(text). pattern: the pre-tokenizer's; unless it is PATTERN, every text is encoded whole."""

    def __init__(self, encode: Callable[[str], bytes], *, pattern: str, word: Callable[[str], bytes] | None = None, whole: Callable[[str], bytes] | None = None, limit: int = 400_000):
        self.whole, self.cuts = whole or encode, pattern == PATTERN
        marks = _Marks(encode)
        self.first, self.later = _Memo("", encode, word or encode, marks, limit // 8), _Memo(" ", encode, word or encode, marks, limit)
        self.feed = encode("\n")
        self.runs: dict[int, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self.whole(text)
        out: list[bytes] = []
        first, later, lead = self.first.__getitem__, self.later.__getitem__, False
        try:
            lines = text.split("\n")
            if not lines[-1]:
                raise Uncut
            blank = 0
            for line in lines:
                if not line:
                    blank += 1
                    continue
                if lead or blank:
                    if n := blank + lead - 1:
                        out.append(self._run(n))
                    out.append(self.feed)
                lead, blank = True, 0
                head, *rest = line.split(" ")
                out.append(first(head))
                out.extend(map(later, rest))
        except Uncut:
            return self.whole(text)
        return b"".join(out)

    def _run(self, n: int) -> bytes:
        if n not in self.runs:
            self.runs[n] = self.whole("\n" * n)
        return self.runs[n]
