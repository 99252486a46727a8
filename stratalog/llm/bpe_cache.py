"""Bounded memos in front of a subword tokenizer.

Subword merges never cross the pieces a tokenizer's pattern cuts, so equal pieces have equal ids. Texts come as parts
(cut where the pattern always cuts); a memo of parts answers most, a memo of pieces most of the rest, and what neither
holds goes to the tokenizers library. Parts with characters beyond the Latin blocks go through the whole tokenizer, so no
other library's Unicode tables decide anything there."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries of the memos in a worker (about 150 bytes each); a full memo starts anew, so memory is bounded on any corpus.
PARTS, PIECES = 800_000, 800_000
#: Longer parts and pieces are encoded each time.
LONGEST = 64
_LAST = frozenset(".,;:!?")
_PLAIN = "ɐ"  # characters below are Latin: letters and digits there are the same in all Unicode versions


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(256 + n)
        n += b not in shown
    return out


_CHARACTERS = {b: c for b, c in enumerate(byte_characters())}


class PieceEncoder:
    """Ids (as bytes of little-endian uint32) of parts, piece by piece."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, normal: Callable[[str], str] | None = None, entries: int = PIECES):
        self.tokenizer, self.tokenize, self.normal = tokenizer, tokenizer.model.tokenize, normal
        self.split, self.entries, self.known = regex.compile(pattern).findall, entries, {}
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def piece(self, piece: str) -> bytes:
        out = self.known.get(piece)
        if out is None:
            shown = piece.encode().decode("latin-1").translate(_CHARACTERS)
            packed = self.packed
            out = b"".join([packed[t.id] for t in self.tokenize(shown)])
            if len(piece) <= LONGEST:
                if len(self.known) >= self.entries:
                    self.known.clear()
                self.known[piece] = out
        return out

    def part(self, part: str) -> bytes:
        if part.isascii():
            if self.normal:
                part = part.lower()
        elif max(part) >= _PLAIN:
            return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(part, add_special_tokens=False).ids))
        elif self.normal:
            part = self.normal(part)
        out = self.known.get(part)  # a known piece is a match of the pattern, so it is one piece here too
        if out is not None:
            return out
        word = part[1:] if part[:1] == " " else part
        if word.isalpha():
            return self.piece(part)
        if word[-1:] in _LAST and word[:-1].isalpha():
            return self.piece(part[:-1]) + self.piece(part[-1])
        return b"".join(map(self.piece, self.split(part)))


class PartCache(dict):
    """Packed ids of parts; encode gives those of one that isn't held. Looking up fills it, and a full one starts anew."""

    def __init__(self, encode: Callable[[bytes | str], bytes], entries: int = PARTS):
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, part: bytes | str) -> bytes:
        out = self.encode(part)
        if len(part) <= LONGEST:
            if len(self) >= self.entries:
                self.clear()
            self[part] = out
        return out

    def pack(self, parts: list) -> bytes:
        """Packed ids of the document that the parts make up."""
        return b"".join(map(self.__getitem__, parts))
