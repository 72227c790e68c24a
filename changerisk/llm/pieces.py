"""Token ids of whole texts by the tokenizers library, encoding each distinct piece of text once.

A text is cut where the tokenizer's own pre-tokenizer is certain to cut as well, so the ids of the
pieces, joined, are the ids of the text: before a space between two characters that are no white
space, around a line end between such, and between a letter and a punctuation mark. Prose repeats
its words, so a worker's memo answers most pieces and the library sees what is new. The memo is
bounded: when full it keeps what it has, and starts afresh once it has missed four times as often
as it holds pieces. A text that holds one of the tokenizer's added tokens goes to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Bounds of a worker's memo: pieces, and characters of a piece.
MEMO_PIECES = 600_000
MEMO_CHARS = 48

#: Stands before a piece that has no space before it.
_JOINED = "\x01"

#: Kinds of Latin-1 characters: a letter or digit, a full stop or comma, another mark, a space or
#: line end, and what is a certain cut for no library.
_KINDS = bytes(
    ord("a" if chr(c).isalnum() else "." if chr(c) in ".," else " " if chr(c) in " \n"
        else "!" if 0x20 < c < 0x7F or c > 0xA0 else "?")
    for c in range(256)
)

#: Where a full stop, comma, space or line end alone is no certain cut: beside another, after white space.
_UNSURE = (b"..", b".!", b"!.", b"!!", b"  ", b" .", b"?")

#: Letters that are single code points in every normal form, with one small letter each.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

#: The certain cuts of any text.
_CUTS = re.compile(
    r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])"
)


def byte_characters() -> list[str]:
    """The byte table: printable Latin-1 bytes stand for themselves, the others from U+0100 upwards."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return [chr(byte) if byte in shown else chr(0x100 + hidden.index(byte)) for byte in range(256)]


def _sure(text: str) -> bool:
    """Whether every full stop, comma, space and line end of a Latin-1 text is a certain cut."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return False
    return not any(found in kinds for found in _UNSURE)


class PieceEncoder:
    """Ids of texts as packed little-endian unsigned integers of 2 or 4 bytes.

    ``spaced``: a piece is encoded with the space before it; else white space has no ids and
    capitals do not matter.
    """

    def __init__(self, tokenizer: Tokenizer, kind: str = "<u4", spaced: bool = True) -> None:
        self.tokenizer, self.kind, self.spaced = tokenizer, kind, spaced
        self.code = {"<u4": "I", "<u2": "H"}[kind]
        self.table = byte_characters()
        self.added = [token.content.lower() for token in tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.missed = 0

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text, each without its space, or after ``_JOINED`` where it has none."""
        if not _sure(text):
            return [piece[1:] if piece[:1] == " " else _JOINED + piece for piece in _CUTS.split(text)]
        if self.spaced:
            text = text.replace("\n", " \x01\n \x01")
            return (_JOINED + text.replace(".", " \x01.").replace(",", " \x01,")).split(" ")
        return text.replace("\n", " ").replace(".", " . ").replace(",", " , ").split(" ")

    def _whole(self, piece: str) -> str:
        """What the library encodes for a piece."""
        if piece[:1] == _JOINED:
            return piece[1:]
        return " " + piece if self.spaced else piece

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: words of letters go straight to the model, others through the whole tokenizer."""
        found, others = {}, []
        tokenize, table, code = self.tokenizer.model.tokenize, self.table, self.code
        for piece in pieces:
            whole = piece.lower() if not self.spaced else piece
            if _LETTERS.fullmatch(whole):
                written = whole if whole.isascii() else "".join([table[b] for b in whole.encode()])
                if self.spaced:
                    written = table[32] + written
                found[piece] = array(code, [token.id for token in tokenize(written)]).tobytes()
            else:
                others.append(piece)
        encoded = self.tokenizer.encode_batch_fast([self._whole(p) for p in others], add_special_tokens=False)
        found.update((piece, array(code, e.ids).tobytes()) for piece, e in zip(others, encoded))
        return [found[piece] for piece in pieces]

    def packed(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        low = text.lower() if self.added else ""
        if _JOINED in text or any(token in low for token in self.added):
            return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        pieces = self._cut(text)
        memo = self.memo
        try:
            return b"".join([memo[piece] for piece in pieces])
        except KeyError:
            pass
        new = list({piece for piece in pieces if piece not in memo})
        fresh = dict(zip(new, self._encode(new)))
        if len(memo) + len(fresh) <= MEMO_PIECES:
            memo.update((p, ids) for p, ids in fresh.items() if len(p) <= MEMO_CHARS)
        else:
            self.missed += len(fresh)
        ids = b"".join([fresh[p] if p in fresh else memo[p] for p in pieces])
        if self.missed > 4 * MEMO_PIECES:
            memo.clear()
            self.missed = 0
        return ids

    def with_offsets(self, text: str) -> tuple[bytes, list[tuple[int, int]]]:
        """Ids and, per id, the first and the past-the-end character of the text it covers.

        A character cut into several tokens is covered by each of them.
        """
        at, ids, offsets = 0, [], []
        pieces = _CUTS.split(text)
        for piece, encoding in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False)):
            ids.extend(encoding.ids)
            offsets.extend((start + at, end + at) for start, end in encoding.offsets)
            at += len(piece)
        return np.array(ids, self.kind).tobytes(), offsets
