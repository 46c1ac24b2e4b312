"""Whole-text encoding with a public tokenizer file, word by word."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_BLANK = " \t\n\r\x0b\x0c"
_STOP = ".,;:!?"
#: White space with the word after it up to a stop mark, a stop mark with what follows, or white space that ends the
#: text. Both tokenizer kinds begin a new token where ASCII white space follows another character and where a stop mark
#: follows a letter or digit, so that these pieces can be encoded apart.
_PIECE = re.compile(rf"[{_BLANK}]*(?:[^{_BLANK}{_STOP}]+(?:(?<![0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])[^{_BLANK}]+)?|[{_STOP}][^{_BLANK}]*)|[{_BLANK}]+")
#: Other white space, next to which a run of blanks may be cut differently: such texts are encoded whole.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A word of plain letters and a run of marks after it, which is a pre-token of its own.
_WORD = re.compile(f"(\n?)( ?[{_LETTERS}]+)([#$%&*]*)")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells characters up to U+00FF: printable bytes stand for themselves, the others for
    the characters from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    return {ch: "".join(spelled[b] for b in chr(ch).encode()) for ch in range(256)}


class WordEncoder(dict):
    """Encodes texts by the tokenizers library and remembers the ids of words, up to ``limit`` of them: when half the limit
    is reached, these become the older half, of which those met again stay.

    The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)``. With ``special``, strings of special
    tokens in a text become those tokens, as the library does by default; without, they are ordinary text. A new word of
    plain letters goes to the library's model at once; any other new piece, and a text with unusual white space or with
    the string of an added token, goes through the whole library.
    """

    def __init__(self, path: str, limit: int = 600_000, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content] if special else []
        self.model, self.spelled, self.lowers = self.tokenizer.model, _byte_letters(), self.tokenizer.normalizer is not None
        self.half, self.older = max(1, limit // 2), {}
        self.line, self.marks = self._whole("\n"), {}
        probe = ["the", " the", "Straße", " été", "\nÜnder", "\n naïveté", "zzzyxq", " Ñandú", " été###", "\nthe$*", "Zzq&%"]
        self.direct = [self._plain(*_WORD.fullmatch(w).groups()) for w in probe] == [self._whole(w) for w in probe]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _plain(self, line: str, word: str, marks: str) -> bytes:
        word = word.strip(" ").lower() if self.lowers else word
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.translate(self.spelled))])
        ids += self._marks(marks) if marks else b""
        return self.line + ids if line else ids

    def _marks(self, marks: str) -> bytes:
        if (ids := self.marks.get(marks)) is None:
            ids = self._whole(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if self.direct and (found := _WORD.fullmatch(piece)):
                ids = self._plain(*found.groups())
            else:
                ids = self._whole(piece)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is the empty text."""
        get = self.__getitem__
        apart = lambda t: _OTHER_BLANK.search(t) or any(x in t for x in self.added)
        return [self._whole(t) if t and apart(t) else b"".join(map(get, _PIECE.findall(t or ""))) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str, limit: int) -> WordEncoder:
    """The process's encoder, with special tokens as the library finds them: tasks that run in one Python worker after
    another share what it remembers."""
    return WordEncoder(path, limit, special=True)
