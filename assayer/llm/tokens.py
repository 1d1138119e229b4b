"""Token ids of the word tokenizer, word by word: words seen before come from a bounded cache.

The tokenizer cuts a text into words first and encodes each by itself, so the
ids of a text are the ids of its words joined. Texts with characters outside
the Latin blocks (where normalisation could reach across words), letters whose
small form lies outside them, control characters that the two regex engines
class apart, or the names of special tokens go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

_LATIN = [chr(c) for c in range(0x250)]
_KNOWN = frozenset(_LATIN)
_BLANK = "\t\n\x0b\x0c\r"
_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_PLAIN = re.compile(f"[{re.escape(''.join(c for c in _LATIN if (c in _BLANK or ' ' <= c <= '~' or c >= '\xa1') and c.lower() in _KNOWN))}]*")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """encode(text) gives little-endian unsigned 32-bit ids as bytes, without special tokens added."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache: dict[str, bytes] = {}
        self.most = most
        letters = _byte_letters()
        self.letters = {ord(c): "".join(letters[b] for b in c.encode()) for c in _LATIN}

    def _word(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))], "<u4").tobytes()
        if len(self.cache) < self.most:
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _WORDS.findall(text.lower())
        found = list(map(self.cache.get, words))
        if None in found:
            found = [x if x is not None else self._word(w) for x, w in zip(found, words, strict=True)]
        return b"".join(found)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that its cache lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
