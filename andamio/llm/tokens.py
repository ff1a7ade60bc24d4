"""Pre-tokens and their ids under a byte-level BPE tokenizer file, for use inside tasks."""

from __future__ import annotations

import array
import re
from collections.abc import Iterable

import numpy as np
import public_tokenizers

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

# The published split pattern of this family of tokenizers, for the regex module.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same split for the quicker re module, in texts of the characters below: letters up to
# U+024F, 0-9, ASCII blanks, and signs; no fractions, superscripts, control characters.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PLAIN_SPLIT = rf" ?[{LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
PLAIN = "[\t-\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿]*"

#: Pre-tokens whose ids a task remembers, in each of two generations.
REMEMBERED = 200_000


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in this family's vocabularies.

    Printable bytes stand for themselves, the others for U+0100 and on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


class Splitter:
    """Cuts texts into special strings and pre-tokens as the tokenizer does."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        plain = type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        if self.tokenizer.normalizer is not None or not plain:
            raise ValueError(f"{path}: only byte-level tokenizers that split by the pattern of this module, without a normaliser, are counted by pre-tokens")
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._plain = re.compile(PLAIN).fullmatch
        self._quick = re.compile(PLAIN_SPLIT).findall
        self._exact = regex.compile(SPLIT).findall
        self._merge = self.tokenizer.model.tokenize
        self._letters = _byte_letters().__getitem__
        self._blank = self._letters(ord(" "))

    def pieces(self, text: str) -> list[str]:
        return self._quick(text) if self._plain(text) else self._exact(text)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many special strings stand between them."""
        if self._special is None or not any(s in text for s in self.special):
            return self.pieces(text), 0
        cut = self._special.split(text)
        return [p for between in cut[::2] for p in self.pieces(between)], len(cut) // 2

    def ids(self, piece: str) -> list[int]:
        """The library's ids of one pre-token, which needs no further splitting."""
        # Printable ASCII stands for itself, but for the blank.
        quick = piece.isascii() and piece.isprintable()
        return [t.id for t in self._merge(piece.replace(" ", self._blank) if quick else "".join(map(self._letters, piece.encode())))]

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(self.ids(p)) for p in pieces]


class Ids(dict):
    """Pre-token -> its ids as little-endian uint32 bytes.

    What was met lately is kept: a full generation becomes the older one, from which
    entries come back when they are met again.
    """

    def __init__(self, splitter: Splitter):
        super().__init__()
        self.splitter, self.older = splitter, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array.array("I", self.splitter.ids(piece)).tobytes()
        # A long pre-token is seldom seen again.
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def of(self, text: str) -> np.ndarray:
        s = self.splitter
        if s._special is not None and any(x in text for x in s.special):
            cut = s._special.split(text)
            found = [np.uint32(s.special[x]).tobytes() if n % 2 else b"".join(map(self.__getitem__, s.pieces(x))) for n, x in enumerate(cut)]
            return np.frombuffer(b"".join(found), "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, s.pieces(text))), "<u4")


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """One splitter for each file and worker."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def ids(path: str) -> Ids:
    """The ids that one task remembers; they go with the task, as workers live on."""
    return Ids(splitter(path))


def rows(batches: Iterable, *columns: str) -> Iterable[tuple]:
    """The rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        # Small slices, as a batch of long texts would be in memory three times.
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)
