"""Token ids of whole texts, with a memory for words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, "Encoder"] = {}


class Memory(dict):
    """Codes of the last words seen, in two generations of a fixed number of words.

    When the younger is full it becomes the older, and words that come up again move back to the
    younger. Forgetting a word only costs time.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def codes(self, words: list[str], encode: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The code of each of ``words``; ``encode`` gives those of new words."""
        found = list(map(self.get, words))
        missing = [i for i, code in enumerate(found) if code is None]
        if missing:
            new = {words[i] for i in missing}
            if len(self) + len(new) > self.most:
                self.older = dict(self)
                self.clear()
            again = new.intersection(self.older)
            self.update((w, self.older[w]) for w in again)
            new = list(new - again)
            self.update(zip(new, encode(new)))
            for i in missing:
                found[i] = self[words[i]]
        return found


class Encoder:
    """Ids of whole texts, encoded in parts that are remembered.

    A single space between two other characters always begins a new pre-token of this tokenizer, so
    the parts between such spaces are encoded on their own with equal result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.spaced = np.zeros(self.size, bool)  # tokens that begin with a space
        self.spaced[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.words = Memory(600_000)  # after a space

    @staticmethod
    def split(text: str) -> list[str]:
        """The text cut at spaces between two other characters; the spaces themselves are left out."""
        runs = text.split()
        if len(text) - len("".join(runs)) == len(runs) - 1:  # no white space but single, inner ones
            return text.split(" ")
        return _CUT.split(text)

    def _codes(self, texts: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in codes]

    def _after_space(self, words: list[str]) -> Iterator[bytes]:
        """Codes of words that follow a space.

        Words without a space are encoded many at a time, with a space before each: only there can a
        token begin with a space, so the ids are cut at such tokens.
        """
        plain = [" " not in w and not w[-1].isspace() for w in words]
        whole = list(compress(words, plain))
        parts = [whole[i:i + 200] for i in range(0, len(whole), 200)]
        joined = self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        cut = []
        for part, code in zip(parts, joined):
            ids = np.array(code.ids, "<u4")
            at = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            if len(at) != len(part) + 1:
                raise ValueError("this tokenizer does not begin a token at each space")
            raw = ids.tobytes()
            cut.extend(raw[a:b] for a, b in zip(at, at[1:]))
        rest = self._codes([" " + w for w, p in zip(words, plain) if not p])
        cut, rest = iter(cut), iter(rest)
        return (next(cut) if p else next(rest) for p in plain)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self.split(text) for text in texts]
        heads = self._codes([words[0] for words in parts])
        found = self.words.codes([w for words in parts for w in words[1:]], self._after_space)
        out, at = [], 0
        for head, words in zip(heads, parts):
            out.append(head + b"".join(found[at:at + len(words) - 1]))
            at += len(words) - 1
        return out


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_lists(column: pa.Array, most_chars: int = 2_000_000) -> Iterator[list[str]]:
    out, size = [], 0
    for value in column:
        text = value.as_py() or ""
        out.append(text)
        size += len(text)
        if size >= most_chars:
            yield out
            out, size = [], 0
    if out:
        yield out
