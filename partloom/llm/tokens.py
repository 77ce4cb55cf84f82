"""Exact, cached encoding of whole texts with a public tokenizer file of the tokenizers library.

The library splits a text into pre-tokens before it applies its merges, and no pre-token of the
BPE files crosses a single space, or a single line feed, that stands between two characters which
are not white space.  So a text can be cut there, each chunk encoded on its own by the library,
and the ids joined.  Chunks repeat, so their ids are remembered; memory is bounded by two
generations of at most ``capacity`` chunks: a full young one becomes the old one, and what is
still used moves back.  A text with any other white space takes a slower cut at the same places.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Longer chunks are encoded but not remembered.
LONGEST_KEPT = 48
_OWN_STOPS = ("\x02", "\x03")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_STOPS = ("..", ",,", ".,", ",.")
_RARE_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RARE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Letters of one pre-token, then marks of another one.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?()#*$%&|<>/\"-]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches, rows: int = 512):
    """The batches in parts of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1 ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class CachedEncoder:
    """Text to little-endian unsigned 32-bit ids, equal to ``encode(text, add_special_tokens=False)``.

    A null text counts as empty and gives no ids.
    """

    def __init__(self, path: str, capacity: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spaced = self.tokenizer.normalizer is None  # byte-level BPE: a space belongs to the word after it
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.feed = self._whole("\n") if self.spaced else b""
        self.capacity = capacity
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        #: chunks that do not end with a letter or digit, so that a stop after them would not stand alone
        self.closed: set[str] = {""}

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "\x02" in text or "\x03" in text:  # signs that chunks use for themselves
            return self._whole(text)
        if self.spaced:
            if not self._simple(text):
                head, *rest = _BETWEEN.split(text)
                return b"".join([self._whole(head), *self._ids([x if _PLAIN.fullmatch(x) else " " + x for x in rest])])
            # a chunk is a word after a space, or a line feed and a word
            marked = f"\n{text}".replace("\n", " \n")
            if not any(x in text for x in _STOPS):
                # full stops and commas after a letter or digit are chunks of their own, so fewer kinds are met
                chunks = marked.replace(".", " \x02").replace(",", " \x03").split(" ")[1:]
                ids = self._ids(chunks)
                if self.closed.isdisjoint(chunks):  # asked when all chunks are learnt
                    return b"".join(ids)[len(self.feed) :]
            return b"".join(self._ids(marked.split(" ")[1:]))[len(self.feed) :]
        return b"".join(self._ids(text.replace("\n", " ").split(" ")))

    @staticmethod
    def _simple(text: str) -> bool:
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS):
            return False
        return not any(x in text for x in _RARE_ASCII) and (text.isascii() or not any(x in text for x in _RARE))

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.young.get, chunks))
        if None in found:
            learn, get = self._learn, self.young.get
            for i, f in enumerate(found):
                if f is None:
                    found[i] = get(chunks[i]) or learn(chunks[i])
            if len(self.young) >= self.capacity:
                self.old, self.young = self.young, {}
                if len(self.closed) > self.capacity:  # only chunks of the two generations can be met unlearnt
                    self.closed = {c for c in self.closed if c in self.old} | {""}
        return found

    def _learn(self, chunk: str) -> bytes:
        if self.spaced and chunk.isalpha() and chunk.isascii():  # byte-level BPE writes a space as this letter
            ids = self.old.get(chunk)
            if ids is None:
                four = self.four
                ids = b"".join([four[x.id] for x in self.tokenize("\u0120" + chunk)])
            if len(chunk) <= LONGEST_KEPT:
                self.young[chunk] = ids
            return ids
        if chunk[:1] in _OWN_STOPS:
            # what follows a stop without a space belongs to the word after it, not to a stop
            ids = self._whole((".", ",")[chunk[0] == "\x03"] + chunk[1:])
            if not (chunk[1:] or "a")[-1].isalnum():
                self.closed.add(chunk)
            if len(chunk) <= LONGEST_KEPT:
                self.young[chunk] = ids
            return ids
        if not chunk[-1:].isalnum():
            self.closed.add(chunk)
        ids = self.old.get(chunk)
        if ids is None:
            plain = _PLAIN.fullmatch(chunk, 1 if self.spaced and chunk[:1] == "\n" else 0)
            if plain is None:
                ids = self._whole(chunk if not self.spaced or chunk[:1] in "\n " else " " + chunk)
            elif plain[2]:
                ids = self._known(chunk[: plain.end(1)]) + self._known(plain[2], True)
            elif not self.spaced:
                ids = self._word(chunk.lower())
            elif chunk[0] == "\n":
                ids = self.feed + self._word(chunk[1:])
            else:
                ids = self._word(" " + chunk)
        if len(chunk) <= LONGEST_KEPT:
            self.young[chunk] = ids
        return ids

    def _known(self, chunk: str, marks: bool = False) -> bytes:
        if marks:  # a pre-token without a space before it
            if chunk not in self.marks and len(self.marks) < 4096:
                self.marks[chunk] = self._word(chunk)
            return self.marks.get(chunk) or self._word(chunk)
        return self.young.get(chunk) or self._learn(chunk)

    def _word(self, word: str) -> bytes:
        """One pre-token, straight to the library's model."""
        four = self.four
        if word.isascii() and word.isalpha():  # letters that stand for themselves
            return b"".join([four[x.id] for x in self.tokenize(word)])
        return b"".join([four[x.id] for x in self.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str, capacity: int = 300_000) -> CachedEncoder:
    """The encoder of this Python worker for the file; workers are reused, and so are its chunks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path, capacity)
    return _ENCODERS[path]
