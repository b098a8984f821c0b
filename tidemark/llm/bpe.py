"""Byte-level BPE ids by the tokenizers library, at the speed of a dictionary.

The pre-tokenizer's pattern cuts a text into pre-tokens whose ids don't depend on each other. One always starts at a space
that no white space follows, and one ends before and after each run of white space but for that space; so a text may first
be cut at spaces and line ends, and the pattern applied to each word. Each distinct word is cut and encoded by the library
once and kept. Runs of three or more white spaces, or of two at the end, and other white space than spaces and line ends
take a pattern instead (RUNS); texts with characters beyond SAFE, where the pattern engines' Unicode tables could differ, are
handed to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import public_tokenizers

from .common import store

FILE = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of words and their ids that a worker keeps, about; the store is emptied beyond that.
KEPT_BYTES = 160 << 20
ENTRY_BYTES = 190
#: Byte-level BPE's letter for a space.
SPACE_LETTER = chr(256 + 32)
#: Latin letters, common punctuation and currency signs: nothing whose class changed between Unicode versions; and of them
#: those that the short way takes.
SAFE = re.compile("[\x00\x02-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]*")
SHORT = re.compile("[\n\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]*")
RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
PAIRS = ("  ", "\n\n", " \n", "\n ")
TRIPLES = re.compile(r"[ \n]{3}|[ \n]{2}\Z")
#: In front of a word: no space is.
BARE = "\x01"
TAIL = ".,;:!?&#%*$\"')]}-…»”"


def file_path(name: str = FILE) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder(dict):
    """Word -> bytes of its ids, little-endian unsigned 16-bit (``dtype`` for larger vocabularies 32-bit)."""

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.kept, self.held = kept, 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.format = "<%d" + self.dtype.char
        self.cut = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        """Of a word with a space in front, or without if it starts with BARE, or of a line end."""
        out = self._encoded(word[1:] if word[:1] == BARE else word if word == "\n" else f" {word}")
        self.held += ENTRY_BYTES + len(word) + len(out)
        if self.held > self.kept:
            self.clear()
            self.held = 0
        self[word] = out
        return out

    def _encoded(self, piece: str) -> bytes:
        core = piece.rstrip(TAIL)
        if core[piece[:1] == " " :].isalpha():  # a pre-token of letters, and one of what follows it
            parts = [core, piece[len(core) :]] if len(core) < len(piece) else [core]
        else:
            parts = self.cut(piece)
        ids = []
        for part in parts:
            letters = part.replace(" ", SPACE_LETTER) if part.isascii() and part.isprintable() else part.encode("utf-8").decode("latin-1").translate(self.alphabet)
            ids += [t.id for t in self.tokenize(letters)]
        return struct.pack(self.format % len(ids), *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _words(self, text: str) -> list[str]:
        if SHORT.fullmatch(text) and not (any(p in text for p in PAIRS) and TRIPLES.search(text)):
            return (BARE + text).replace("\n", f" \n {BARE}").split(" ")
        return [x[1:] if x[0] == " " and not x.isspace() else x if x == "\n" else BARE + x for x in RUNS(text)]

    def ids(self, text: str | None, end: bool = True) -> np.ndarray:
        """All ids of a text, null as empty, with the end id appended."""
        text = text or ""
        body = b"".join(map(self.__getitem__, self._words(text))) if SAFE.fullmatch(text) else self._whole(text)
        if end:
            body += END_ID.to_bytes(self.dtype.itemsize, "little")
        return np.frombuffer(body, self.dtype)


@functools.cache
def encoder_dtype(path: str) -> np.dtype:
    """How a file's ids are written."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def encoder(path: str, kept: int = KEPT_BYTES) -> Encoder:
    return store(("bpe", path, kept), lambda: Encoder(path, kept))
