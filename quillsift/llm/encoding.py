"""Token ids of whole texts, inside tasks.

A byte-level BPE splits a text by its own pattern and merges inside each piece only, and a single
space between two visible characters always starts a new piece. So a text can be cut there, each
different piece be encoded once by the tokenizer, and its ids be looked up after that. Tokenizers of
any other make get the whole text.
"""

from __future__ import annotations

import json
import os
import re
from string import punctuation

import numpy as np
import pyarrow as pa

# Of a cache: what drops out of it is encoded again.
CACHE_PIECES = 400_000
CACHE_BYTES = 48 << 20
# White space other than blanks and line ends: such texts are cut by pattern.
OTHER_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
CUT = re.compile(r"(?<=\S) (?=\S)")
# A single line end between visible characters is a piece of its own, and so is a run of signs after letters.
LINE = re.compile(r"(?<=\S)\n(?=\S)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {byte: chr(byte) if byte in printable else chr(next(others)) for byte in range(256)}


BYTE_LETTERS = _byte_letters()


class Pieces(dict):
    """Piece to ids as encoded after ``lead``; looks up, and learns what it lacks.

    Two generations: when this one is full it becomes the old one, from which pieces still in use move back.
    """

    def __init__(self, tokenizer, lead: str, packed: list[bytes], unled: Pieces | None = None):
        super().__init__()
        self.unled = self if unled is None else unled  # for what follows inside a piece
        self.tokenizer, self.lead, self.old, self.size = tokenizer, lead, {}, 0
        self.model, self.letter = tokenizer.model, lead.translate(BYTE_LETTERS)
        self.packed = packed

    def turned(self, unled: Pieces | None = None) -> Pieces:
        if len(self) < CACHE_PIECES and self.size < CACHE_BYTES:
            self.unled = self if unled is None else unled
            return self
        young = Pieces(self.tokenizer, self.lead, self.packed, unled)
        young.old, self.old = self, {}
        return young

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) if self.old else None
        if ids is None:
            # Letters are one piece of the pattern, which the model can merge directly.
            if piece.isalpha():
                data = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = b"".join([self.packed[token.id] for token in self.model.tokenize(self.letter + data)])
            elif "\n" in piece and len(lines := LINE.split(piece)) > 1:
                end = self.unled["\n"]
                return self[lines[0]] + b"".join([end + self.unled[line] for line in lines[1:]])
            elif (word := piece.rstrip(punctuation)).isalpha():
                ids = self[word] + self.unled[piece[len(word):]]
            else:
                ids = _encoded(self.tokenizer, self.lead + piece)
        self[piece] = ids
        self.size += len(piece) + len(ids)
        return ids


def _encoded(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        self.by_piece = (
            made["model"].get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and made.get("normalizer") is None
        )
        packed = [i.to_bytes(4, "little") for i in range(self.vocabulary)]
        self.first = Pieces(self.tokenizer, "", packed)
        self.later = Pieces(self.tokenizer, " ", packed, self.first)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text; none for a null or empty one."""
        if not text:
            return b""
        if not self.by_piece:
            return _encoded(self.tokenizer, text)
        # A blank at the text's bounds or next to other white space starts no piece of its own.
        rough = (text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text
                 or any(space in text for space in OTHER_SPACES))
        head, *pieces = CUT.split(text) if rough else text.split(" ")
        self.first = self.first.turned()
        self.later = self.later.turned(self.first)
        return self.first[head] + b"".join(map(self.later.__getitem__, pieces))

    def rest(self) -> None:
        """At a task's end: the worker may go on to other work, so only the young generation stays."""
        self.first.old, self.later.old = {}, {}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")


def texts_of(batch: pa.RecordBatch, name: str):
    """The texts of a batch one by one, so that only one is held twice."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()
