"""Tokenizing with a public tokenizer, and counting what comes out."""

from __future__ import annotations

import json
import os
import re
import struct

import regex
from tokenizers import Tokenizer

#: Words and pieces that one Python worker keeps; past that, further ones are encoded each time.
KEPT_WORDS, KEPT_PIECES = 700_000, 400_000
#: The set-up of a tokenizer whose pieces ``WordPieces`` finds by itself.
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Printable ASCII and Latin letters that NFC leaves alone and that lower-case one by one; no "<", which may begin a special token.
PLAIN = re.compile("[!-;=-~¡-¬®-įĲ-ž]+")


def byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself if printable, else one past 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """The ids of each white-space separated word, as packed 32-bit integers.

    White space parts pieces in this kind of tokenizer, so the ids of a text are those of its words
    one after the other. A word is encoded when first asked for.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.pieces = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = spec.get("normalizer") == LOWER and splits[0].get("pattern") == {"Regex": SPLIT} and spec["model"]["type"] == "BPE" and not spec.get("post_processor")
        self.split, self.letters = regex.compile(SPLIT), byte_letters()

    def piece(self, p: str) -> bytes:
        found = self.pieces.get(p)
        if found is None:
            letters = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            found = packed([t.id for t in self.tokenizer.model.tokenize(letters)])
            if len(self.pieces) < KEPT_PIECES:
                self.pieces[p] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.known and PLAIN.fullmatch(text):
            found = b"".join(map(self.piece, self.split.findall(text.lower())))
        else:
            found = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, packed; bytes.split parts at ASCII white space only, the tokenizer does the rest."""
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """This worker's table for the tokenizer file ``path``."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]
