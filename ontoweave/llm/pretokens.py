"""Splitting texts into the pre-tokens that a tokenizer file's own library would make.

The library splits exactly but slowly. Where every character of a text lies below U+0240
(Latin letters, whose classes are the same in every regular-expression engine), an
equivalent pattern of the standard library does the same several times faster; any other
text goes through the library. Special tokens inside a text are taken out first, as the
library does by default; each is a pre-token of its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

#: Largest UTF-8 byte of texts whose characters all lie below U+0240.
LATIN = 0xC8


def _class(first: str) -> str:
    """The characters below U+0240 in one Unicode category, as the inside of a class."""
    return "".join(f"\\u{c:04x}" for c in range(0x240) if unicodedata.category(chr(c))[0] == first)


L, N, S = _class("L"), _class("N"), r"\t-\r\x20\x85\xa0"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# The two patterns of the tokenizer files, with their classes spelled out for Latin text.
BYTE_LEVEL = re.compile(rf"{SHORT}| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
WORD_END = re.compile(rf"{SHORT}|[{L}]+|[{N}]|[^{S}{L}{N}]+")
SPACES = re.compile(rf"[{S}]+")


def latin(encoded: bytes) -> bool:
    return not encoded or max(encoded) <= LATIN if len(encoded) < 64 else _latin_long(encoded)


def _latin_long(encoded: bytes) -> bool:
    import numpy as np

    return int(np.frombuffer(encoded, np.uint8).max()) <= LATIN


class Splitter:
    """The pre-tokens of texts for one tokenizer file, in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = [t["content"] for t in described["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = set(special)
        normal = json.dumps(described["normalizer"])
        split = json.dumps(described["pre_tokenizer"])
        # Only the two known kinds of file have a pattern here; others go through the library.
        self.kind = None
        if described["normalizer"] is None and '"use_regex": true' in split and '"add_prefix_space": false' in split:
            self.kind = "byte"
        elif all(k in normal for k in ('"NFC"', '"Lowercase"', r"\\s+")) and r"[\\p{N}]|[^\\s" in split:
            self.kind = "word"

    def _plain(self, text: str, encoded: bytes | None) -> list[str]:
        if self.kind == "byte" and latin(text.encode() if encoded is None else encoded):
            return BYTE_LEVEL.findall(text)
        if self.kind == "word":
            lower = text.lower()
            # NFC changes nothing below U+0300; a run of white space splits like one space.
            if latin(text.encode() if encoded is None else encoded) and latin(lower.encode()):
                return WORD_END.findall(lower)
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [text[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._plain(text, None)
        out, at = [], 0
        for match in self.special.finditer(text):
            if match.start() > at:
                out += self._plain(text[at : match.start()], None)
            out.append(match.group())
            at = match.end()
        return out + (self._plain(text[at:], None) if at < len(text) else [])

    def ids(self, words: list[str]) -> list[list[int]]:
        """The token ids of pre-tokens, each encoded for itself."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@cache
def splitter(path: str) -> Splitter:
    return Splitter(path)


def pieces(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level tokenizer file stands for; special tokens stand
    for their own text. Ids without a piece stand for nothing."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    # Byte-level files write a byte as itself where it prints, else as a letter from U+0100 on.
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
    table = dict(described["model"]["vocab"])
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    out = [b""] * (max([*table.values(), *special.values()]) + 1)
    for piece, number in table.items():
        out[number] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    for piece, number in special.items():
        out[number] = piece.encode()
    return out
