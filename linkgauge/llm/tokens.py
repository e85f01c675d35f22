"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import functools
import re
import struct
import unicodedata

# chunks between ASCII spaces in which case folding and composition need no context
_PLAIN = re.compile(r"[!-;=-~À-įĲ-ɏ]+")


def default_tokenizer() -> str:
    """Path of the word-level byte-pair vocabulary with 49k entries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=1)
def worker_tokens(path: str) -> TokenBytes:
    """The one tokenizer of this Python worker, with what it remembers from earlier tasks."""
    return TokenBytes(path)


class TokenBytes:
    """Little-endian unsigned 32-bit ids of a text as bytes.

    The tokenizer never joins what white space parts, so a text's ids are those of its chunks one after
    the other. Chunks and their pieces are remembered, and the memo is emptied when it is full.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        import json

        import regex

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        spec = json.load(open(path, encoding="utf-8"))
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        # other kinds of files go through the library text by text
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed"
        self.find = regex.compile(split["pattern"]["Regex"]).findall if self.by_word else None
        self.byte_text = _byte_alphabet()
        self.chunks, self.parts, self.most = _Memo(self._chunk, most), _Memo(self._part, most), most

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return _pack(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split(" "))) if "\n" not in text else b"".join(
            [b"".join(map(self.chunks.__getitem__, line.split(" "))) for line in text.split("\n")])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii() and "<" not in chunk or _PLAIN.fullmatch(chunk) and unicodedata.is_normalized("NFC", chunk):
            low = chunk.lower()
            if low.isalpha():
                return self.parts[low]
            if low[-1] in ".," and low[:-1].isalpha():
                return self.parts[low[:-1]] + self.parts[low[-1]]
            return b"".join([self.parts[part] for part in self.find(low)])
        return _pack(self.whole.encode(chunk, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if not part.isalnum() or not part.isascii():
            part = part.encode().decode("latin-1").translate(self.byte_text)
        return _pack([t.id for t in self.whole.model.tokenize(part)])


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) < 64:  # long chunks seldom come again
            self[key] = value
        return value


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
