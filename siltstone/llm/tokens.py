"""Byte-level BPE with a public vocabulary, cut at spaces so that repeated words are encoded once.

A pre-token of the vocabulary's pattern takes at most one space, before it, so the text may be cut before any space that
has a character other than white space on one of its sides, and the ids of the parts are those of the whole. Where a text
holds an added token of the vocabulary (such as an end mark) literally, that has an id of its own, as in the tokenizers
library; such texts are encoded whole."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def vocabulary_path() -> str:
    """The default vocabulary of the box's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added(path: str) -> dict[str, int]:
    """Added tokens of a .json vocabulary, which stand for themselves wherever a text holds them; .tiktoken files have none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        entries = json.load(file).get("added_tokens") or []
    if odd := [e["content"] for e in entries if any(e.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized"))]:
        raise ValueError(f"added tokens with matching rules are not supported: {odd}")
    return {e["content"]: e["id"] for e in entries}


def encoding(path: str):
    """A tiktoken encoding of the vocabulary at `path` (.tiktoken ranks, or a .json whose ranks lie beside it)."""
    import public_tokenizers
    import tiktoken

    with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added(path))


class _Parts(dict):
    """Ids (two bytes each) of ' ' + part; parts beyond `most` entries are encoded each time."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encode(" " + part), dtype="<u2").tobytes()
        if len(self) < self.most and len(part) < 40:
            self[part] = ids
        return ids


class Tokens:
    def __init__(self, path: str, most: int = 150_000):
        self._encoding = encoding(path)
        self._marks = sorted(self._encoding.special_tokens_set)
        self._parts = _Parts(self._encode, most)

    def _encode(self, text: str) -> list[int]:
        if any(mark in text for mark in self._marks):
            return self._encoding.encode(text, allowed_special="all")
        return self._encoding.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        """As tokenizers gives them with add_special_tokens=False."""
        if _UNSAFE.search(text) or any(mark in text for mark in self._marks):
            return np.array(self._encode(text), dtype="<u2")
        first, *rest = text.split(" ")
        return np.frombuffer(np.array(self._encode(first), dtype="<u2").tobytes() + b"".join(map(self._parts.__getitem__, rest)), dtype="<u2")

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of ' ' + part for each part."""
        get = self._parts.__getitem__
        return [len(get(p)) >> 1 for p in parts]

    def count(self, text: str) -> int:
        return len(self.ids(text))


_of: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process."""
    if path not in _of:
        _of[path] = Tokens(path)
    return _of[path]
