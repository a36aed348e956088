"""Token ids of a byte-level BPE vocabulary file, by tiktoken, which gives the file's own ids several times as fast.

Invented words don't repeat enough for a cache of words to pay: looking a word up takes as long as encoding it."""

from __future__ import annotations

import json

import numpy as np

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies: itself where it is printable Latin-1, else
    the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Ids equal to the vocabulary file's own tokenizer without its special tokens added; the strings of special tokens
    inside texts are those tokens, as there. Malformed UTF-8 is read with replacement characters."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, word)): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.encoding.encode(text.decode("utf-8", "replace"), allowed_special="all"), "<u4")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """The worker's tokenizer of a file; it stays for later tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]
