"""Byte-level BPE: token ids of whole texts, and the bytes that each token stands for."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END_OF_TEXT = "<|endoftext|>"


def default_vocabulary() -> str:
    """Path of the rank file of the 50k vocabulary: the same ids as its tokenizer file, read by a faster library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """ids(text): token ids without any added; the end-of-text string is its own token, as in the tokenizer file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(ranks.values()) + 2
        special = {END_OF_TEXT: size - 1}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.lengths[size - 1] = len(END_OF_TEXT)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return self._encoding.encode_to_numpy(text, allowed_special={END_OF_TEXT}, disallowed_special=())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    return Vocabulary(path)
