"""Byte-level BPE ids for whole texts."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """ranks: a file of base64 tokens and ranks; special: strings that stand for one id wherever they occur."""

    def __init__(self, ranks: str, special: dict[str, int]):
        import public_tokenizers

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = {k: np.array([v], np.uint32) for k, v in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        #: Bytes that each id stands for.
        self.byte_lengths = np.zeros(max([*table.values(), *special.values()]) + 1, np.int64)
        for token, i in table.items():
            self.byte_lengths[i] = len(token)
        for token, i in special.items():
            self.byte_lengths[i] = len(token.encode())

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def array(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if any(s in text for s in self.special):
            return np.concatenate([self.special[x] if x in self.special else self._plain(x) for x in self.split.split(text)])
        return self._plain(text)

    def ids(self, text: str) -> bytes:
        """All ids of a text, four little-endian bytes each."""
        return self.array(text).astype("<u4", copy=False).tobytes()


@lru_cache(2)
def gpt_bytes(ranks: str | None = None) -> ByteBpe:
    """The 50,257-id byte-level vocabulary; its end-of-text string is one id, as the vocabulary's own library has it."""
    return ByteBpe(ranks or vocabulary_path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
