"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterable

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Characters whose class (letter, number, white space, other) is the same in all
#: versions of Unicode that the two libraries may carry: ASCII and Latin.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


class ByteBpe:
    """ids as the vocabulary's library gives them with add_special_tokens=False.

    A special token's string in a text (``<|endoftext|>``) is that token, as the
    library has it; with ``literal`` it is ordinary text.

    The same vocabulary lies beside it as ranks (``.tiktoken``), which the other
    public library encodes five times as fast and with the same ids. It serves
    the texts of ASCII and Latin characters without such strings, about which the
    two can't differ; all others, or all where there are no ranks, go to the first.
    """

    def __init__(self, path: str, literal: bool = False) -> None:
        self.path, self.literal, self._slow = path, literal, None
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        added = content.get("added_tokens", [])
        self.specials = [x["content"] for x in added]
        #: One more than the largest id.
        self.size = 1 + max([x["id"] for x in added] + list(content["model"]["vocab"].values()))
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def tokenizer(self):
        """The vocabulary's own library, loaded for the first text that needs it."""
        if self._slow is None:
            # Spark runs a worker per core; the library's own threads only contend.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = self.literal
        return self._slow

    def one(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.fast is not None and not _PLAIN.search(text) and (self.literal or not any(x in text for x in self.specials)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null is the empty text."""
        return [self.one(t) for t in texts]


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str, literal: bool = False) -> ByteBpe:
    """One encoder for all tasks that a worker process runs."""
    return ByteBpe(path, literal)
