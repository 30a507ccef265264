"""Byte-level BPE of a public ``tokenizers`` file.

The vocabulary is read from the file and run by tiktoken's encoder, whose ids
are those of ``tokenizers`` at a fraction of the time.  Texts its pattern engine
gives up on (very long runs of white space) go to ``tokenizers`` itself.

A pre-token's ids do not depend on its neighbours, so counts can be kept by
pre-token.  PATTERN cuts texts as the tokenizer does.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Pre-tokens whose counts are kept; at so many they are forgotten.
CACHE = 500_000
#: White space of the tokenizer's pattern engine, which takes no information separators for it.
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NO_SPACE = SPACE.replace("[", "[^", 1)
#: The public byte-level pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = regex.compile(BYTE_LEVEL.replace(r"\s", SPACE).replace(r"\S", NO_SPACE).replace("[^" + SPACE, "[^" + SPACE[1:-1]))
#: Characters that are letters in one of the engines' versions of Unicode alone, and their neighbours.
UNSURE = re.compile("[\u0558-\u058c\u088f\u0c5c-\u0cdc\u208f-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U000107bb-\U0001e6ff\U0002b73a-\U0010ffff]")
_BYTE_LEVEL = ByteLevel(add_prefix_space=False, use_regex=True)
END_OF_TEXT = 2


def cut(text: str) -> list[str]:
    """The pre-tokens of a text, as the tokenizer cuts it."""
    if UNSURE.search(text):
        return [text[a:b] for _, (a, b) in _BYTE_LEVEL.pre_tokenize_str(text)]
    return PATTERN.findall(text)


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class PretokenEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        special = {t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.path, self._plain = path, None
        self.cache: dict[str, int] = {}

    @property
    def plain(self) -> Tokenizer:
        if self._plain is None:
            self._plain = Tokenizer.from_file(self.path)
            self._plain.encode_special_tokens = True  # their strings in a text are ordinary text
        return self._plain

    def whole(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text; null is empty."""
        if not text:
            return b""
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # the pattern engine's backtracking limit
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pretokens: set[str]) -> None:
        """Count the tokens of what the cache does not hold."""
        new = pretokens.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = pretokens
        for p in new:
            self.cache[p] = len(self.whole(p)) // 4

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return [self.whole(t) for t in texts]


_encoders: dict[str, PretokenEncoder] = {}


def encoder(path: str) -> PretokenEncoder:
    """One encoder a Python worker and file."""
    if path not in _encoders:
        _encoders[path] = PretokenEncoder(path)
    return _encoders[path]
