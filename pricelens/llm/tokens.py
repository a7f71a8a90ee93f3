"""Sizes and ids of texts in the tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Ranks of the default tokenizer; any file of the same format will do.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Texts are cut into pieces of this many characters at a line end or blank before they are encoded: encoding time grows
#: faster than length on texts without blanks.
PIECE = 20_000


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER_FILE):
    """The tokenizer of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = TOKENIZER_FILE) -> np.ndarray:
    """The token ids of a whole text."""
    tokenizer = encoding(path)
    text = text.encode("utf-8", "replace").decode()
    if len(text) <= PIECE:
        return np.asarray(tokenizer.encode_ordinary(text), dtype="int32")
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind("\n", at + 1, end), text.rfind(" ", at + 1, end))
            end = cut if cut > at else end
        parts += tokenizer.encode_ordinary(text[at:end])
        at = end
    return np.asarray(parts, dtype="int32")
