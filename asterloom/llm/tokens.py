"""Token ids of the public byte-level BPE vocabulary.

``tiktoken`` gives the same ids as ``tokenizers`` and is several times faster;
a text that spells out a special token goes to ``tokenizers``, which knows it.
The vocabulary's files are a parameter and are read where the ids are made.
"""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """A function from a text to its ids, without special tokens added."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or vocabulary_path()
    exact = Tokenizer.from_file(path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    ranks_file = Path(path).with_suffix(".tiktoken")
    if not ranks_file.exists():
        return lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
