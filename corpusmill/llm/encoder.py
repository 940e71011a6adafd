"""Token ids by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Texts of these characters only: both libraries below class them alike. No control character, no odd space.
_COMMON = re.compile("[\t\n\r -~¡-¬®-ɏ]*")
#: Longest word and most surplus white space that the quick library is given; beyond that its matcher may grow or give up.
_LONG_WORD, _SURPLUS_SPACE = 1_000, 400


class ByteEncoder:
    """Ids as tokenizers gives them for the file, with add_special_tokens=False.

    tiktoken holds the same vocabulary as ranks and is some four times as fast. It takes the texts for which both agree by
    construction: common characters, no special token's string, no very long word or run of blanks; tokenizers takes the rest.
    """

    def __init__(self, path: str, ranks_path: str | None) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and _COMMON.fullmatch(text) and not any(s in text for s in self.special):
            words = text.split()
            inside = sum(map(len, words))
            if max(map(len, words), default=0) <= _LONG_WORD and len(text) - inside - len(words) <= _SURPLUS_SPACE:
                return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(name: str, ranks_name: str | None) -> ByteEncoder:
    """One per process. Names are files of the installed vocabularies, or paths."""
    import public_tokenizers

    place = lambda x: x if x is None or os.path.isabs(x) else public_tokenizers.path(x)
    return ByteEncoder(place(name), place(ranks_name))
