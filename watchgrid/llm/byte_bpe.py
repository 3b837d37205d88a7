"""Ids of a byte-level vocabulary, by the library that encodes its ranks."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: The ranks' library takes its pattern by backtracking and fails on about a million white-space characters in a row; texts with
#: so many go to the other library, which reads the same vocabulary.
_RUN = 50_000
_LONG_RUN = re.compile(r"\s{%d}" % _RUN)
_LOADED: dict = {}


class ByteIds:
    """Encoder of texts; ``special`` says whether strings of special ids inside texts are these ids or plain text.

    ``path`` and ``form`` are the places of the vocabulary as ranks and in JSON.
    """

    def __init__(self, special: bool, path: str, form: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.special, self.form = special, form
        #: The bytes of each id.
        self.token = [b""] * len(ranks)
        for b, i in ranks.items():
            self.token[i] = b
        self._other = None

    def other(self):
        """The vocabulary by the library that reads its JSON form."""
        if self._other is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._other = Tokenizer.from_file(self.form)
            self._other.encode_special_tokens = not self.special
        return self._other

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= _RUN and _LONG_RUN.search(text):
            return np.array(self.other().encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if self.special:
            return self.ranks.encode_to_numpy(text, allowed_special="all")
        return self.ranks.encode_to_numpy(text, disallowed_special=())


def loaded(special: bool, path: str | None = None, form: str | None = None, pattern: str | None = None) -> ByteIds:
    """The vocabulary, by default the public one, kept by a worker from task to task."""
    import public_tokenizers

    files = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), form or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    if (special, *files) not in _LOADED:
        _LOADED[special, *files] = ByteIds(special, *files)
    return _LOADED[special, *files]
