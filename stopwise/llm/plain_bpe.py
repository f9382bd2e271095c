"""Ids of byte-level BPE files, whole texts at a time.

The tokens of the file go to a compiled encoder that ranks merges by token number.
That gives the file's own ids if its merges make tokens of rising numbers, which is
checked. White space of very great length is beyond that encoder's splitting; such
texts go to the file's own library.
"""

from __future__ import annotations

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from stopwise.llm.byte_bpe import WORD_PATTERN, Vocabulary


class ByteLevelIds:
    """Ids of texts by a byte-level BPE tokenizer file.

    With ``added`` the strings of added tokens in a text become their ids, else
    they are text like any other.
    """

    def __init__(self, content: bytes, added: bool = True):
        vocabulary = Vocabulary(content)
        made = [whole for _, whole in sorted(vocabulary.merge.values())]
        if any(a > b for a, b in zip(made, made[1:])):
            raise ValueError("the tokens are not numbered in the order of their merges")
        self.added = vocabulary.added if added else {}
        special = set(vocabulary.added.values())
        ranks = {token: i for i, token in vocabulary.token.items() if i not in special}
        self.fast = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.allowed = set(self.added)
        self.library = Tokenizer.from_buffer(content)
        self.library.encode_special_tokens = not added
        self.library.no_truncation()
        self.library.no_padding()
        self.token = vocabulary.token

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, unsigned 32-bit."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # its pattern's stack does not hold the white space
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
