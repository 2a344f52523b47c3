"""Ids of a byte-level BPE tokenizer file, as the ``tokenizers`` library gives them.

The same vocabulary is also loaded into ``tiktoken``, which is three times as fast and gives the same ids where both
libraries read the pre-tokenizing pattern alike. Texts with other characters than those of PLAIN, where Unicode
versions or white space could be read differently, texts with a run of white space of RUN characters, on which the
pattern's look-ahead would backtrack beyond its stack, and files whose merges aren't in the order of their ids, go to
``tokenizers``, which reads any text. Strings of added tokens in a text are ordinary text, or with ``added`` the tokens, as by the library's
default; texts that hold one go to ``tokenizers`` then.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: Latin letters, digits, usual punctuation, plain white space.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")
#: tiktoken's pattern fails on some 900,000 characters of white space in a row.
RUN = 10_000
BLANK = re.compile("[\t\n\r ]{%d}" % RUN)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write printable bytes as themselves and the others as U+0100 onwards, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _same_as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if the file is plain byte-level BPE whose merges are in the order of their ids."""
    model, to_byte = spec["model"], _byte_of_char()
    pre = spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    special = {x["content"] for x in spec.get("added_tokens", [])}
    vocab = model["vocab"]
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if order != sorted(order) or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    return {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}


class Encoder:
    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _same_as_ranks(spec)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        contents = [re.escape(x["content"]) for x in spec.get("added_tokens", []) if added]
        self.added = re.compile("|".join(contents)) if contents else None
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def quick(self, text: str) -> bool:
        """Whether tiktoken gives the library's ids for the text."""
        return bool(self.fast and PLAIN.fullmatch(text)) and not (self.added and self.added.search(text)) and not (len(text) >= RUN and BLANK.search(text))

    def ids(self, text: str) -> np.ndarray:
        if self.quick(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def count(self, text: str) -> int:
        return len(self.ids(text))


@cache
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)
