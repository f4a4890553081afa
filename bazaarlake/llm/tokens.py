"""Exact token ids of the lower-casing word BPE (word_bpe_49k.json), faster than encoding every text whole.

The tokenizer splits a text into pre-tokens (words, digits, runs of symbols) and merges inside each one alone. So ids
can be put together from those of pre-tokens: a table holds the vocabulary strings that are proven, when the table is
made, to encode alone as one token; only other pre-tokens go through the merges. No pre-token holds white space, so what
stands between white space is looked up at once, and only what is new there is cut into pre-tokens.

The shortcut holds for texts of characters on which this module and the library provably agree (SAFE, tested character
by character); any other text, and any that holds a special token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters whose NFC form is themselves, with the same lower case and class here and in the library.
SAFE = re.compile(r"[\t-\r\x20-\x7e¡«°»¿À-ÖØ-öø-ÿ–—‘’“”…€]*")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: The tokenizer's own pre-token pattern, for SAFE characters in lower case.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Strings between white space that a worker remembers before it starts afresh; longer ones are not remembered.
MEMO, LONGEST = 250_000, 64

#: Other SAFE characters than ASCII, spelt as the vocabulary spells their bytes.
SPELT = {k: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))[0][0] for k in range(128, 0x2100) if SAFE.fullmatch(chr(k))}

_coders: dict[str, WordBpe] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(path: str) -> WordBpe:
    """The worker's coder for a file; made once."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


class Memo(dict):
    """The ids of strings without white space; new ones are worked out when they are looked up."""

    def __init__(self, bpe: WordBpe):
        super().__init__(bpe.single)
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        found = self.bpe.chunk_ids(chunk)
        if len(chunk) <= LONGEST:
            if len(self) > MEMO + len(self.bpe.single):
                self.clear()
                self.update(self.bpe.single)
            self[chunk] = found
        return found


class WordBpe:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.single = self.prove_single()
        self.memo = Memo(self)

    def prove_single(self) -> dict[str, bytes]:
        """Vocabulary strings that are one pre-token and encode alone as one token, with its id in 4 bytes."""
        ends = [s[: -len("</w>")] for s in self.whole.get_vocab() if s.endswith("</w>")]
        ends = [s for s in ends if s.isascii() and PRETOKEN.fullmatch(s) and s == s.lower()]
        found = {}
        for at in range(0, len(ends), 8192):
            part = ends[at : at + 8192]
            for s, e in zip(part, self.whole.encode_batch(part, add_special_tokens=False), strict=True):
                if len(e.ids) == 1:
                    found[s] = np.array(e.ids, "<u4").tobytes()
        return found

    def chunks(self, text: str) -> list[str] | None:
        """What stands between white space, in lower case; None if only the library can tell."""
        if SAFE.fullmatch(text) and not ("<|" in text and SPECIAL.search(text)):
            return text.lower().split()
        return None

    def merged(self, pretoken: str) -> bytes:
        """The ids that the library's merges give a pre-token."""
        spelt = pretoken if pretoken.isascii() else pretoken.translate(SPELT)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(spelt)])

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a string without white space."""
        single = self.single
        if chunk.isalpha():  # one pre-token
            return single[chunk] if chunk in single else self.merged(chunk)
        return b"".join([single[p] if p in single else self.merged(p) for p in PRETOKEN.findall(chunk)])

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        parts = self.chunks(text)
        if parts is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, parts))

    def count(self, text: str | None) -> int:
        """The number of the text's ids."""
        return len(self.ids(text)) // 4
