"""Token ids of a byte-level BPE.

Plain Latin text goes to tiktoken with the same ranks. Any other text may be
split differently there, as the two libraries may hold different Unicode
tables. The pre-tokeniser never joins what lies on both sides of a single space
between two other visible characters, so such a text is cut there, and only the
pieces with other characters go to tokenizers; a bounded cache remembers them. The
control string of the vocabulary gets its own id, as tokenizers does by default;
``specials=False`` treats it as ordinary text.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np

#: Only spaces between two visible characters end a piece.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_PLAIN = re.compile("[\0-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")
_CACHED = 100_000


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None, specials: bool = True) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path or _path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path or _path("byte_bpe_50k.json"))
        self.full.encode_special_tokens = True
        self.control = {t.content: np.array([i], "<u4").tobytes() for i, t in self.full.get_added_tokens_decoder().items()} if specials else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.control, key=len, reverse=True))) + ")") if self.control else None
        self.cache: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece):
            return self.fast.encode_to_numpy(piece).astype("<u4").tobytes()
        ids = self.full.encode(piece, add_special_tokens=False).ids
        if len(self.cache) >= _CACHED:
            self.cache.clear()
        found = self.cache[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text):
            return self._piece(text)
        known = self.cache.get
        return b"".join([known(p) or self._piece(p) for p in self._pieces(text)])

    @staticmethod
    def _pieces(text: str) -> Iterator[str]:
        """The cut text, with neighbouring plain pieces put together again."""
        for plain, own in groupby(_CUT.split(text), lambda p: bool(_PLAIN.fullmatch(p))):
            yield from ["".join(own)] if plain else own

    def encode(self, text: str | None) -> np.ndarray:
        """Null is empty."""
        if not isinstance(text, str):
            text = ""
        if self.split is None or not any(c in text for c in self.control):
            return np.frombuffer(self._ordinary(text), "<u4")
        return np.frombuffer(b"".join([self.control.get(p) or self._ordinary(p) for p in self.split.split(text)]), "<u4")


_ready: dict[tuple, Encoder] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None, specials: bool = True) -> Encoder:
    """One encoder for each worker process."""
    key = (json_path, ranks_path, specials)
    if key not in _ready:
        _ready[key] = Encoder(*key)
    return _ready[key]
