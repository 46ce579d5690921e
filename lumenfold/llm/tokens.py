"""Token ids of whole texts, from public vocabularies, with a bounded cache per worker."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import regex

#: Entries of a cache; it is emptied when it is full, so memory stays bounded.
CHUNKS, CORES = 400_000, 1_200_000
# How the vocabulary splits a text in normal form into parts that share no
# token, once for texts of ASCII and Latin-1 letters, once for all others.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"
_LATIN = re.compile(_PARTS)
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_IS_LATIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")


def public_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of a ``tokenizers`` vocabulary that drops white space and lower-cases.

    The vocabulary's own rule splits a text into parts; a text's ids are those of its
    parts in order. Parts repeat, so the ids of each are kept as little-endian 32-bit
    bytes. Texts with control characters are left to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" in text or _CONTROL.search(text):  # a special token, or white space of its own kind
            return self._encode([text])[0]
        if _IS_LATIN.fullmatch(text):
            parts = _LATIN.findall(text.lower())
        else:
            parts = _ANY.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > CORES:
            known.clear()
        missing = [p for p in dict.fromkeys(parts) if p not in known]
        for lo in range(0, len(missing), 10_000):
            some = missing[lo : lo + 10_000]
            known.update(zip(some, self._encode(some), strict=True))
        return b"".join([known[p] for p in parts])


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this worker, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
