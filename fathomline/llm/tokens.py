"""Exact tokenization with a tokenizer file, fast on repetitive text.

A byte-level BPE splits at every single space or line feed that stands between two other characters: what
lies on either side is encoded independently. So a text whose only white space is of that kind is encoded
word by word, and each distinct word once per worker; any other text is encoded as a whole, and so are texts
that hold a string of an added token, and all texts where the file describes another kind of tokenizer. The ids
are those of the library on the whole text either way (tests compare them with a fresh object of the library);
strings of added tokens get the ids that the file gives them, as in the library's own defaults.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa

END_ID = 0
_MARKS = frozenset(".,;:!?")
#: Words that a worker remembers (about 200 MB); on overflow it forgets all and starts again.
CACHE_WORDS = 600_000

_loaded: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    """The path of the byte-level BPE of the installed tokenizer files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Units and their ids; a unit that is missing is encoded when it is looked up."""

    def __init__(self, lib):
        super().__init__()
        self.lib, self.model, self.letters = lib, lib.model, _byte_letters()

    def __missing__(self, w: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = w[1:] if w[:1] == " " else w
        if word.isalpha() and max(word) < "\u0250":  # one piece for the pre-tokenizer: straight to the model
            ids = [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
        elif word[-1:] in _MARKS and word[-2:-1].isalpha() and word[-2] < "\u0250":
            # One mark after a letter is a piece of its own: the word before it is looked up alone.
            out = self[w] = self[w[:-1]] + self[word[-1]]
            return out
        else:
            ids = self.lib.encode(w or "\n", add_special_tokens=False).ids
        out = self[w] = _bytes(ids)
        return out


def splits_at_plain_spaces(description: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE without normalisation, whose pieces never cross a single space or line feed."""
    pre, model = description.get("pre_tokenizer") or {}, description.get("model") or {}
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return bool(byte_level and plain) and description.get("normalizer") is None


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_plain_spaces(json.load(f))
        self.added = tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.known = _Known(self.lib)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def units(text: str) -> list[str] | None:
        """Pieces that can be encoded one by one (an empty one stands for a line feed), or None where white space is not of the plain kind."""
        if " ".join(text.split()) != text.replace("\n", " "):
            return None
        return text.replace("\n", "\n\n").replace(" ", "\n ").split("\n")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        u = self.units(text) if self.by_word and not any(x in text for x in self.added) else None
        return self.whole([text])[0] if u is None else b"".join(map(self.known.__getitem__, u))


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def forget() -> None:
    """Drops the words that this worker remembers, and gives memory that is free back to the system: workers outlive a stage, and the next operator needs it."""
    for e in _loaded.values():
        e.known.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def encoded(path: str, texts: Iterator[str | None]) -> Iterator[bytes]:
    """The ids of each text (null: none) followed by END_ID, in the order given."""
    encode, end = encoder(path).encode, _bytes([END_ID])
    for t in texts:
        yield encode(t or "") + end
