"""Token ids of whole texts by a BPE-with-word-ends tokenizer file, with a cache of words.

The pre-tokenizer of such files never joins characters across white space, so a
text's ids are the ids of its white-space separated chunks in order. Chunks
repeat; each is encoded by the tokenizers library once and then looked up. Tests hold this
against the library's encoding of whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from stockloom.llm.common import KEPT

#: Chunks, and words in them, that a worker remembers: two generations of so many, and of so many bytes.
REMEMBERED, WORDS, REMEMBERED_BYTES = 500_000, 300_000, 16 << 20
#: Long texts are taken in parts of about so many bytes, cut at white space.
PART = 1 << 20
#: Chunks of printable ASCII and the letters of Latin-1, which no normal form changes.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokenizer's pattern on lower-cased plain chunks.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


class Remembered(dict):
    """A dictionary that makes missing values and keeps two generations of a bounded size."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old, self.bytes = make, size, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size or self.bytes > REMEMBERED_BYTES:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += len(key) + len(value)
        self[key] = value
        return value


def visible_bytes() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the next free code points."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of bounded size, cut before white space."""
    at = 0
    while len(text) - at > PART:
        cut = SPACE.search(text, at + PART)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class WordIds:
    """Encodes texts given as UTF-8 bytes; ids come as an array of `dtype`."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        # only files of this shape allow chunks and the plain way; others are encoded whole
        self.chunked = kinds == ["Split", "ByteLevel"] and spec["model"]["end_of_word_suffix"] == "</w>" and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") and " " not in t["content"] for t in spec["added_tokens"])
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.visible = visible_bytes()
        # the model is fetched once, as each fetch makes a new object, and each id is packed once
        self.pieces = self.library.model.tokenize
        self.packed_id = [self._packed([i]) for i in range(self.library.get_vocab_size())]
        self.words = Remembered(self._word, WORDS)
        self.chunks = Remembered(self._chunk, REMEMBERED)

    def forget(self) -> None:
        """Drop the older generation, so that a worker between two tasks holds little."""
        self.words.old, self.chunks.old = {}, {}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.visible)
        found = self.pieces(word)
        if len(found) == 1:
            return self.packed_id[found[0].id]
        return b"".join([self.packed_id[t.id] for t in found])

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters alone
            return self.words[chunk.lower().decode("ascii")]
        if chunk[:-1].isalpha() and 32 < chunk[-1] < 127:  # ... and one mark or digit
            text = chunk.lower().decode("ascii")
            return self.words[text[:-1]] + self.words[text[-1]]
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and b"<|" not in chunk:
            text = text.lower()
            if LETTERS.fullmatch(text):
                return self.words[text]
            return b"".join(map(self.words.__getitem__, PIECES.findall(text)))
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> np.ndarray:
        if not self.chunked:
            return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(b"".join(map(self.chunks.__getitem__, part.split())) for part in parts(text)), self.dtype)


#: One encoder for each file and worker process.
_OPEN: dict[str, WordIds] = {}
KEPT.append(_OPEN.clear)


def encoder(path: str) -> WordIds:
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
