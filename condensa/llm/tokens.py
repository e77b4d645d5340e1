"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

A byte-level BPE vocabulary never merges over the border before a single space that a visible
character follows, so a text's ids are those of its space-led words in order. Words are encoded
in batches and remembered in a bounded table, which is emptied when full; results never depend
on it.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: A space before any of these (printable ASCII, Latin letters) starts a new word for the vocabulary.
_CUT = re.compile(r" (?=[!-~À-ɏ])")
_OTHER = re.compile(r" (?![!-~À-ɏ])")
#: How a byte-level vocabulary writes a leading space.
_LED = "\u0120"
_LOADED: dict[tuple[str, int], "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes groups of texts. A word is encoded when first seen, tried for a while, and kept once it comes up again."""

    def __init__(self, path: str, remembered: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        size = self.model.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.starts_word = np.zeros(size, dtype=bool)
        self.starts_word[[i for token, i in self.model.get_vocab().items() if token.startswith(_LED)]] = True
        self.remembered = remembered
        self.kept: dict[str, bytes] = {}
        self.tried: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without spaces, each behind one: many are encoded as one text and parted where a token begins with the space."""
        rows = [" " + " ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.model.encode_batch(rows, add_special_tokens=False)), dtype=self.dtype)
        starts = np.flatnonzero(self.starts_word[flat])
        if len(starts) != len(words):
            return dict(zip(words, self._ids([" " + w for w in words])))
        raw = flat.tobytes()
        at = [*(starts * flat.itemsize).tolist(), len(raw)]
        return {w: raw[i:j] for w, i, j in zip(words, at, at[1:])}

    def _table(self, words: set[str]) -> dict[str, bytes]:
        kept, tried = self.kept, self.tried
        if len(kept) > self.remembered:
            kept.clear()
        if len(tried) > self.remembered:
            tried.clear()
        asked = list(words)
        out = dict(zip(asked, map(kept.get, asked)))
        unknown = [w for w, ids in out.items() if ids is None]
        again = {w: tried.pop(w) for w in unknown if w in tried}
        missing = [w for w in unknown if w not in again] if again else unknown
        spaced = [w for w in missing if " " in w]
        new = self._learn([w for w in missing if " " not in w] if spaced else missing)
        new |= zip(spaced, self._ids([" " + w for w in spaced]))
        kept |= again
        tried |= new
        out |= again
        out |= new
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text (null: none) as little-endian integers of ``dtype``."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            group.append(text.split(" ") if _OTHER.search(text) is None else _CUT.split(text))
            size += len(text)
            if size > 4_000_000:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> list[bytes]:
        first = self._ids([words.pop(0) for words in group])
        get = self._table(set(chain.from_iterable(group))).__getitem__
        return [head + b"".join(map(get, words)) for head, words in zip(first, group)]


def encoder(path: str, remembered: int = 300_000) -> Encoder:
    """This worker's encoder for the vocabulary at ``path``."""
    if (path, remembered) not in _LOADED:
        _LOADED[path, remembered] = Encoder(path, remembered)
    return _LOADED[path, remembered]
