"""Token ids of whole texts by a public byte-level BPE vocabulary (the tokenizers library).

Byte-level BPE first cuts a text into words (letters, digits, other signs, white
space) and then merges bytes inside each word, so the ids of a word depend on
that word alone.  :class:`WordIds` keeps the ids of words already seen (bounded,
one store per Python worker) and asks the library only for new ones; texts in
which word borders are not plain single spaces go through the library whole.
The result equals ``Tokenizer.encode(text, add_special_tokens=False)``; the tests
compare both.
"""

from __future__ import annotations

import struct

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAX_WORDS = 600_000  # words in each of the two generations that a Python worker keeps

# white space before a space: the run is one word to the library, and not cut at its spaces
BEFORE_SPACE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]

_stores: dict[tuple[str, int], "WordIds"] = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """Maps a word that followed one space to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = MAX_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if (got := self.older.get(word)) is not None:
            self[word] = got
            return got
        core = word.rstrip(",.")
        if core.isalpha() and ((plain := core.isascii()) or max(core) < "ɐ"):
            if core == word:
                got = self._ids("Ġ" + word) if plain else self._merged(" " + word)
            else:
                got = self[core] + self._tail(word[len(core):])
        elif len(lines := word.split("\n")) == 2 and word.split() == lines:
            got = self[lines[0]] + self._tail("\n") + self._lead(lines[1])
        else:
            got = self.encode_whole(" " + word)
        self[word] = got
        return got

    def _merged(self, word: str) -> bytes:
        return self._ids(word.encode().decode("latin-1").translate(self.letters))

    def _ids(self, letters: str) -> bytes:
        ids = [t.id for t in self.merge(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _tail(self, signs: str) -> bytes:
        key = " " + signs  # words never hold spaces, so these keys are free
        if key not in self:
            self[key] = self._merged(signs)
        return self[key]

    def _lead(self, word: str) -> bytes:
        """A word that no space precedes."""
        core = word.rstrip(",.")
        if core and core.isalpha() and max(core) < "ɐ":
            return self._tail(core) + (self._tail(word[len(core):]) if core != word else b"")
        return self.encode_whole(word)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if any(s in text for s in BEFORE_SPACE) or any(s in text for s in self.special):
            return self.encode_whole(text)
        first, *rest = text.split(" ")
        return (self.encode_whole(first) if first else b"") + b"".join(map(self.__getitem__, rest))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids(path: str, most: int = MAX_WORDS) -> WordIds:
    """The worker's store for the vocabulary at ``path``, of at most ``most`` words in a generation."""
    if (path, most) not in _stores:
        _stores[path, most] = WordIds(path, most)
    return _stores[path, most]
