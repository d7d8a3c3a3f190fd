"""Token ids of texts, by a tokenizer file, with a cache of words.

The tokenizer in use splits at white space before anything else, so a text's
ids are those of its words one after the other. Words repeat, so each worker
keeps the ids of words it has met as bytes, and a text becomes one join. A new
word of Latin letters with marks behind them is two runs, each of which goes to
the tokenizer's merges; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from sievelake.llm.common import claim_cache, keeps_cache

#: Words whose ids a worker keeps; the cache is emptied when it is full.
CACHE_WORDS = 800_000
END_ID = 1

#: A line of letters that the tokenizer's normaliser leaves alone once in lower
#: case, then marks that it takes as one run; the third group must be empty.
PLAIN = re.compile(r"^([a-zà-öø-ÿ]*)([.,;:!?()\[\]\"*#%&$-]*)(.*)$", re.M)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as the character of that number, or,
    where that one isn't printable, as the next from 256 on."""
    odd = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
    return {b: 256 + i for i, b in enumerate(odd)}


_BYTES = _byte_letters()


def default_tokenizer() -> str:
    """Path of the word tokenizer's file where the public vocabularies are
    installed; pass another path to the operators elsewhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of words (keys and values are bytes) and of whole texts, as
    little-endian unsigned integers: 16 bits while the vocabulary allows, else
    32."""

    _made: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        # A plain dict: taking one of a subclass from a set walks over all of it.
        self.words: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.runs: dict[str, bytes] = {"": b""}
        self.end = np.array([END_ID], self.dtype).tobytes()

    @classmethod
    def forget(cls) -> None:
        for made in cls._made.values():
            made.words = {}
            made.runs = {"": b""}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        claim_cache("tokens")
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def run(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Keep the ids of new words. Their runs recur with other marks behind
        them and in other case, so runs are kept, too."""
        parts = PLAIN.findall(b"\n".join(words).decode("utf-8", "replace").lower())
        if len(parts) != len(words):
            parts = [("", "", "other")] * len(words)
        runs = self.runs
        for r in {r for p in parts if not p[2] for r in p[:2]}.difference(runs):
            runs[r] = self.run(r)
        self.words.update([(w, runs[a] + runs[b]) for w, (a, b, c) in zip(words, parts) if not c])
        rest = [w for w, p in zip(words, parts) if p[2]]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
            self.words[w] = array(self.code, e.ids).tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text (null: empty) without special tokens, then END_ID."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
            self.runs = {"": b""}
        # The tokenizer lowers letters itself; only its special tokens, which it
        # looks for before, must not come about by lowering.
        words = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        fresh = list(set().union(*words).difference(self.words))
        for i in range(0, len(fresh), 20_000):
            self.learn(fresh[i : i + 20_000])
        known = self.words
        return [b"".join(map(known.__getitem__, w)) + self.end for w in words]


keeps_cache("tokens", WordTokenizer.forget)
