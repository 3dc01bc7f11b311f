"""Encoding whole texts with a public tokenizer, inside Arrow batches."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import kept, pieces

#: Words kept with their ids in each worker. More words are encoded when they turn up again.
MOST_WORDS = 500_000
#: Words that go to the tokenizer in one string.
TOGETHER = 64
#: Runs that the vocabulary's pattern takes as one piece whatever stands around them, and a word made of two such.
_LETTERS, _SIGNS = "[a-zß-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
_SIGN_BYTES = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ONE = re.compile(f"{_LETTERS}|{_SIGNS}")
_TWO = re.compile(f"({_LETTERS})({_SIGNS})")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary folds case, drops white space and never joins across it, so a text's ids are those of
    its space-separated words, one after another. Words are looked up; those not seen before go through
    the tokenizers library, many at a time. Texts that hold the start of a special token's string keep
    their case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one piece each: encoded in strings of many, and cut after each token that ends a word."""
        got = self.tokenizer.encode_batch_fast([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in got])
        cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cut) != len(words) or cut[-1] != 4 * len(ids):
            return self._whole(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())]

    def encode(self, texts: list) -> list[bytes]:
        """texts: strings, or their UTF-8 bytes."""
        texts = (t.encode() if isinstance(t, str) else t for t in texts)
        runs = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known = self.known
        fresh = list(set().union(*runs) - known.keys())
        if fresh:
            two, one, other = [], set(), []
            for word in fresh:
                if word.isascii():
                    base = word.rstrip(_SIGN_BYTES)
                    if not base or (base.isalpha() and len(base) == len(word)):
                        one.add(word)
                    elif base.isalpha():
                        two.append((word, base, word[len(base) :]))
                    else:
                        other.append(word)
                elif m := _TWO.fullmatch(s := word.decode()):
                    two.append((word, m[1].encode(), m[2].encode()))
                elif _ONE.fullmatch(s):
                    one.add(word)
                else:
                    other.append(word)
            one.update(x for _, a, b in two for x in (a, b) if x not in known)
            if one:
                known.update(zip(one, self._joined([w.decode() for w in one])))
            if other:
                known.update(zip(other, self._whole([w.decode() for w in other])))
            known.update((w, known[a] + known[b]) for w, a, b in two)
        out = [b"".join(map(known.__getitem__, r)) for r in runs]
        for _ in range(len(known) - MOST_WORDS):  # the newest go, with the parts of words that came along
            known.popitem()
        return out


@kept
@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"):
    """For each run of rows: the identifiers, and each row's ids as bytes with end_id at the end. Null text has that id alone."""
    last = int(end_id).to_bytes(4, "little")
    coder = encoder(path)
    for batch in batches:
        for part in pieces(batch, text_col, 1 << 20):
            texts = [t or b"" for t in part.column(text_col).cast("binary").to_pylist()]
            yield part.column(id_col), [x + last for x in coder.encode(texts)]


