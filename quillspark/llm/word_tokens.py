"""Token ids of whole texts, word by word through caches; the same ids as one call gives.

The tokenizer drops white space and no token crosses it, so a text's ids are its words' ids one
after the other.  A new word of plain Latin letters, digits and signs is cut at the tokenizer's
own boundaries (runs of letters, single digits, runs of signs, contractions) after lowering it;
such a part ends with a token that marks a word's end, which tells parts that are encoded together
apart.  Other new words are encoded whole and told apart by offsets.
"""

from __future__ import annotations

import re

import numpy as np

CACHE_WORDS = 300_000
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPECIAL = "<|"
_MOST = 4096


class WordTokenizer:
    """Encodes UTF-8 texts to unsigned little-endian 32-bit ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.cache, self.older, self.parts, self.older_parts = cache_words, {}, {}, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), np.bool_)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> None:
        plain, split, other, new = [], [], [], {}
        parts, older = self.parts, self.older_parts
        for w in words:
            text = w.decode()
            if _PLAIN.fullmatch(text) and _SPECIAL not in text:
                own = _PART.findall(text.lower())
                plain.append(w)
                split.append(own)
                for p in own:
                    if p not in parts:
                        if p in older:
                            parts[p] = older[p]
                        else:
                            new[p] = None
            else:
                other.append(w)
        for k in range(0, len(other), _MOST):
            self._whole(other[k : k + _MOST])
        new = list(new)
        for k in range(0, len(new), _MOST):
            self._parts(new[k : k + _MOST])
        for w, own in zip(plain, split):
            self.cache[w] = b"".join([parts[p] for p in own]) if len(own) > 1 else parts[own[0]]

    def _parts(self, new: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(new):
            raise ValueError("a part does not end where its last token does")
        raw, at = ids.tobytes(), 0
        for p, end in zip(new, cuts):
            self.parts[p] = raw[at:end]
            at = end

    def _whole(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        cuts = np.searchsorted(at, starts).tolist() + [len(ids)]
        for w, a, b in zip(words, cuts, cuts[1:]):
            self.cache[w] = ids[a:b].tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new: dict[bytes, None] = {}
        cache, older = self.cache, self.older
        for words in split:
            for w in words:
                if w not in cache:
                    if w in older:
                        cache[w] = older[w]
                    else:
                        new[w] = None
        if new:
            self._learn(list(new))
        get = cache.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        if len(self.parts) > self.most:
            self.older_parts, self.parts = self.parts, {}
        return out


_kept: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; its caches live as long as the worker."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = WordTokenizer(path)
    return _kept[path]
