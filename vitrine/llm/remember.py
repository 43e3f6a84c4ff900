"""What a Python worker remembers from batch to batch: the token ids of words, for one operator at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Names how an operator's memory is emptied."""
    _forget[operator] = forget


def work_for(operator: str) -> None:
    """Called when a task begins: a worker that goes on to another operator forgets what it remembered for those before."""
    for name, forget in _forget.items():
        if name != operator:
            forget()


class WordIds:
    """Token ids of words as int32 bytes, in two generations: words met again move to the younger one, which replaces the older when it is
    full. That bounds memory and changes no result."""

    def __init__(self, remembered: int) -> None:
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Adds the ids of new words to self.known."""
        raise NotImplementedError

    def coded(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        if None in out:
            if len(self.known) > self.remembered:
                self.older, self.known = self.known, {}
            known, older = self.known, self.older
            new = {w for w, c in zip(words, out, strict=True) if c is None}
            if older:
                met = [w for w in new if w in older]
                known.update(zip(met, map(older.__getitem__, met), strict=True))
                new.difference_update(met)
            self.learn(new)
            out = [known[w] if c is None else c for w, c in zip(words, out, strict=True)]
        return out

    def of(self, words: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each word's end. Only the distinct words are looked up one by one."""
        distinct, at = distinct_words(words)
        coded = self.coded(distinct)
        arena, size = np.frombuffer(b"".join(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        length = size[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return arena[np.repeat((np.cumsum(size) - size)[at] - (ends - length), length) + np.arange(total)], ends


def distinct_words(words: pa.Array | list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words, and the place of each word among them."""
    try:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
    except UnicodeEncodeError:  # a lone surrogate
        places: dict[str, int] = {}
        at = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
        return list(places), at
    words = words.dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
