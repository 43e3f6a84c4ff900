"""A public SentencePiece vocabulary as a trie, and as a lattice: words as symbols, and the pieces that cover them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np

SPACE = "▁"
#: About what a symbol of a likely word costs, in logarithms.
SYMBOL = 2.5
_NEVER = -(1 << 60)


#: Characters that this many nodes of the trie have below them get a column of its table; the others are found by search.
COMMON = 40


class Trie:
    """All pieces that start at each place of many words, found for all places at once."""

    def __init__(self, ids: dict[str, int]) -> None:
        below: dict[tuple[int, str], int] = {}
        pieces, uses = [-1], Counter()
        for piece, i in ids.items():
            node = 0
            for c in piece:
                if (node, c) not in below:
                    below[node, c] = len(pieces)
                    pieces.append(-1)
                    uses[c] += 1
                node = below[node, c]
            pieces[node] = i
        self.piece = np.array(pieces, np.int32)
        self.column = np.zeros(1 << 16, np.uint8)
        common = [c for c, n in uses.most_common(255) if n >= COMMON and ord(c) < 1 << 16]
        self.column[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        self.table = np.zeros((len(pieces), len(common) + 1), np.int32)
        rare = []
        for (node, c), child in below.items():
            if ord(c) < 1 << 16 and (k := self.column[ord(c)]):
                self.table[node, k] = child
            else:
                rare.append((node << 21 | ord(c), child))
        rare.sort()
        self.rare, self.rare_child = np.array([x for x, _ in rare], np.int64), np.array([x for _, x in rare], np.int32)

    def _below(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        columns = self.column[np.minimum(codes, 0xFFFF)]
        out = self.table[nodes, columns]
        odd = np.flatnonzero(columns == 0)
        if len(odd) and len(self.rare):
            keys = nodes[odd].astype(np.int64) << 21 | codes[odd]
            at = np.minimum(np.searchsorted(self.rare, keys), len(self.rare) - 1)
            out[odd] = np.where(self.rare[at] == keys, self.rare_child[at], 0)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece that fits somewhere in the words, in no order."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        left = ends[word] - np.arange(len(codes))
        at, nodes, out, reach = np.arange(len(codes)), np.zeros(len(codes), np.int32), [], 0
        while len(at):
            nodes = self._below(nodes, codes[at + reach])
            reach += 1
            pieces = self.piece[nodes]
            hit = np.flatnonzero(pieces >= 0)
            out.append((at[hit], np.full(len(hit), reach), pieces[hit]))
            more = np.flatnonzero((nodes > 0) & (left[at] > reach))
            at, nodes = at[more], nodes[more]
        if not out:
            return (np.zeros(0, np.int64),) * 4
        start, length, piece = (np.concatenate([x[k] for x in out]) for k in range(3))
        word = word[start]
        start = start - (ends - lengths)[word]
        return word, start, start + length, piece.astype(np.int64)

    def best(self, words: list[str], scores: np.ndarray, cells: int = 40_000) -> list[bytes]:
        """The int32 pieces of greatest total score of each word, all of whose characters are pieces; words are of one length. Of equals,
        the longest last piece is taken, at every end."""
        out: list[bytes] = []
        most = cells // (len(words[0]) + 1) + 1
        for first in range(0, len(words), most):
            out += self._best(words[first : first + most], scores)
        return out

    def _best(self, words: list[str], scores: np.ndarray) -> list[bytes]:
        n, length = len(words), len(words[0])
        word, start, end, piece = self.edges(words)
        reach = int((end - start).max(initial=1))
        #: [word, end, reach - length of the last piece]: of equals argmax takes the first.
        value = np.full((n, length + 1, reach), _NEVER, np.int64)
        pieces = np.zeros((n, length + 1, reach), np.int32)
        place = reach - (end - start)
        value[word, end, place] = scores[piece]
        pieces[word, end, place] = piece
        best = np.full((n, reach + length + 1), _NEVER, np.int64)  # best[:, reach + t] is that of t characters
        best[:, reach] = 0
        rows, back = np.arange(n), np.zeros((n, length + 1), np.int64)
        for t in range(1, length + 1):
            total = best[:, t : t + reach] + value[:, t]
            back[:, t] = total.argmax(axis=1)
            best[:, reach + t] = total[rows, back[:, t]]
        found, counts, left = np.zeros((n, length), np.int32), np.zeros(n, np.int64), np.full(n, length)
        for k in range(length):
            open_ = np.flatnonzero(left)
            if not len(open_):
                break
            at = left[open_]
            last = back[open_, at]
            found[open_, length - 1 - k] = pieces[open_, at, last]
            counts[open_] += 1
            left[open_] = at - (reach - last)
        data, width = found.tobytes(), 4 * length
        return [data[width * (i + 1) - 4 * c : width * (i + 1)] for i, c in enumerate(counts.tolist())]


class Vocabulary:
    """Pieces that lie inside one word, by text; characters without a piece of their own become byte pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model: Any = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.longest = max(map(len, self.ids))
        self.characters = {p for p in self.ids if len(p) == 1}
        self.trie = Trie(self.ids)

    def symbols(self, text: str) -> list[str | int]:
        """Characters; those without a piece of their own as the ids of byte pieces."""
        return [s for c in text for s in ([c] if c in self.ids else [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")])]

    def edges(self, word: str) -> tuple[list[int], list[int], list[int], int]:
        """Start, end and piece of every piece that fits somewhere in a word of any characters; and the number of its symbols."""
        starts, ends, found = [], [], []
        symbols = self.symbols(word)
        for i, s in enumerate(symbols):
            if isinstance(s, int):
                starts.append(i), ends.append(i + 1), found.append(s)
                continue
            piece = ""
            for j in range(i, min(len(symbols), i + self.longest)):
                if isinstance(symbols[j], int):
                    break
                piece += symbols[j]
                if (p := self.ids.get(piece)) is not None:
                    starts.append(i), ends.append(j + 1), found.append(p)
        return starts, ends, found, len(symbols)

    def covers(self, word: str) -> bool:
        """Whether each character is a piece."""
        return self.characters.issuperset(word)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of many words at once, cut by the position where pieces end."""

    def __init__(self, vocab: Vocabulary, words: list[str]) -> None:
        plain = [k for k, w in enumerate(words) if vocab.covers(w)]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        word, start, end, piece = vocab.trie.edges(words if len(plain) == len(words) else [words[k] for k in plain])
        if len(plain) < len(words):
            parts = [(np.array(plain, np.int64)[word], start, end, piece)]
            for k in set(range(len(words))).difference(plain):
                *odd, self.lengths[k] = vocab.edges(words[k])
                parts.append((np.full(len(odd[0]), k), *(np.array(x, np.int64) for x in odd)))
            word, start, end, piece = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(word, kind="stable")
        self.word, self.starts, self.ends, self.pieces = word[order], start[order], end[order], piece[order]

    def _steps(self, at: np.ndarray, order: range | reversed) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each position, its edges in order of word, and where each word's edges begin."""
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(int(self.lengths.max(initial=0)) + 2))
        out = []
        for t in order:
            e = by[cuts[t] : cuts[t + 1]]
            if len(e):
                out.append((t, e, np.flatnonzero(np.r_[True, self.word[e][1:] != self.word[e][:-1]])))
        return out

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of each prefix: [word, position, column]; weights: log probability [edge, column]."""
        longest = int(self.lengths.max(initial=0))
        alpha = np.full((len(self.lengths), longest + 1, weights.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for t, e, heads in self._steps(self.ends, range(1, longest + 1)):
            alpha[self.word[e[heads]], t] = np.logaddexp.reduceat(alpha[self.word[e], self.starts[e]] + weights[e], heads, axis=0)
        return alpha

    def backward(self, weights: np.ndarray) -> np.ndarray:
        longest = int(self.lengths.max(initial=0))
        beta = np.full((len(self.lengths), longest + 1, weights.shape[1]), -np.inf)
        beta[np.arange(len(self.lengths)), self.lengths] = 0
        for t, e, heads in self._steps(self.starts, reversed(range(longest))):
            beta[self.word[e[heads]], t] = np.logaddexp.reduceat(beta[self.word[e], self.ends[e]] + weights[e], heads, axis=0)
        return beta

    def total(self, weights: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of each word: [word, column].

        Probabilities are summed as they are, scaled up for each symbol; words whose sum leaves the range of numbers are summed as logarithms.
        """
        longest = int(self.lengths.max(initial=0))
        scaled = np.exp(weights + SYMBOL * (self.ends - self.starts)[:, None])
        alpha = np.zeros((len(self.lengths), longest + 1, weights.shape[1]))
        alpha[:, 0] = 1
        for t, e, heads in self._steps(self.ends, range(1, longest + 1)):
            with np.errstate(over="ignore", invalid="ignore"):
                alpha[self.word[e[heads]], t] = np.add.reduceat(alpha[self.word[e], self.starts[e]] * scaled[e], heads, axis=0)
        words = np.arange(len(self.lengths))
        sums = alpha[words, self.lengths]
        with np.errstate(divide="ignore"):
            out = np.log(sums) - SYMBOL * self.lengths[:, None]
        if not (np.isfinite(sums).all() and (sums > 1e-290).all()):
            bad = ~(np.isfinite(sums) & (sums > 1e-290)).all(axis=1)
            out[bad] = self.forward(weights)[words, self.lengths][bad]
        return out


def by_cells(lengths: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Places of words in batches of like length, whose table of words by positions has about `cells` cells; a longer word is one alone."""
    order, first = np.argsort(lengths, kind="stable"), 0
    for last, n in enumerate(lengths[order].tolist()):
        if last > first and (last + 1 - first) * (n + 1) > cells:
            yield order[first:last]
            first = last
    if len(order):
        yield order[first:]


def total_of_long(vocab: Vocabulary, word: str, log_p: np.ndarray, block: int = 4096) -> np.ndarray:
    """What Lattice.total gives for one word, a block of characters at a time: all that goes on from a block are the sums of the places
    that its last pieces reach."""
    carried = np.full((vocab.longest, log_p.shape[1]), -np.inf)
    carried[0] = 0
    for first in range(0, len(word), block):
        text = word[first : first + block + vocab.longest - 1]
        own = min(block, len(word) - first)
        _, start, end, piece = vocab.trie.edges([text])
        odd = [i for i, c in enumerate(text[:own]) if c not in vocab.characters]
        bytes_of = [sum(log_p[vocab.bytes[b]] for b in text[i].encode("utf-8", "surrogatepass")) for i in odd]
        weight = np.concatenate([log_p[piece], np.array(bytes_of).reshape(len(odd), -1)]) if odd else log_p[piece]
        start, end = np.concatenate([start, np.array(odd, np.int64)]), np.concatenate([end, np.array(odd, np.int64) + 1])
        kept = np.flatnonzero(start < own)
        order = kept[np.argsort(end[kept], kind="stable")]
        cuts = np.searchsorted(end[order], np.arange(own + vocab.longest + 1))
        alpha = np.full((own + vocab.longest, log_p.shape[1]), -np.inf)
        alpha[: vocab.longest] = carried
        for t in range(1, len(alpha)):
            e = order[cuts[t] : cuts[t + 1]]
            if len(e):
                alpha[t] = np.logaddexp(alpha[t], np.logaddexp.reduce(alpha[start[e]] + weight[e], axis=0))
        carried = alpha[own:]
    return carried[0]
