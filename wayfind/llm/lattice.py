"""Subword lattices of many words at once, in numpy: all segmentations into pieces, in log space."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

MARK = "▁".encode()
END = b"</s>"
PAD = 256
#: Bytes in one block of words, all padded to the longest of it.
BLOCK = 60_000


def load_vocabulary(path: str) -> list[bytes]:
    """A sentencepiece file's pieces as bytes, by rank: the end piece first, byte pieces as their byte. Pieces of several words are left out."""
    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}: name a sentencepiece file (setting spark.wayfind.vocabulary, or the argument vocabulary)")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [END]
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(piece[3:-1], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i)) and MARK not in piece.encode()[1:]:
            pieces.append(piece.encode())
    return list(dict.fromkeys([*pieces, MARK]))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Over the first axis; -inf where all are."""
    m = x.max(axis=0)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


class Lattice:
    """pieces with natural log scores. A trie leads from a position to the pieces that begin there."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores = scores
        spelled = {p: i for i, p in enumerate(pieces) if p != END}
        inner = {b""} | {p[:n] for p in spelled for n in range(1, len(p))}
        node = {p: i + 1 for i, p in enumerate(sorted(inner))}
        self.inner = len(inner)
        node |= {p: self.inner + 1 + i for i, p in enumerate(sorted(spelled.keys() - inner))}
        self.root, self.longest = node[b""], max(map(len, spelled))
        self.next = np.zeros((self.inner + 1, PAD + 1), np.int32)
        self.piece = np.full(len(node) + 1, -1, np.int32)
        for p, i in node.items():
            if p:
                self.next[node[p[:-1]], p[-1]] = i
            self.piece[i] = spelled.get(p, -1)

    def blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indexes, lengths, bytes by position and word) of words of like length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(MARK)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and sizes[order[end]] * (end + 1 - at) <= BLOCK:
                end = min(len(order), end + max(1, (end - at) // 4))
            of = order[at:end]
            n = sizes[of]
            flat = np.frombuffer(b"".join(MARK + words[i] for i in of), np.uint8)
            block = np.full((len(of), n.max()), PAD, np.int64)
            block[np.arange(n.max()) < n[:, None]] = flat
            yield of, n, np.ascontiguousarray(block.T)
            at = end

    def edges(self, block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on, the flat start positions and pieces."""
        width = block.shape[1]
        flat = np.concatenate([block.ravel(), np.full(self.longest * width, PAD)])
        at = np.flatnonzero(flat != PAD)
        state = np.full(len(at), self.root, np.int32)
        out = []
        for step in range(self.longest):
            state = self.next[state, flat[at + step * width]]
            on = state > 0
            at, state = at[on], state[on]
            piece = self.piece[state]
            hit = piece >= 0
            out.append((at[hit], piece[hit]))
            on = state <= self.inner
            at, state = at[on], state[on]
            if not len(at):
                break
        return out

    def _forward(self, block: np.ndarray, edges: list) -> tuple[np.ndarray, np.ndarray]:
        n, width = block.shape
        scored = np.full((len(edges), n * width), -np.inf)
        for row, (at, piece) in zip(scored, edges, strict=True):
            row[at] = self.scores[piece]
        scored = scored.reshape(len(edges), n, width)
        alpha = np.full((n + 1, width), -np.inf)
        alpha[0] = 0
        for t in range(1, n + 1):
            back = np.arange(min(t, len(edges)))
            alpha[t] = _log_sum(alpha[t - 1 - back] + scored[back, t - 1 - back])
        return alpha, scored

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for of, n, block in self.blocks(words):
            alpha, _ = self._forward(block, self.edges(block))
            out[of] = alpha[n, np.arange(len(of))]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by forward and backward recursion."""
        counts = np.zeros(len(self.scores))
        for of, n, block in self.blocks(words):
            edges = self.edges(block)
            alpha, scored = self._forward(block, edges)
            longest, width = block.shape
            beta = np.full((longest + 1, width), -np.inf)
            beta[n, np.arange(width)] = 0
            for t in range(longest - 1, -1, -1):
                on = np.arange(min(longest - t, len(edges)))
                beta[t] = np.maximum(beta[t], _log_sum(scored[on, t] + beta[t + 1 + on]))
            whole = alpha[n, np.arange(width)]
            for step, (at, piece) in enumerate(edges):
                word = at % width
                share = np.exp(alpha.ravel()[at] + self.scores[piece] + beta.ravel()[at + (step + 1) * width] - whole[word])
                counts += np.bincount(piece, share * times[of[word]], len(counts))
        return counts
