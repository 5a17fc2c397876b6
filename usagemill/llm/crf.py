"""A linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from usagemill.llm.tables import by_length, offsets

# Features are numbered by a hash into so many rows.
FEATURES = 1 << 16
AFFIX = 4
GRAM = 3
LONGEST = 24  # letters of a word; a longer run of letters is a chain of pieces of at most that

_ODD = np.uint64(0x9E3779B97F4A7C15)


def letter_pieces(run: str) -> list[str]:
    """A run of letters, in pieces of at most LONGEST letters that overlap by GRAM."""
    stride = LONGEST - GRAM
    return [run[at : at + LONGEST] for at in range(0, max(1, len(run) - GRAM), stride)]


def _hashed(parts: list[np.ndarray], kind: int) -> np.ndarray:
    value = np.full(len(parts[0]), kind + 1, np.uint64)
    for part in parts:
        value = (value ^ part.astype(np.uint64)) * _ODD
        value ^= value >> np.uint64(29)
    return (value >> np.uint64(20)).astype(np.int64) % FEATURES


def word_features(codes: np.ndarray) -> np.ndarray:
    """Feature rows of words of one length (code points, a row each): affixes, letter n-grams, the word itself."""
    columns = [codes[:, i] for i in range(codes.shape[1])]
    edge = np.zeros(len(codes), np.uint32)
    found = [_hashed(columns, 0)]
    for size in range(1, min(AFFIX, len(columns)) + 1):
        found += [_hashed(columns[:size], 1), _hashed(columns[-size:], 2)]
    padded = [edge, *columns, edge]
    found += [_hashed(padded[i : i + GRAM], 3) for i in range(len(padded) - GRAM + 1)]
    return np.stack(found, axis=1)


@dataclass
class Chain:
    """Weights of features and of transitions, for the labels in order."""

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word (a row) for each label."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for rows, codes in by_length(words):
            for start in range(0, len(rows), 1 << 13):
                part = rows[start : start + (1 << 13)]
                for column in word_features(codes[start : start + (1 << 13)]).T:
                    out[part] += self.emit[column]
        return out


def marginals(emissions: np.ndarray, lengths: np.ndarray, move: np.ndarray, collect: bool = False) -> np.ndarray:
    """By forward and backward sums: the chances of every word for the labels, a word a row.

    ``emissions`` has the words of all texts, one text after the other; every text has a word. Texts go side by side,
    the longest first, a word of each at a time. With ``collect`` the expected transitions are returned after them.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    begins = offsets(lengths)[:-1][order]
    steps = int(sizes[0])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")
    at = offsets(active)
    place = np.concatenate([begins[:n] + t for t, n in enumerate(active.tolist())])
    scaled = emissions[place]
    scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    step = np.exp(move - move.max())
    forward = np.empty_like(scaled)
    state = scaled[: active[0]]
    state = state / state.sum(axis=1, keepdims=True)
    forward[: active[0]] = state
    cuts, counts = at.tolist(), active.tolist()
    for t in range(1, steps):
        a, b = cuts[t], cuts[t + 1]
        state = (state[: counts[t]] @ step) * scaled[a:b]
        state /= state.sum(axis=1, keepdims=True)
        forward[a:b] = state
    back = np.ones((len(sizes), scaled.shape[1]), scaled.dtype)
    chances = np.empty_like(scaled)
    moves = np.zeros_like(step, dtype=np.float64)
    for t in range(steps - 1, -1, -1):
        a, b, n = cuts[t], cuts[t + 1], counts[t]
        own = forward[a:b] * back[:n]
        own /= own.sum(axis=1, keepdims=True)
        chances[a:b] = own
        if t:
            right = scaled[a:b] * back[:n]
            if collect:
                pair = forward[cuts[t - 1] : cuts[t - 1] + n, :, None] * step * right[:, None, :]
                moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            ahead = right @ step.T
            back[:n] = ahead / ahead.sum(axis=1, keepdims=True)
    out = np.empty_like(chances)
    out[place] = chances
    return (out, moves) if collect else out


def fit(labels: list[str], texts: list[tuple[list[str], np.ndarray]], rounds: int = 6, batch: int = 128) -> Chain:
    """The chain that makes the labels of the texts' words likely, by adaptive gradient steps."""
    vocabulary = sorted({word for words, _ in texts for word in words})
    number = {word: i for i, word in enumerate(vocabulary)}
    width = max(len(word) for word in vocabulary) + GRAM + 2 * AFFIX + 2
    table = np.full((len(vocabulary), width), FEATURES, np.int64)
    for rows, codes in by_length(vocabulary):
        own = word_features(codes)
        table[rows, : own.shape[1]] = own
    coded = [np.array([number[word] for word in words]) for words, _ in texts]
    kinds = len(labels)
    emit, move = np.zeros((FEATURES + 1, kinds)), np.zeros((kinds, kinds))
    emit_sum, move_sum = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    draw = np.random.default_rng(0)
    for _ in range(rounds):
        for part in np.array_split(draw.permutation(len(texts)), max(1, len(texts) // batch)):
            words = np.concatenate([coded[i] for i in part])
            gold = np.concatenate([texts[i][1] for i in part])
            lengths = np.array([len(coded[i]) for i in part])
            distinct, back = np.unique(words, return_inverse=True)
            features = table[distinct]
            chances, moves = marginals(emit[features].sum(axis=1)[back], lengths, move, collect=True)
            chances[np.arange(len(gold)), gold] -= 1
            inside = np.ones(len(gold), bool)
            inside[offsets(lengths)[:-1]] = False
            np.subtract.at(moves, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
            each = np.stack([np.bincount(back, chances[:, k], len(distinct)) for k in range(kinds)], axis=1)
            flat = features.ravel()
            slope = np.stack([np.bincount(flat, np.repeat(each[:, k], features.shape[1]), FEATURES + 1) for k in range(kinds)], axis=1)
            slope = slope / len(part) + 1e-5 * emit
            slope[FEATURES] = 0
            moves = moves / len(part)
            emit_sum += slope**2
            move_sum += moves**2
            emit -= 0.2 * slope / np.sqrt(emit_sum)
            move -= 0.2 * moves / np.sqrt(move_sum)
    return Chain(labels, emit[:FEATURES].astype(np.float32), move.astype(np.float32))
