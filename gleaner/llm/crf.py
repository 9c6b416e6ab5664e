"""A linear-chain conditional random field with two labels, trained on partly labelled sequences."""

from __future__ import annotations

import json

import numpy as np

STEPS, RATE, DECAY = 90, 0.15, 1e-4


def posteriors(x: np.ndarray, moves: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each label at each place, expected moves) of all sequences at once, by forward-backward.

    ``x``: sequences x places x labels, log potentials; ``live`` tells the places that exist, from the left.
    """
    n, longest, _ = x.shape
    ahead, behind = np.zeros_like(x), np.zeros_like(x)
    ahead[:, 0] = x[:, 0]
    for k in range(1, longest):
        step = np.logaddexp(ahead[:, k - 1, :1] + moves[0], ahead[:, k - 1, 1:] + moves[1]) + x[:, k]
        ahead[:, k] = np.where(live[:, k, None], step, ahead[:, k - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
    for k in range(longest - 2, -1, -1):
        y = x[:, k + 1] + behind[:, k + 1]
        step = np.stack([np.logaddexp(moves[a, 0] + y[:, 0], moves[a, 1] + y[:, 1]) for a in (0, 1)], axis=1)
        behind[:, k] = np.where(live[:, k + 1, None], step, 0)
    single = np.exp(ahead + behind - total)
    both = ahead[:, :-1, :, None] + moves + (x + behind)[:, 1:, None, :] - total[..., None]
    return single, np.exp(np.where(live[:, 1:, None, None], both, -np.inf)).sum(axis=(0, 1))


class Field:
    """Weights of named features (for label 1) and of the moves between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.table = {name: float(weights[k]) for name, k in names.items()}

    def to_json(self) -> str:
        return json.dumps([self.table, self.moves.tolist()])

    @staticmethod
    def from_json(text: str) -> Field:
        table, moves = json.loads(text)
        return Field({n: i for i, n in enumerate(table)}, np.array(list(table.values())), np.array(moves))

    def score(self, row: list[str]) -> float:
        get = self.table.get
        return sum([get(name, 0.0) for name in row])

    def decode(self, scores: list[float], least_one: bool = False) -> list[int]:
        """The best labels, by Viterbi; with ``least_one`` the best of those that have label 1 somewhere."""
        n = len(scores)
        if not n:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        if not least_one:
            zero, one, back = 0.0, scores[0], []
            for x in scores[1:]:
                a, b = zero + m00 >= one + m10, zero + m01 >= one + m11
                zero, one = (zero + m00 if a else one + m10), (zero + m01 if b else one + m11) + x
                back.append((0 if a else 1, 0 if b else 1))
            label = int(one > zero)
            out = [label]
            for step in reversed(back):
                label = step[label]
                out.append(label)
            return out[::-1]
        # states: 0 before the first 1, 1, and 0 after one
        gone = float("-inf")
        state, back = [0.0, scores[0], gone], []
        for x in scores[1:]:
            one = max((state[0] + m01, 0), (state[1] + m11, 1), (state[2] + m01, 2))
            rest = max((state[1] + m10, 1), (state[2] + m00, 2))
            state = [state[0] + m00, one[0] + x, rest[0]]
            back.append((0, one[1], rest[1]))
        at = 1 if state[1] >= state[2] else 2
        out = [int(at == 1)]
        for step in reversed(back):
            at = step[at]
            out.append(int(at == 1))
        return out[::-1]

    @staticmethod
    def train(sequences: list[tuple[list[list[str]], list[int | None]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY, least: int = 1) -> Field:
        """Maximum likelihood of the known labels (unknown ones are summed over) with a small ridge, by Adam on all sequences.

        Features that hold at fewer than ``least`` places are left out.
        """
        sequences = [s for s in sequences if s[0]]
        if not sequences:
            return Field({}, np.zeros(0), np.zeros((2, 2)))
        often: dict[str, int] = {}
        for rows, _ in sequences:
            for row in rows:
                for f in row:
                    often[f] = often.get(f, 0) + 1
        names = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= least))}
        rows = [[names[f] for f in row if f in names] for page, _ in sequences for row in page]
        n = len(rows)
        sizes = np.array([len(p) for p, _ in sequences], dtype=np.int64)
        flat = np.fromiter((f for row in rows for f in row), dtype=np.int64)
        owner = np.repeat(np.arange(n), [len(row) for row in rows])
        truth = np.array([-1 if y is None else y for _, labels in sequences for y in labels], dtype=np.int64)
        starts, longest = np.cumsum(sizes) - sizes, int(sizes.max())
        place = np.minimum(starts[:, None] + np.arange(longest), n - 1)
        live = np.arange(longest) < sizes[:, None]
        bar = np.where(np.stack([truth == 1, truth == 0], axis=1), -np.inf, 0.0)[place]  # known labels leave one way only
        bar[~live] = 0
        whole = bool((truth >= 0).all())
        inner = live[:, 1:]
        counted = np.zeros((2, 2))
        if whole:
            np.add.at(counted, (truth[place[:, :-1][inner]], truth[place[:, 1:][inner]]), 1)
        theta = np.zeros(len(names) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
            s = np.bincount(owner, weights[flat], n)
            x = np.stack([np.zeros(n), s], axis=1)[place]
            with np.errstate(invalid="ignore", divide="ignore"):
                free, free_moves = posteriors(x, moves, live)
                held, held_moves = (None, counted) if whole else posteriors(x + bar, moves, live)
            error = np.zeros(n)
            error[place[live]] = free[:, :, 1][live] - (truth[place[live]] if whole else held[:, :, 1][live])
            grad = np.concatenate([np.bincount(flat, error[owner], len(names)), (free_moves - held_moves).ravel()]) / n + decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return Field(names, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())
