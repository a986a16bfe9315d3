"""What a sentence is by its wording: a linear model over words, pairs of words and character n-grams.

The model is a logistic regression that is trained here, in the driver, on labelled rows: examples
that ``examples`` makes by rule, and ordinary passages that a caller hands over. Its weights are
sums over words, so that a sentence costs a few look-ups: a word's own weight and that of its
character n-grams are added up once and kept in a bounded memo. N-grams carry the verdict over to
words and languages that no example has.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np

N = 3
STEPS = 120
RATE = 0.15
PENALTY = 2e-4
MEMO_ENTRIES = 300_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[{}\[\]<>=:…]|\.\.\.")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{2,}\b|\d+")


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers and codes as 0, and a few signs."""
    return _TOKEN.findall(_HEX.sub("0", text.lower().replace("’", "'").replace("'", "")))


def expand(pattern: str, rng: random.Random) -> str:
    """One text of a pattern in which (a|b|) stands for any of its parts."""
    while (m := re.search(r"\(([^()]*)\)", pattern)) is not None:
        pattern = pattern[: m.start()] + rng.choice(m.group(1).split("|")) + pattern[m.end() :]
    return re.sub(r"\s+", " ", pattern).strip()


def _parts(word: str) -> list[str]:
    t = f"<{word}>"
    return [t[i : i + N] for i in range(len(t) - N + 1)] if len(word) > 1 else []


def features(words: list[str]) -> list[str]:
    out = [f"w{w}" for w in words]
    out += [f"b{a} {b}" for a, b in zip(["^", *words], words)]
    for w in words:
        out += [f"c{g}" for g in _parts(w)]
    return out


class Wording:
    """Log-odds that a text is of the wanted kind."""

    def __init__(self, wanted: list[str], others: list[str]):
        wanted, others = sorted(set(wanted)), sorted(set(others))
        rows = [tokens(x) for x in wanted + others]
        label = np.array([1.0] * len(wanted) + [0.0] * len(others))
        keep = [k for k, r in enumerate(rows) if r]
        rows, label = [rows[k] for k in keep], label[keep]
        number: dict[str, int] = {}
        at, who, size = [], [], []
        for k, words in enumerate(rows):
            got = [number.setdefault(f, len(number)) for f in features(words)]
            at += got
            who += [k] * len(got)
            size.append(1 / math.sqrt(len(words)))
        at, who, size = np.array(at), np.array(who), np.array(size)
        # character n-grams weigh a third: there are more of them
        by = np.array([0.33 if f[0] == "c" else 1.0 for f in number])
        value = by[at] * size[who] if len(at) else np.zeros(0)
        w, bias = np.zeros(len(number)), 0.0
        g2, b2 = np.full(len(number), 1e-8), 1e-8
        n1 = max(label.sum(), 1)
        weight = np.where(label == 1, 0.5 / n1, 0.5 / max(len(label) - n1, 1))
        for _ in range(STEPS):
            x = np.bincount(who, w[at] * value, len(rows)) + bias
            off = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - label) * weight * 1000
            g = np.bincount(at, off[who] * value, len(number)) + PENALTY * 1000 * w
            g2 += g * g
            w -= RATE * g / np.sqrt(g2)
            b2 += off.sum() ** 2
            bias -= RATE * off.sum() / math.sqrt(b2)
        self.bias = float(bias)
        scaled = (w * by).tolist()
        self.own = {f[1:]: v for f, v in zip(number, scaled) if f[0] == "w"}
        self.gram = {f[1:]: v for f, v in zip(number, scaled) if f[0] == "c"}
        self.pair = {tuple(f[1:].split(" ", 1)): v for f, v in zip(number, scaled) if f[0] == "b" and abs(v) > 1e-4}
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        known = self.memo.get(w)
        if known is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            known = self.memo[w] = self.own.get(w, 0.0) + sum(self.gram.get(g, 0.0) for g in _parts(w))
        return known

    def score(self, words: list[str]) -> float:
        """Log-odds of a text's tokens; a text without any is of no kind."""
        if not words:
            return -math.inf
        memo, pair = self.memo, self.pair
        total = 0.0
        before = "^"
        for w in words:
            s = memo.get(w)
            total += (self.word(w) if s is None else s) + pair.get((before, w), 0.0)
            before = w
        return self.bias + total / math.sqrt(len(words))
