"""Made-up prose for tests."""

from __future__ import annotations

import random


def vocabulary(seed, letters, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n)]


def prose(rnd, words, n):
    out = []
    for i in range(n):
        w = rnd.choice(words)
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out)
