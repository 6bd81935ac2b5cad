from __future__ import annotations

import random


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + rng.choice(["", "s", "ed", ""]) for _ in range(words))
