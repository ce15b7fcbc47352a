"""Small pieces that the tests of this folder share."""

import random

WORDS = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sa", "no", "li", "pe", "du") for b in ("n", "rt", "sh", "le", "m", "x", "gra", "ton", "vi", "k")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def roots(nodes, links):
    """node -> smallest node that the links reach, by union-find."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def table(path: str, name: str, frame) -> None:
    frame.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
