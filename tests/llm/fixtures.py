"""Small made-up corpora with copies, near copies, repeated lines and odd texts."""

from __future__ import annotations

import random

ODD = [None, "", "   \n\t ", "one", "one two three", "one two three", "A" * 5000, "x " * 3000, "été İ ſ ퟿ \U0001f600 word"]


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


def corpus(seed: int = 7, n: int = 60) -> list[tuple[int, str | None]]:
    """Documents with ids in random order; about half are edits of earlier ones, some share a passage or a line."""
    rng = random.Random(seed)
    passage, made = prose(rng, 60), []
    for i in range(n):
        kind = rng.random()
        if made and kind < 0.25:
            words = list(rng.choice(made))
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"e{i}{rng.randrange(99)}"
        elif made and kind < 0.4:
            words = list(rng.choice(made))
        else:
            words = prose(rng, rng.randrange(3, 160))
            if rng.random() < 0.3:
                at = rng.randrange(len(words))
                words[at:at] = passage
        made.append(words)
    texts = ["".join(w + ("\n" if k % 11 == 10 else " ") for k, w in enumerate(words)) for words in made] + ODD
    rng.shuffle(texts)
    return list(enumerate(texts))
