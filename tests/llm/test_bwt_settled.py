import random

import numpy as np

from graphloom.llm import bwt


def test_rows_together_equal_those_of_the_whole_merge():
    rng = random.Random(2)
    for _ in range(60):
        shards, first = [], 0
        for _ in range(rng.randrange(1, 4)):
            texts = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(rng.randrange(4))]
            shards.append(bwt.transform(texts, first))
            first += len(texts)
        length = rng.randrange(1, 6)
        rows, prefix = bwt.merge(shards, length)
        again = prefix == length
        again[:-1] |= again[1:].copy()
        want = sorted(zip(rows.text[again].tolist(), rows.offset[again].tolist(), strict=True))
        found, touched = bwt.repeated_rows(shards, length)
        text, offset = (np.concatenate([getattr(s, f) for s in shards]) for f in ("text", "offset"))
        assert sorted(zip(text[found].tolist(), offset[found].tolist(), strict=True)) == want
        assert touched <= length * len(text)
