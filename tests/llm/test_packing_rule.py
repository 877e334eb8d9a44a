"""The sum-of-squares rule against one that tries every choice."""

from collections import Counter

import numpy as np
import pytest

from respira.llm import packing


def tried(lengths, capacity, price):
    """The sum after every item, by trying all gaps and a new bin."""
    gaps, sums = Counter(), []
    total = lambda g: sum(n * n for gap, n in g.items() if gap and gap < capacity)
    for s in lengths:
        choices = []
        for gap in sorted(g for g, n in gaps.items() if n and g >= s):
            after = Counter(gaps)
            after[gap] -= 1
            after[gap - s] += 1
            choices.append((total(after), gap, after))
        after = Counter(gaps)
        after[capacity - s] += 1
        choices.append((total(after) + price, capacity, after))
        gaps = min(choices, key=lambda c: (c[0], c[1]))[2]
        sums.append(total(gaps))
    return sums, sum(gaps.values())


@pytest.mark.parametrize("price", [0, 3, 30])
def test_every_choice_is_the_least(price):
    rng = np.random.default_rng(price)
    for _ in range(15):
        lengths = rng.integers(1, 20, 60)
        bins, offsets = packing.sum_of_squares(lengths, 20, price)
        gaps, sums = Counter(), []
        for s, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            gaps[b] = 20 - at - s
            counts = Counter(gaps.values())
            sums.append(sum(n * n for g, n in counts.items() if g))
        assert (sums, len(gaps)) == tried(lengths.tolist(), 20, price)


def test_default_price_opens_later_than_the_plain_rule():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2048, 4000))[::-1]
    used = [packing.sum_of_squares(lengths, 2048, p)[0].max() + 1 for p in (None, 0)]
    assert used[0] < used[1] and used[0] <= 1.01 * lengths.sum() / 2048
