"""A text's features do not depend on which side of a length it falls."""

import pytest

from respira.llm import toxicity


@pytest.mark.parametrize("piece", ["Œuvre Ïle Ëtre Ùn Ìo low ", "ПРИВЕТ мир ΑΒΓ δ ", "ABC déf ÉÈ "])
def test_capitals_at_every_length(piece):
    features = toxicity.Features({})
    found = [features(piece * times)[11] for times in (1, 3, 300)]
    assert found == pytest.approx([sum(map(str.isupper, piece)) / len(piece)] * 3) and len(piece) * 300 > 2000
