"""Disguises of every width are found and read."""

import random

import numpy as np
import pytest

from loomtale.llm import toxicity


@pytest.fixture(scope="module")
def model():
    counts = toxicity._trigrams(["you idiot of the town", "an idiot is what the idiot was", "the moron of the day"] * 300)
    return toxicity.Model(-np.log(toxicity._conditional(counts)), {"idiot": 5.0, "moron": 5.0}, None, 0.5)


def test_prefilter_is_a_superset():
    rng = random.Random(3)
    parts = ["a", "I", "o", "o", "1", "$", "*", " ", "  ", ".", "-", "_", "\n", "　", "²", "İ", "é", "ab", ",", "東"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(40_000)]
    for kind, which in zip((toxicity.APART, toxicity.AMONG, toxicity.AGAIN), toxicity._suspects(texts), strict=True):
        assert {i for i, t in enumerate(texts) if kind.search(t)} <= set(which)


@pytest.mark.parametrize("hidden", ["i d i o t", "i  d  i  o  t", "i. d. i. o. t", "i--d--i--o--t", "i - d - i - o - t", "1   d   1   0   t"])
def test_wide_separators(model, hidden):
    assert model.restore([f"of {hidden} the"]) == ["of idiot the"]
    assert model.restore([hidden]) == ["idiot"]


@pytest.mark.parametrize("hidden", ["id" + "i" * 45 + "ot", "id" + "1" * 45 + "ot", "id" + "!" * 5000 + "ot", "I" * 60 + "D1" + "0" * 60 + "t", "i " * 50 + "d i o t"])
def test_long_stretches(model, hidden):
    assert model.restore([f"of {hidden} the"]) == ["of idiot the"]
    assert model.evidence(model.restore([f"of {hidden} the"]))[0, 2] > 0


def test_long_candidates(model):
    """Committing what all paths share changes no reading, and the time follows the length."""
    long = "1d10t" * 100
    whole = model.decode(long)
    assert whole == "idiot" * 100
    assert model.decode("1d10t" * 10_000) == "idiot" * 10_000


def cheapest(model, letters):
    """The least cost of all readings, by recursion over every choice."""
    import math

    def go(k, a, b, out):
        if k == len(letters):
            return float(model.cost[a, b, 0])
        c = letters[k]
        run = 1
        while k - run >= 0 and letters[k - run] == c:
            run += 1
        own = toxicity._NUMBER.get(c, 0)
        ways = [(c, own, 0.0 if c.isalpha() else toxicity.KEEP)] + [(x, toxicity._NUMBER[x], toxicity.SWAP) for x in toxicity.LOOKS_LIKE.get(c, "")]
        best = min((channel + float(model.cost[a, b, n]) + go(k + 1, b, n, x) for x, n, channel in ways), default=math.inf)
        if run > 1 and out and (out == c or out in toxicity.LOOKS_LIKE.get(c, "")):
            shrink = toxicity.SHRINK_DOUBLE if run == 2 and letters[k + 1 : k + 2] != c else toxicity.SHRINK
            best = min(best, shrink + go(k + 1, a, b, out))
        return best

    return go(0, 0, 0, "")


def spelled_cost(model, letters, reading):
    """The least cost of one reading."""
    import math
    from functools import lru_cache

    @lru_cache(None)
    def go(k, j, a, b):
        if k == len(letters):
            return float(model.cost[a, b, 0]) if j == len(reading) else math.inf
        c = letters[k]
        run = 1
        while k - run >= 0 and letters[k - run] == c:
            run += 1
        best = math.inf
        if j < len(reading):
            x = reading[j]
            n = toxicity._NUMBER.get(x, 0)
            if x == c:
                best = (0.0 if c.isalpha() else toxicity.KEEP) + float(model.cost[a, b, n]) + go(k + 1, j + 1, b, n)
            if x in toxicity.LOOKS_LIKE.get(c, ""):
                best = min(best, toxicity.SWAP + float(model.cost[a, b, n]) + go(k + 1, j + 1, b, n))
        if run > 1 and j and (reading[j - 1] == c or reading[j - 1] in toxicity.LOOKS_LIKE.get(c, "")):
            shrink = toxicity.SHRINK_DOUBLE if run == 2 and letters[k + 1 : k + 2] != c else toxicity.SHRINK
            best = min(best, shrink + go(k + 1, j, a, b))
        return best

    return go(0, 0, 0, 0)


def test_viterbi_against_all_readings(model):
    """The reading costs what the cheapest of all readings costs, with look-alikes, repeats and spacing."""
    rng = random.Random(9)
    for _ in range(150):
        letters = "".join(rng.choice("idot1!0mrn*66") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(2, 5)))[:7]
        assert spelled_cost(model, letters, model.decode(letters)) == pytest.approx(cheapest(model, letters), abs=1e-4), letters
    spaced = " ".join("1d10t")
    assert model.decode(spaced) == model.decode("1d10t") == "idiot"


def test_copies_are_told_row_by_row():
    """Independent texts of a Zipf vocabulary aren't copies of each other; near copies are."""
    rng = np.random.default_rng(1)
    words = ["w" + "".join(chr(97 + int(d)) for d in str(k)) for k in range(50_000)]
    weight = 1 / np.arange(1, 50_001)
    drawn = [" ".join(words[k] for k in rng.choice(50_000, 300, p=weight / weight.sum())) for _ in range(400)]
    assert sum(toxicity.copies(drawn)) <= 4
    near = [" ".join(w if rng.random() > 0.03 else "changed" for w in t.split()) for t in drawn[:50]]
    found = toxicity.copies(drawn + near)
    assert sum(found[400:]) >= 48 and toxicity.copies(["same text", "same text", "other"]) == [False, True, False]
