"""Bin completion next to exhaustive packings."""

import itertools
from collections import Counter

import numpy as np
import pytest

from duoglot.llm import packing


def fewest(lengths, capacity):
    """The least number of sequences, by a table over all subsets."""
    n = len(lengths)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (1, 0)
    for done in range(1, 1 << n):
        for i in range(n):
            if done >> i & 1:
                bins, used = best[done ^ 1 << i]
                fits = used + lengths[i] <= capacity
                best[done] = min(best[done], (bins, used + lengths[i]) if fits else (bins + 1, lengths[i]))
    return best[-1][0] if n else 0


def checked(counts, capacity, patterns):
    placed = np.zeros(capacity + 1, np.int64)
    for pattern in patterns:
        assert 0 < sum(pattern.lengths) <= capacity and pattern.times > 0
        for length in pattern.lengths:
            placed[length] += pattern.times
    assert (placed == counts).all()
    return sum(pattern.times for pattern in patterns)


@pytest.mark.parametrize("seed", range(25))
def test_small_packings_are_optimal(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 40))
    lengths = rng.integers(1, rng.integers(3, capacity + 1), int(rng.integers(1, 11))).tolist()
    least = fewest(lengths, capacity)
    found = packing.complete_bins(Counter(lengths), least, capacity, packing.Steps(10**6))
    assert len(found) == least and Counter(itertools.chain(*found)) == Counter(lengths)
    assert all(sum(bin_) <= capacity for bin_ in found)
    assert packing.complete_bins(Counter(lengths), least - 1, capacity, packing.Steps(10**6)) is None
    counts = np.bincount(lengths, minlength=capacity + 1)
    assert checked(counts, capacity, packing.bin_completion(counts, capacity)) == least


def fits_for(longer, shorter):
    """Whether pieces of ``shorter`` can each take the place of part of a piece of ``longer``."""
    if not shorter:
        return True
    for n in set(longer):
        if n >= shorter[0]:
            left = list(longer)
            left.remove(n)
            if fits_for(sorted(left + [n - shorter[0]], reverse=True), shorter[1:]):
                return True
    return False


@pytest.mark.parametrize("seed", range(15))
def test_fillings_are_the_undominated_ones(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 14, 9).tolist())
    room, slack = 20, int(rng.integers(0, 5))
    got = list(packing.fillings(counts, room, slack, packing.Steps(10**6)))
    assert len(got) == len(set(got))
    feasible = {tuple(sorted(some, reverse=True)) for k in range(10)
                for some in itertools.combinations(sorted(counts.elements()), k) if sum(some) <= room}
    for filling in got:
        assert filling in feasible and room - sum(filling) <= slack
    # Whatever was left out can be replaced by one that was kept.
    for filling in feasible:
        if room - sum(filling) <= slack and filling not in got:
            assert any(fits_for(list(kept), list(filling)) for kept in got)


@pytest.mark.parametrize("seed", range(4))
def test_search_improves_on_best_fit(seed):
    """Thousands of pieces: the search closes at least half of the gap between best fit and the bound."""
    lengths = np.random.default_rng(seed).integers(20, 101, 3000)
    counts = np.bincount(lengths, minlength=151)
    bound = max(-(-int(lengths.sum()) // 150), int(counts[76:].sum()))
    plain = checked(counts, 150, packing.best_fit_decreasing(counts, 150))
    found = checked(counts, 150, packing.bin_completion(counts, 150))
    assert found >= bound and plain - found >= (plain - bound) / 2 > 0


def test_improvements_repeat():
    """Patterns that repeat often are improved together: 200,000 sequences less, near the bound of 3,000,000."""
    counts = np.zeros(21, np.int64)
    for length, n in ((9, 2), (8, 1), (6, 2), (5, 1), (4, 2), (3, 3)):
        counts[length] = n * 1_000_000
    assert checked(counts, 20, packing.best_fit_decreasing(counts, 20)) > 3_200_000
    assert checked(counts, 20, packing.bin_completion(counts, 20)) < 3_001_000


def test_without_pieces_or_steps():
    assert packing.bin_completion(np.zeros(11, np.int64), 10) == []
    counts = np.bincount(np.random.default_rng(0).integers(20, 101, 500), minlength=151)
    assert checked(counts, 150, packing.bin_completion(counts, 150, nodes=0)) == checked(
        counts, 150, packing.best_fit_decreasing(counts, 150))


def test_words_are_forgotten_once_no_task_uses_them(monkeypatch):
    import time

    import public_tokenizers

    from duoglot.llm import common
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.1)
    path = public_tokenizers.path("word_bpe_49k.json")
    known = packing.remembered(path)
    text = [b"Some", b"words,", b"n\xc3\xa4mlich", b"x-1"]
    with known.idle.in_use():
        ids = [known[word] for word in text]
        time.sleep(0.3)
        assert len(known) >= len(text) and known.stems
    with known.idle.in_use():  # used again in time: nothing is lost
        assert len(known) >= len(text)
    for _ in range(50):
        if not known:
            break
        time.sleep(0.1)
    assert not known and not known.older and not known.stems and not known.encode.known
    assert packing.remembered(path) is known and [known[word] for word in text] == ids
