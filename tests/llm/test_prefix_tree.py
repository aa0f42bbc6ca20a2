import numpy as np
import pytest

from pathloom.llm.ngram_join import PrefixTree, gram_set


def _brute(sets, percent):
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def _partition(label):
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(int(x), []).append(i)
    return sorted(map(tuple, groups.values()))


@pytest.mark.parametrize("seed", range(30))
def test_trie_finds_the_components_of_all_links(seed):
    rng = np.random.default_rng(seed)
    sets, seen = [], set()
    for _ in range(40):
        if sets and rng.random() < 0.7:
            base = sets[rng.integers(len(sets))]
            s = np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 60, rng.integers(0, 3)).astype(np.uint64)]))
        else:
            s = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
        if len(s) and s.tobytes() not in seen:
            seen.add(s.tobytes())
            sets.append(s)
    for percent in (50, 80, 100):
        assert _partition(PrefixTree(sets).components(percent)) == _partition(_brute(sets, percent))


def test_gram_sets():
    assert len(gram_set(None)) == len(gram_set(" \t\n")) == 0
    assert len(gram_set("a b")) == 1 and len(gram_set("a b c d e f")) == 2
    assert (gram_set("A  b\nC") == gram_set("a b c")).all()
    assert gram_set("a b c d")[0] != gram_set("a b c d d")[0]
