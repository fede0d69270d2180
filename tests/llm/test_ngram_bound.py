import numpy as np

from quillstone.llm.ngram_join import Tile, bitmap, may_link


def test_bits_never_exceed_the_difference_and_no_link_is_lost():
    rng = np.random.default_rng(3)
    linked = 0
    for n in (1, 4, 5, 60, 426, 427, 500, 900, 3000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.02, 0.1, 0.2, 1.0):
            gone = int(n * share)
            sets = [np.unique(base)]
            sets.append(np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)])))
            sets.append(np.unique(np.concatenate([base, rng.integers(0, 2**63, gone, dtype=np.uint64)])))
            tile = Tile([bitmap(s) for s in sets])
            for x in range(3):
                y = np.array([k for k in range(3) if k != x])
                for k, odd in zip(y, tile.odd(x, y), strict=True):
                    both = len(np.intersect1d(sets[x], sets[k]))
                    assert odd <= len(sets[x]) + len(sets[k]) - 2 * both
                    if 100 * both >= 80 * (len(sets[x]) + len(sets[k]) - both):
                        linked += 1
                        assert may_link(len(sets[x]), len(sets[k]), odd)
    assert linked > 100
