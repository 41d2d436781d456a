import numpy as np
import pytest

from chronofact.operators import graph


def test_wide_levels_are_counted_by_node(monkeypatch):
    """Shares over levels that are sorted and over those that are counted are alike, whatever else the graph holds."""
    links = sorted({(a, b) for x in range(1, 40) for a, b in ((0, x), (x, 0), (x, 40 + x % 3), (40 + x % 3, x))})
    to = np.array([b for _, b in links], dtype=np.int32)
    shares, sizes, unique = [], [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **how: sizes.append(len(x)) or unique(x, **how))
    for n in (43, 10_000):  # the larger the graph, the narrower a level of so many links
        total, reached = np.zeros(n), np.zeros(n, dtype=bool)
        graph._add_shares(np.searchsorted([a for a, _ in links], np.arange(n + 1)), to, 0, total, reached)
        assert reached.sum() == 42
        assert any(sizes) == (n == 10_000)
        shares.append(total[:43])
    assert shares[0] == pytest.approx(shares[1]) and shares[0].sum() == pytest.approx(3)
