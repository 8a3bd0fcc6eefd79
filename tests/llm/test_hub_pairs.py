"""A pair of hubs comes out of a list once, however many sets lie near them."""

import numpy as np

from leafquery.llm import jaccard


def test_one_row_for_a_pair_of_hubs():
    m = 60
    rng = np.random.default_rng(5)
    comp = np.arange(m) % 2
    hub, d = comp + 10, rng.random(m) / 10
    same = np.zeros(m, np.int64)
    got = jaccard._hub_pairs(same + 50, same, same, comp, hub, d, 80)
    assert got == {(10, 11): max(d[i] + d[j] for i in range(m) for j in range(m) if comp[i] != comp[j])}
