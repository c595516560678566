import pytest

from tidefold.functions.rng import spawned


@pytest.mark.parametrize("seed", [0, 1, 42, 2**40])
def test_spawned_seeds(seed):
    many = spawned(seed, 200)
    assert len(set(many)) == 200 and seed not in many and all(0 <= s < 2**63 for s in many)
    assert spawned(seed, 5) == many[:5] and spawned(seed + 1, 5) != many[:5] and spawned(seed, 0) == []
