import math

import pytest

from evalloom.functions import dist


def test_known_values():
    assert dist.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-6)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8) and dist.t_cdf(2, 7) == pytest.approx(0.957190336, abs=1e-8)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and dist.chi2_sf(0, 3) == 1
    assert dist.binom_two_sided(0, 0) == 1 and dist.binom_two_sided(1, 9) == pytest.approx(22 / 1024)
    assert dist.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert dist.signed_rank_exact(3, 6) == pytest.approx(0.15625) and dist.signed_rank_exact(0, 5) == pytest.approx(0.0625)


def test_inverse_and_limits():
    for p in (0.01, 0.3, 0.9):
        assert dist.beta_cdf(dist.beta_ppf(p, 3, 4), 3, 4) == pytest.approx(p, abs=1e-10)
    assert dist.odds_ci(0, 0, 0.05) == (None, None) and dist.odds_ci(0, 5, 0.05)[0] == 0 and math.isinf(dist.odds_ci(5, 0, 0.05)[1])
    low, high = dist.odds_ci(5, 10, 0.05)
    assert low == pytest.approx(0.1341, abs=1e-4) and high == pytest.approx(1.6055, abs=1e-4)
