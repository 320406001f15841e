"""Growing rules and weighing them, against brute force and conditions of optimality."""

import numpy as np
import pytest

from tidemark.llm.quality import grow_rules, lasso_logistic


def holds(rule, x, names):
    return np.all([(x[:, names.index(n)] > limit) == above for n, above, limit in rule], axis=0)


def data(seed, n=300, d=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(float)
    odd = rng.random(n) < 0.05
    y[odd] = 1 - y[odd]
    return x, y


def best_split(x, residual, inside, least, thresholds):
    """The first gain of sums of squares above all others, by trying each threshold of each statistic."""
    best = (1e-9, None)
    own, total, count = residual[inside], residual[inside].sum(), inside.sum()
    for j, limits in enumerate(thresholds):
        for limit in limits:
            high = x[inside, j] > limit
            a, b = high.sum(), count - high.sum()
            if a >= least and b >= least:
                s = own[high].sum()
                gain = s * s / a + (total - s) ** 2 / b - total * total / count
                if gain > best[0] + 1e-9:
                    best = (gain, (j, limit))
    return best[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_of_the_first_tree(seed):
    x, y = data(seed)
    names, least = list("abcd"), 10
    got = grow_rules(x, y, names, trees=1, depth=2, cuts=16, least=least)
    thresholds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 18)[1:-1])) for j in range(4)]
    residual, everything = y - 0.5, np.ones(len(y), bool)
    want = set()
    j, limit = best_split(x, residual, everything, least, thresholds)
    for above in (True, False):
        want.add(((names[j], above, limit),))
        inside = (x[:, j] > limit) == above
        if inside.sum() >= 2 * least and (further := best_split(x, residual, inside, least, thresholds)):
            want |= {tuple(sorted([(names[j], above, limit), (names[further[0]], side, further[1])])) for side in (True, False)}
    assert set(got) == want


def test_rules_have_rows_enough_and_stay_shallow():
    x, y = data(5)
    names = list("abcd")
    rules = grow_rules(x, y, names, trees=10, depth=3, least=15)
    assert len(rules) == len(set(rules)) > 10 and {len(r) for r in rules} <= {1, 2, 3}
    assert all(holds(r, x, names).sum() >= 15 for r in rules)


@pytest.mark.parametrize("penalty", [1e-4, 5e-3, 5e-2, 10.0])
def test_weights_are_optimal(penalty):
    """The objective is convex, so these conditions on its gradient hold at its minimum and nowhere else."""
    x, y = data(7)
    names = list("abcd")
    z = np.array([holds(r, x, names) for r in grow_rules(x, y, names, trees=4)], float).T
    intercept, weights = lasso_logistic(z, y, penalty, rounds=20_000)
    wrong = 1 / (1 + np.exp(-(intercept + z @ weights))) - y
    slope = z.T @ wrong / len(y)
    assert abs(wrong.mean()) < 1e-5
    used = weights != 0
    assert np.all(np.abs(slope[used] + penalty * np.sign(weights[used])) < 2e-5) and np.all(np.abs(slope[~used]) <= penalty + 2e-5)
    assert used.any() == (penalty < 1)


def test_fewer_rules_with_a_larger_penalty():
    x, y = data(9)
    names = list("abcd")
    z = np.array([holds(r, x, names) for r in grow_rules(x, y, names, trees=6)], float).T
    kept = [np.count_nonzero(lasso_logistic(z, y, p, rounds=5000)[1]) for p in (1e-4, 1e-2, 1e-1)]
    assert kept[0] > kept[1] > kept[2]
