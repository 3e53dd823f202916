"""Joint solutions against every assignment, planted clock errors and odd rows."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators import solve


def every(errors, likely):
    """The best of all assignments, by sums over all pairs."""
    best = None
    for choice in itertools.product(*[range(len(e)) for e in errors]):
        e = [errors[i][c] for i, c in enumerate(choice)]
        squares = [(a - b) ** 2 for a, b in itertools.combinations(e, 2)]
        rms = math.sqrt(sum(squares) / len(squares))
        fit = 1.0 if rms < 0.05 else 0.9 - rms if rms < 0.2 else 0.5 - rms * 0.5 if rms < 0.5 else 0.1 / (1 + rms * 2)
        score = round(0.9 * fit + 0.1 * math.prod(likely[i][c] for i, c in enumerate(choice)), 12)
        if best is None or score > best[2]:
            best = list(choice), rms, score
    return best


@pytest.mark.parametrize("n, spread", [(2, 0.01), (5, 0.01), (5, 0.1), (5, 0.6), (5, 5.0), (6, 0.3)])
def test_equals_every_assignment(n, spread):
    draw = random.Random(n * 100 + int(spread * 10))
    for _ in range(25):
        errors = [[draw.choice([0.0, 0.7, 2.1, -1.3]) + draw.gauss(0, spread) for _ in range(draw.randint(1, 4))] for _ in range(n)]
        likely = [[draw.choice([1.0, 0.8, 0.7, 0.5]) for _ in e] for e in errors]
        choice, rms, score, exact = solve.best_assignment(errors, likely)
        want = every(errors, likely)
        assert exact and choice == want[0] and score == want[2] and abs(rms - want[1]) < 1e-9


def test_equal_scores_take_the_first():
    assert solve.best_assignment([[1.0, 1.0], [1.0, 1.0, 1.0]], [[0.5, 0.5], [0.9, 0.9, 0.9]])[0] == [0, 0]


@pytest.mark.parametrize("spread", [0.0, 0.05, 3.0])
def test_work_is_bounded_with_many_observations(spread):
    draw = random.Random(3)
    errors = [[0.0 + draw.gauss(0, spread), *(draw.uniform(-9, 9) for _ in range(4))] for _ in range(17)]
    likely = [[draw.choice([1.0, 0.8, 0.7]) for _ in range(5)] for _ in errors]
    began = time.perf_counter()
    choice, rms, score, exact = solve.best_assignment(errors, likely)
    assert time.perf_counter() - began < 5
    assert exact or spread > 1
    if spread == 0:
        assert choice == [0] * 17
    # Never worse than each option next to any middle.
    for middle in range(-9, 10):
        near = [min(range(5), key=lambda c: abs(e[c] - middle)) for e in errors]
        assert score >= every([[e[c]] for e, c in zip(errors, near)], [[p[c]] for p, c in zip(likely, near)])[2]


def delays(spark, km):
    return spark.range(1).select(solve.path_modes(F.lit(float(km))).alias("m")).first().m


def test_paths_by_distance(spark):
    told = {km: [(m.mode, m.hops, m.plausibility) for m in delays(spark, km)] for km in (100, 1600, 3000, 3500, 9000)}
    assert told[100] == [("1E", 1, 1.0), ("1F", 1, 1.0)]
    assert told[1600] == [("1E", 1, 0.7), ("1F", 1, 1.0), ("2F", 2, 0.5)]
    assert told[3000] == [("1F", 1, 0.8), ("2F", 2, 0.5)] and told[3500] == [("1F", 1, 0.8), ("2F", 2, 0.8)]
    assert told[9000] == [("3F", 3, 0.7)]
    half = 3500 / 4 / 6371
    slant = 2 * math.sqrt((6371 + 300) ** 2 - (6371 * math.cos(half)) ** 2)
    assert abs(delays(spark, 3500)[1].delay - 2 * slant / 299792.458 * 1000) < 1e-9


@pytest.fixture
def observed(spark):
    """Cycle 0: four stations, each by its second path (or its only one), the clock 2.5 ms off; cycle 1: one station; cycle 2: a station of unknown distance; 3: nulls."""
    rows, kms = [], {"a": 900.0, "b": 1700.0, "c": 3500.0, "d": 9000.0}
    for name, km in kms.items():
        rows.append((0, name, km, 2.5 + [m.delay for m in delays(spark, km)][min(1, len(delays(spark, km)) - 1)]))
    rows += [(1, "a", 900.0, 7.0), (2, "a", 900.0, 5.0), (2, "zz", None, 1.0), (3, "a", 900.0, None), (3, "b", 1700.0, math.nan)]
    df = spark.createDataFrame(rows, "cycle int, station string, km double, t double")
    return df.withColumn("modes", F.when(F.col("km").isNotNull(), solve.path_modes(F.col("km"))))


def test_planted_clock_error_is_found(observed):
    got = {r.cycle: r for r in solve.global_solution(observed, ["cycle"], "station", "t", "modes").collect()}
    assert sorted(got) == [0, 1, 2]
    g = got[0]
    assert (g.n, g.pairs, g.verified, g.grade, g.exact) == (4, 6, True, "A", True) and abs(g.clock_error - 2.5) < 1e-9 and g.rms < 1e-6
    assert [a.mode for a in g.assignments] == ["1F", "1F", "2F", "3F"]
    assert (got[1].n, got[1].clock_error, got[1].confidence, got[1].verified, got[1].grade) == (1, None, 0.0, False, "D")
    assert [a.mode for a in got[2].assignments][1] == "UNKNOWN" and got[2].clock_error is not None
    assert solve.global_solution(observed.limit(0), ["cycle"], "station", "t", "modes").count() == 0


def test_pairs(observed):
    got = {(r.a, r.b): r for r in solve.pair_solutions(observed, ["cycle"], "station", "t", "modes").where("cycle = 0").collect()}
    assert len(got) == 6
    assert got["a", "d"].verified and abs(got["a", "d"].clock_error - 2.5) < 1e-9 and (got["a", "d"].mode_a, got["a", "d"].mode_b) == ("1F", "3F")
    assert all(r.agreement >= 0 and 0 <= r.confidence <= 1 and r.a < r.b for r in got.values())
    wide = observed.withColumn("spread", F.lit(2.0))
    less = {(r.a, r.b): r for r in solve.pair_solutions(wide, ["cycle"], "station", "t", "modes", "spread").where("cycle = 0").collect()}
    assert abs(less["a", "d"].confidence - 0.7 * got["a", "d"].confidence) < 1e-9 or got["a", "d"].confidence == 1.0


def test_anchor_enters_the_rows(spark, observed):
    rows = spark.createDataFrame([(0, "a", "a1", 2.0, 1.0)], "cycle int, s string, b string, v double, w double")
    out = solve.anchored(rows, solve.global_solution(observed, ["cycle"], "station", "t", "modes"), "cycle", "s", "b", "v", "w")
    anchors = {r.cycle: r for r in out.where("s = 'GLOBAL'").collect()}
    assert 1 not in anchors and abs(anchors[0].v - 2.5) < 1e-9 and anchors[0].w >= 10
