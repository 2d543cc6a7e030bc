"""Beat series against plain Python, whatever their blocks."""

import math
import random
import statistics

import pytest

from graywacke.operators import heartbeat, signals


def series(spark, named):
    return spark.createDataFrame([(k, i, x) for k, values in named.items() for i, x in enumerate(values)], "s string, i long, x double")


def brute_entropy(x, m=2):
    r = 0.2 * statistics.stdev(x)
    near = lambda i, j, k: all(abs(x[i + d] - x[j + d]) <= r for d in range(k))
    pairs = [(i, j) for i in range(len(x) - m) for j in range(i)]
    b, a = (sum(near(i, j, k) for i, j in pairs) for k in (m, m + 1))
    return b, a, -math.log(a / b) if a else None


@pytest.mark.parametrize("m", [2, 3])
def test_sample_entropy_counts_all_pairs(spark, m):
    rng = random.Random(1)
    made = {"noise": [rng.gauss(800, 50) for _ in range(150)], "ties": [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(140)], "wave": [math.sin(i / 5) for i in range(130)], "flat": [5.0] * 40, "short": [1.0, 2.0]}
    for block in (7, 1000):
        found = {r.series: r for r in heartbeat.sample_entropy(series(spark, made), "s", "i", "x", m, block=block).collect()}
        for name in ("noise", "ties", "wave"):
            b, a, entropy = brute_entropy(made[name], m)
            assert (found[name].b, found[name].a) == (b, a) and found[name].entropy == pytest.approx(entropy)
        assert found["flat"].entropy is None and found["short"].entropy is None


def brute_corrected(x, share, reach, longest):
    good = []
    for i, v in enumerate(x):
        near = [y for y in x[max(0, i - reach) : i + reach + 1] if y is not None]
        good.append(v is not None and abs(v - statistics.median(near)) <= share * statistics.median(near))
    out = []
    for i, v in enumerate(x):
        a = next((j for j in range(i - 1, max(-1, i - longest - 1), -1) if good[j]), None)
        b = next((j for j in range(i + 1, min(len(x), i + longest + 1)) if good[j]), None)
        line = None if a is None and b is None else x[b] if a is None else x[a] if b is None else x[a] + (x[b] - x[a]) * (i - a) / (b - a)
        out.append((not good[i], v if good[i] else line))
    return out


@pytest.mark.parametrize("block", [15, 1000])
def test_ectopic_beats_are_bridged(spark, block):
    rng = random.Random(7)
    x = [rng.choice([800, 810, 790, 805, 400, 1300, None]) for _ in range(200)]
    x[50:75] = [100 if i % 2 else 2000 for i in range(25)]  # a run that is too long to bridge
    x = [None if v is None else float(v) for v in x]
    found = heartbeat.without_ectopic(series(spark, {"a": x}), "s", "i", "x", block=block, longest=5).orderBy("i").collect()
    told = brute_corrected(x, heartbeat.ECTOPIC, heartbeat.REACH, 5)
    assert [r.ectopic for r in found] == [e for e, _ in told]
    assert [r.corrected for r in found] == [None if c is None else pytest.approx(c) for _, c in told]
    assert any(r.corrected is None for r in found)


def test_an_even_grid_and_the_band_of_a_rhythm(spark):
    # Breathing at 0.25 Hz: beats at uneven times, all power in the high band.
    t, rows = 0.0, []
    while t < 600:
        x = 800 + 40 * math.sin(2 * math.pi * 0.25 * t)
        rows.append(("a", t, x))
        t += x / 1000
    rows += [("a", 700.0, 800.0), ("a", 700.0, 801.0), ("a", 701.0, None)]  # a gap, a tie, a null
    beats = spark.createDataFrame(rows, "s string, t double, x double")
    grids = [sorted((r.k, r.x) for r in heartbeat.even(beats, "s", "t", "x", 4.0, 5.0, block).collect()) for block in (6.0, 600.0)]
    assert grids[0] == grids[1] and len({k for k, _ in grids[0]}) == len(grids[0]) and max(k for k, _ in grids[0]) < 4 * 601
    assert all(abs(x - 800 - 40 * math.sin(2 * math.pi * 0.25 * k / 4)) < 9 for k, x in grids[0])
    found = heartbeat.lf_hf(beats, "s", "t", "x").first()
    assert found.hf > 50 * found.lf and found.lf_hf == pytest.approx(found.lf / found.hf)


def test_stretches_epochs_and_slowing(spark):
    samples = spark.createDataFrame([("a", t) for t in (0, 10, 20, 500, 505)] + [("b", 3)], "s string, t long")
    assert {r.series: r[1:] for r in heartbeat.stretches(samples, "s", "t", 60).collect()} == {"a": (5, 1, 25.0, 480.0), "b": (1, 0, 0.0, 0.0)}
    wave = {"slow": [math.sin(2 * math.pi * 2 * i / 64) for i in range(640)], "fast": [math.sin(2 * math.pi * 20 * i / 64) for i in range(640)]}
    each = heartbeat.epochs(series(spark, wave), "s", "i", "x", 64.0, 128, 64)
    assert each.select("series", "epoch").distinct().count() == 10
    summed = {(r.series, r.band): r for r in heartbeat.epoch_summary(each).collect()}
    assert summed["slow", "delta"].n == 5 and summed["slow", "delta"].relative > 0.95 and summed["fast", "beta"].relative > 0.95
    ratio = {r.series: r.slowing for r in heartbeat.slowing(signals.band_powers(signals.welch(series(spark, wave), "s", "i", "x", 64.0, 64))).collect()}
    assert ratio["slow"] > 20 and ratio["fast"] < 0.05
    assert heartbeat.sample_entropy(series(spark, {}), "s", "i", "x").count() == 0
