"""Series operators on hand-computed frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.operators import series as S


def ts(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cleaning_against_a_plain_rule(spark):
    rng = np.random.default_rng(31)
    texts = [None, "", "dry", "-inf", "nan", "-0.4", "0", "1e3", " 7.25 ", *[f"{v:.2f}" for v in rng.normal(20, 30, 40)]]
    df = ts(spark, list(enumerate(texts)), "t long, mm string")
    for most, factor in ((42.0, 1.0), (42.0, 1.5)):
        want = {}
        for i, text in enumerate(texts):
            try:
                v = float(text)
            except (TypeError, ValueError):
                v = float("nan")
            odd = not np.isfinite(v)
            want[i] = (0.0 if odd else min(max(v, 0.0) * factor, most), odd)
        got = {r.t: (r.mm, r.is_imputed) for r in S.clean_values(df, "mm", most, factor).collect()}
        assert got == {i: (pytest.approx(v), odd) for i, (v, odd) in want.items()}


def test_hour_ending_totals_against_ceilings(spark):
    rng = np.random.default_rng(32)
    minutes = np.sort(rng.choice(60 * 9, 50, replace=False))
    minutes[10] = minutes[10] // 60 * 60  # a stamp on the hour closes that hour
    values = rng.integers(1, 9, 50)
    rows = ts(spark, [(int(m), float(v)) for m, v in zip(minutes, values)], "m int, mm double")
    rows = rows.select(F.expr("timestamp_ntz'2021-06-05 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0)").alias("ts"), "mm")
    want: dict = {}
    for m, v in zip(minutes, values):
        want[int(-(-m // 60))] = want.get(int(-(-m // 60)), 0.0) + v
    out = {r.t % 24: r.mm for r in S.to_steps(rows, [], S.hour_ending(F.col("ts")), "mm").collect()}
    assert out == want


def test_rain_events_by_clock(spark):
    df = ts(spark, [(t, 1.0) for t in (3, 4, 8, 17, 19, 30)], "t long, mm double")
    got = S.event_totals(S.rain_events(df, [], "mm", 0.0, 2), [], "mm").orderBy("event_id").collect()
    assert [(r.first_t, r.last_t) for r in got] == [(3, 4), (8, 8), (17, 19), (30, 30)]
    adjacent = ts(spark, [(t, 1.0) for t in (2, 7, 8, 11)], "t long, mm double")
    assert [S.rain_events(adjacent, [], "mm", 0.0, g).select("event_id").distinct().count() for g in (1, 2, 4)] == [3, 2, 1]
    inside = S.steps_of_events(S.event_totals(S.rain_events(df, [], "mm", 0.0, 2), [], "mm"), [], spark.range(2, 10).withColumnRenamed("id", "t"))
    assert [r.event_id for r in inside.orderBy("t").collect()] == [-1, 1, 1, -1, -1, -1, 2, -1]


def test_trailing_and_antecedent_sums_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t), float(v)) for k in range(3) for t, v in zip(np.sort(rng.choice(200, 80, replace=False)), rng.gamma(1, 2, 80))]
    df = ts(spark, rows, "node long, t long, mm double")
    out = S.antecedent(S.trailing_sums(df, ["node"], "mm", [3, 24]), ["node"], "mm", 6).collect()
    for r in out:
        mine = [(t, v) for k, t, v in rows if k == r.node]
        for w, got in ((3, r.sum_3), (24, r.sum_24)):
            assert got == pytest.approx(sum(v for t, v in mine if r.t - w < t <= r.t))
        assert r.antecedent == pytest.approx(sum(v for t, v in mine if r.t - 6 <= t < r.t))
    again = S.trailing_sums(df.repartition(7), ["node"], "mm", [3]).agg(F.sum("sum_3")).first()[0]
    assert again == pytest.approx(sum(r.sum_3 for r in out))


def test_gap_filling_blocks_and_runs(spark):
    df = ts(spark, [(1, 2.0, None, "a"), (2, 1.0, True, None), (6, 3.0, False, "b"), (7, 1.0, False, "a")], "t long, mm double, is_imputed boolean, source string")
    got = {r.t: (r.mm, r.is_imputed, r.source) for r in S.fill_gaps(df, [], "mm").collect()}
    assert got[3] == got[5] == (0.0, True, "missing") and got[2] == (1.0, True, "a") and got[1] == (2.0, False, "a") and len(got) == 7
    assert [(r.first_t, r.last_t, r.n) for r in S.block_spans(df, []).orderBy("first_t").collect()] == [(1, 2, 2), (6, 7, 2)]
    flags = ts(spark, [(t, f) for t, f in zip([1, 2, 3, 4, 6, 7, 8], [True, True, True, False, True, True, True])], "t long, f boolean")
    marked = {r.t: r.in_long_run for r in S.long_runs(flags, [], "f", 2).collect()}
    assert marked == {1: True, 2: True, 3: True, 4: False, 6: True, 7: True, 8: True}
    assert not any(r.in_long_run for r in S.long_runs(flags, [], "f", 3).collect())


def test_windows_keep_to_split_and_block(spark):
    rows = [(t, float(t % 5)) for t in range(0, 100) if t != 50]
    df = ts(spark, rows, "t long, mm double")
    split = F.when(F.col("t") < 70, "train").otherwise("test")
    got = S.window_starts(df, [], "mm", 8, 4, 2, 20.0, split).collect()
    for r in got:
        steps = range(r.t - 4, r.t + 8)
        assert 50 not in steps and r.t % 2 == 0 and r.t >= 4 and r.t + 7 < 100
        assert (r.t + 7 < 70) == (r.split == "train") and not r.t < 70 <= r.t + 7
        assert r.total == sum(t % 5 for t in range(r.t, r.t + 8)) and r.is_wet == (r.total >= 20)
    assert {r.t for r in got} == {t for t in range(4, 93, 2) if 50 not in range(t - 4, t + 8) and not t < 70 <= t + 7}


def test_separated_top(spark):
    df = ts(spark, [(0, 9.0), (2, 8.0), (10, 7.0), (12, 0.0), (30, 0.0)], "t long, total double")
    assert [r.t for r in S.separated_top(df, 5, 5)] == [0, 10]


def test_priority_merge_and_guard(spark):
    a = ts(spark, [(1, 1.0), (2, 2.0)], "t long, mm double")
    b = ts(spark, [(2, 9.0), (3, 3.0)], "t long, mm double")
    assert {r.t: r.mm for r in S.merge_by_priority([a, b], []).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}
    guard = S.shrink_problem(a.withColumn("is_imputed", F.lit(False)), b.withColumn("is_imputed", F.lit(True)), []).first()
    assert (guard.lost_steps, guard.lost_observations) == (1, 2)


def test_tiles_padding_and_chunks(spark):
    df = ts(spark, [(t, 1.0) for t in range(10, 34)], "t long, mm double")
    got = S.tiles(df, 10, 12, 4).collect()
    assert sum(r.is_scored for r in got) == 24 and {r.t for r in got if r.tile == 1} == set(range(18, 34))
    assert S.dry_padding(df, 8, 35, "mm").count() == 28
    assert [(r.first_day, r.last_day) for r in S.date_chunks(1, 10, 4, spark).orderBy("first_day").collect()] == [(1, 4), (5, 8), (9, 10)]
    assert [r.mm for r in S.fixed_block_max(df.withColumn("mm", F.col("t").cast("double")), [], "mm", 10).orderBy("block").collect()] == [19, 29, 33]
