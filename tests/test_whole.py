"""Pushed areas, digests, interval lookups, draws, clips, drains, rasters, datasets and streams against plain versions."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.operators import contributing, draws, features, signatures, spatial
from pluvion.operators import series as S
from pluvion.sources import datasets
from pluvion.streaming import readings

# areas pushed downhill


def test_areas_of_a_random_graph_and_a_chain(spark):
    rng = np.random.default_rng(1)
    n = 20
    routing = np.triu(rng.random((n, n)) < 0.12, 1) * rng.random((n, n))
    routing[:8, :8] = np.diag(np.full(7, 0.9), 1)  # a chain of eight: longer than a job's layers
    shares = spark.createDataFrame([(int(u), int(v), float(routing[u, v])) for u, v in np.argwhere(routing > 0)], "u long, v long, share double")
    area = rng.uniform(1, 5, n)
    areas = spark.createDataFrame([(i, float(a)) for i, a in enumerate(area)], "node_id long, area double")
    got = {r.i: r.area for r in contributing.contributing_areas(shares, areas).collect()}
    assert got == {i: pytest.approx(v) for i, v in enumerate(np.linalg.inv(np.eye(n) - routing.T) @ area)}


def test_areas_refuse_circles_and_unknown_nodes(spark):
    areas = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, None)], "node_id long, area double")
    make = lambda rows: spark.createDataFrame(rows, "u long, v long, share double")
    with pytest.raises(RuntimeError):
        contributing.contributing_areas(make([(2, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5)]), areas)
    with pytest.raises(ValueError):
        contributing.contributing_areas(make([(0, 7, 1.0)]), areas)
    got = {r.i: (r.area, r.layer) for r in contributing.contributing_areas(make([(0, 2, 0.25), (0, 2, 0.25)]), areas).collect()}
    assert got == {0: (1.0, 0), 1: (1.0, 0), 2: (0.5, 1)}


# digests


def test_fingerprints_see_content_only(spark):
    rows = [(k, t, float(t % 7) * k, "a" if t % 3 else None) for k in (1, 2) for t in range(-30, 2000, 3)]
    schema = "k long, t long, mm double, source string"

    def prints(data):
        return {r.k: r.fingerprint for r in signatures.series_fingerprint(data, ["k"], "mm", "source").collect()}

    base = prints(spark.createDataFrame(rows, schema).repartition(7))
    assert base == prints(spark.createDataFrame(rows[::-1], schema).coalesce(1))
    tiny = [(k, t, -0.0 if v == 0 else v + 1e-9, s) for k, t, v, s in rows]
    assert prints(spark.createDataFrame(tiny, schema)) == base
    changes = [[(1, -30, 6.0, None), *rows[1:]], [(1, -29, rows[0][2], rows[0][3]), *rows[1:]], [(*rows[0][:3], "b"), *rows[1:]], rows[1:], [rows[0], *rows]]
    for changed in changes:
        other = prints(spark.createDataFrame(changed, schema))
        assert other[2] == base[2] and other[1] != base[1]
    assert prints(spark.createDataFrame([], schema)) == {}


def test_which_signature_moves(spark):
    nodes = [(i, 0.5 * i, float(i * i % 11)) for i in range(60)]
    edges = [(i, (i * 7 + 1) % 60, 10.0 + i) for i in range(60)]

    def of(n, e, parts=3):
        a = spark.createDataFrame(n, "node_id long, lon double, z double").repartition(parts)
        b = spark.createDataFrame(e, "u long, v long, length double").repartition(parts)
        return tuple(signatures.graph_signatures(a, b, ["z", "lon"], ["length"], bucket=8, fan=2).first())

    base = of(nodes, edges)
    assert base[:2] == (60, 60) and of(nodes[::-1], edges[::-1], 1) == base
    value = of([(0, 0.0, 3.0), *nodes[1:]], edges)
    assert value[2] == base[2] and value[3] != base[3]
    longer = of(nodes, [*edges[:-1], (59, edges[-1][1], 99.0)])
    assert longer[2] == base[2] and longer[3] != base[3]
    less = of(nodes, edges[1:])
    assert less[2] != base[2] and less[3] != base[3]


# lookups and draws


def test_blocks_holding_stamps(spark):
    rng = np.random.default_rng(2)
    record = {(k, int(t)) for k in (1, 2) for t in rng.choice(900, 500, replace=False)} | {(3, t) for t in range(2000)}
    asked = [(i, int(rng.integers(1, 6)), None if i % 50 == 0 else int(rng.integers(-40, 2100))) for i in range(600)]
    requests = spark.createDataFrame(asked, "first_id long, k long, t long")
    got = S.blocks_holding(requests, spark.createDataFrame(sorted(record), "k long, t long"), ["k"], width=37)
    seen = {r.first_id: (r.first_t, r.last_t, r.place) for r in got.collect()}
    for i, k, t in asked:
        own = sorted(x for q, x in record if q == k)
        if (k, t) in record:
            a = b = t
            while (k, a - 1) in record:
                a -= 1
            while (k, b + 1) in record:
                b += 1
            assert seen[i] == (a, b, "block")
        else:
            assert seen[i] == (None, None, "gap" if own and t is not None and own[0] < t < own[-1] else "outside")
    assert len(seen) == 600


def test_exact_draws(spark):
    weights = [0, 50, 1, None, 3, 0, 1000, 1]
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(weights)], "t long, weight long, row string")
    drawn = {r.t: r.copies for r in draws.exact_draws(df.repartition(3), "t", F.col("weight"), 4000, 5, buckets=7).collect()}
    assert sum(drawn.values()) == 4000 and not {0, 3, 5} & set(drawn)
    assert drawn[6] == pytest.approx(4000 * 1000 / 1055, rel=0.02) and drawn[1] == pytest.approx(4000 * 50 / 1055, rel=0.25)
    assert draws.exact_draws(df, "t", F.col("weight"), 0, 5).count() == 0
    with pytest.raises(ValueError):
        draws.exact_draws(df.where("weight = 0"), "t", F.col("weight"), 1, 5)


# clips and places


def test_scaled_clip_has_mean_one(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.gamma(0.4, 2, 200), 1: [5.0], 2: [0.0, 0.0], 3: [0.0] * 9 + [4.0], 4: [1.0, 1.0, 1.0, 90.0], 5: rng.gamma(5, 1, 50)}
    rows = [(k, i, float(x)) for k, xs in groups.items() for i, x in enumerate(xs)] + [(5, 99, None), (4, 98, -3.0)]
    got = features.scaled_clip(spark.createDataFrame(rows, "k long, i long, x double"), "k", "x", 0.25, 3.0).collect()
    by = {k: {r.i: r.x for r in got if r.k == k} for k in groups}
    for k in (0, 1, 4, 5):
        v = np.array(list(by[k].values()))
        assert v.mean() == pytest.approx(1.0) and v.min() >= 0.25 and v.max() <= 3.0
    assert set(by[2].values()) == {1.0} and sorted(by[3].values()) == [0.25] * 9 + [3.0]  # one cannot be reached
    # rescaling and clipping in turn, twelve times, comes near the same mean only
    x = np.array(groups[0])
    for _ in range(12):
        x = np.clip(x / x.mean(), 0.25, 3.0)
    assert abs(np.array(list(by[0].values())).mean() - 1) <= abs(x.mean() - 1) + 1e-9


def test_nearest_line_or_area(spark):
    rng = np.random.default_rng(4)
    ends = np.round(rng.uniform(-500, 500, (12, 4)), 1)
    ends[0, 2:], ends[1, 2], ends[2, 3] = ends[0, :2], ends[1, 0], ends[2, 1]  # a point, an upright and a level line
    outlines = [[(0.0, 0.0), (160.0, 10.0), (150.0, 140.0), (70.0, 60.0), (10.0, 150.0)], [(-400.0, -400.0), (-250.0, -420.0), (-300.0, -250.0)]]
    sides = [(k, *a, *b) for k, ring in enumerate(outlines) for a, b in zip(ring, ring[1:] + ring[:1])]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-600, 600, (150, 2)))]
    got = spatial.nearest_segment(
        spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(ends.tolist(), "x1 double, y1 double, x2 double, y2 double"), 60.0,
        spark.createDataFrame(sides, "ring long, x1 double, y1 double, x2 double, y2 double"),
    )
    seen = {r.id: r.d for r in got.collect()}
    for i, x, y in points:
        best = 60.0
        for x1, y1, x2, y2 in [*ends.tolist(), *[s[1:] for s in sides]]:
            span = (x2 - x1) ** 2 + (y2 - y1) ** 2
            f = 0.0 if span == 0 else min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / span, 0), 1)
            best = min(best, np.hypot(x - x1 - f * (x2 - x1), y - y1 - f * (y2 - y1)))
        for k in range(2):
            crossed = sum((b1 > y) != (b2 > y) and x < (a2 - a1) * (y - b1) / (b2 - b1) + a1 for q, a1, b1, a2, b2 in sides if q == k)
            best = 0.0 if crossed % 2 else best
        assert seen[i] == pytest.approx(best, abs=1e-6)
    long = spark.createDataFrame([(0.0, 0.0, 6000.0, 6000.0)], "x1 double, y1 double, x2 double, y2 double")
    assert spatial.walked_cells(long, 60.0).count() < 1200  # its bounding box has over 10,000 cells


def test_bilinear_weights_of_absent_pixels(spark):
    pixels = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(0, 5, 5, None)], "tile int, row long, col long, elev double")
    places = spark.createDataFrame([(0, 0, 0.25, 0.5), (1, 0, 0.5, 0.5), (2, 0, 1.0, 1.0), (3, 0, 2.0, 2.0), (4, 9, 0.0, 0.0), (5, 0, 5.0, 5.0)], "id long, tile int, r double, c double")
    got = {r.id: r.elev for r in spatial.bilinear(places, pixels).collect()}
    first = (0.375 * 0 + 0.375 * 1 + 0.125 * 10) / 0.875
    assert got == {0: pytest.approx(first), 1: pytest.approx(11 / 3), 2: None, 3: 22.0, 4: None, 5: None}


# datasets


def test_committed_datasets_are_verified(spark, tmp_path):
    rows = spark.createDataFrame([(s, w, i, float(i)) for s in ("train", "val") for w in (1, 2) for i in range(50)], "split string, start long, step long, x double")
    base = str(tmp_path)
    listed = datasets.commit(rows, base, "one", rows.groupBy("split").agg(F.avg("x").alias("mean")), most_rows=40).collect()
    assert sum(r.rows for r in listed) == 200 and len(listed) > 4 and {r.statistics for r in listed} == {'{"mean":24.5}'}
    back = datasets.read(spark, base, "one", ["x"], ["start"], "step")
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(datasets.NotCommitted, match="lacks"):
        datasets.read(spark, base, "one", ["y"])
    with pytest.raises(datasets.NotCommitted, match="contiguous"):
        datasets.read(spark, base, "one", [], [], "step")
    with pytest.raises(datasets.NotCommitted, match="not committed"):
        datasets.read(spark, base, "two")
    with pytest.raises(ValueError):
        datasets.commit(rows.withColumn("split", F.lit(None).cast("string")), base, "three")
    victim = sorted(glob.glob(f"{base}/build=one/rows/split=val/*.parquet"))[0]
    data = bytearray(open(victim, "rb").read())
    data[len(data) // 2] ^= 1
    with open(victim, "wb") as f:
        f.write(data)
    for crc in glob.glob(f"{base}/build=one/rows/split=val/.*.crc"):
        open(crc, "wb").close()
        __import__("os").unlink(crc)
    assert [r.why for r in datasets.verify(spark, base, "one").collect()] == ["content"]
    with pytest.raises(datasets.NotCommitted, match="content"):
        datasets.read(spark, base, "one")


# streams


def test_forecasts_settle_and_late_rows_go(spark, tmp_path):
    stamp = lambda h, m=0: F.expr(f"timestamp'2024-05-01 00:00:00' + make_interval(0, 0, 0, 0, {h}, {m}, 0)")
    one = spark.range(1)

    def put(kind, turn, rows):
        for k, (station, hour, minute, value) in enumerate(rows):
            row = one.select(F.lit(station).alias("station"), stamp(hour, minute).alias("ts"), F.lit(float(value)).alias("v"))
            row.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}/{turn}-{k}")

    def streams():
        f = spark.readStream.schema("station int, ts timestamp, v double").parquet(f"{tmp_path}/f/*")
        o = spark.readStream.schema("station int, ts timestamp, v double").parquet(f"{tmp_path}/o/*")
        f = f.select("station", F.col("ts").alias("valid_ts"), F.lit(24).alias("lead_h"), F.col("v").alias("forecast"))
        return readings.settled_forecasts(f, o.select("station", "ts", F.col("v").alias("mm")))

    def run():
        q = streams().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.station, r.forecast, r.observed) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("f", 0, [(1, 5, 0, 10), (1, 6, 0, 11), (2, 5, 0, 12), (1, 20, 0, 13)])
    put("o", 0, [(1, 5, 30, 7), (1, 5, 59, 8), (1, 7, 0, 9), (1, 21, 0, 1)])
    assert run() == [(1, 10.0, 7.0), (1, 10.0, 8.0), (1, 11.0, None), (2, 12.0, None)]
    put("o", 1, [(2, 5, 10, 6), (1, 20, 15, 2)])  # the first is later than the watermark
    assert run() == [(1, 10.0, 7.0), (1, 10.0, 8.0), (1, 11.0, None), (1, 13.0, 2.0), (2, 12.0, None)]
