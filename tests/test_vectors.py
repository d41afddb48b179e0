"""Operators on small fixed inputs with results known by hand or by brute force."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.config import Base, Config
from driftline.functions import geo
from driftline.operators import behaviour, density, guards, kinematics, matching, perception, proximity, reports, rules


def track(spark, points, step=300.0, number=1):
    return spark.createDataFrame([(number, i, i * step, float(e), float(n)) for i, (e, n) in enumerate(points)], "track_id long, fix_no long, t_s double, e_m double, n_m double")


def test_metres_per_degree(spark):
    row = spark.range(1).select(*geo.m_per_deg(F.lit(39.92184))).first()
    assert row[0] == pytest.approx(111033.1, abs=0.5) and row[1] == pytest.approx(85491.2, abs=0.5)


@pytest.mark.parametrize("text", ["9:05", "0905", "25:00", "09:60", "", "noon"])
def test_times_refused(spark, text):
    assert spark.range(1).select(guards.minute_of(F.lit(text))).first()[0] is None


def zone(spark, e, n, ve, vn, k=0, radius=250.0, buffer=750.0):
    return proximity.assessed(spark.createDataFrame([(float(e), float(n), float(ve), float(vn), 0.0, 0.0, radius, buffer, k)], "e_m double, n_m double, ve double, vn double, zone_e double, zone_n double, radius_m double, buffer_m double, closing_steps int")).first()


def test_straight_in(spark):
    r = zone(spark, 0, -1000, 0, 5, 3)
    assert (r.dist_m, r.eta_s, r.cpa_m, r.closing_mps, r.inside, r.in_buffer) == (1000, 150, 0, 5, False, True) and r.conf > 0.9


def test_straight_out(spark):
    r = zone(spark, 0, -2000, 0, -5)
    assert r.eta_s is None and r.closing_mps < 0 and r.conf < 0.3


def test_inside_and_still(spark):
    assert zone(spark, 100, 0, 1, 0).eta_s == 0
    r = zone(spark, 0, -1000, 0, 0)
    assert r.cpa_m == 1000 and r.eta_s is None


def test_suppression(spark):
    boxes = spark.createDataFrame([(1, 0, "car", 0.9, 100.0, 100.0, 40.0, 40.0), (1, 1, "car", 0.85, 101.0, 101.0, 40.0, 40.0), (1, 2, "car", 0.8, 500.0, 500.0, 40.0, 40.0)], "image_id long, idx long, cls string, score double, x double, y double, w double, h double")
    assert {r.idx: r.suppressed_by for r in perception.suppress(boxes).collect()} == {0: None, 1: 0, 2: None}


def greedy(boxes, threshold):
    kept, gone = [], {}
    for b in sorted(boxes, key=lambda b: (-b[2], b[1])):
        def iou(a):
            w = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
            h = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
            return w * h / (a[5] * a[6] + b[5] * b[6] - w * h)
        by = next((a[1] for a in kept if iou(a) >= threshold), None)
        gone[b[0], b[1]] = by
        if by is None:
            kept.append(b)
    return gone


def test_suppression_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(im, i, float(rng.integers(1, 20)) / 20, float(rng.integers(0, 12) * 9), float(rng.integers(0, 12) * 9), 30.0, 30.0) for im in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id long, idx long, score double, x double, y double, w double, h double")
    want = {}
    for im in range(4):
        want |= greedy([r for r in rows if r[0] == im], 0.5)
    assert {(r.image_id, r.idx): r.suppressed_by for r in perception.suppress(df).collect()} == want


def test_detections_read_their_boxes_once(spark):
    """Boxes pass through the suppression whole: what fell is not looked up again; a box without a score is dropped for it."""
    from driftline.operators import perception

    df = spark.createDataFrame([(1, 0, "car", 0.9, 0.0, 0.0, 9.0, 9.0), (1, 1, "van", 0.8, 0.0, 0.0, 9.0, 9.0), (1, 2, "van", 0.1, 0.0, 0.0, 9.0, 9.0), (1, 3, "bus", None, 0.0, 0.0, 9.0, 9.0), (2, 0, "bus", 0.9, 0.0, 0.0, 0.1, 0.1)], "image_id long, idx long, cls string, score double, x double, y double, w double, h double")
    size = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], "image_id long, gsd_x double, gsd_y double")
    rows = perception.detections(df, size)
    assert {(r.image_id, r.idx): (r.drop_reason, r.suppressed_by) for r in rows.collect()} == {(1, 0): (None, None), (1, 1): ("nms", 0), (1, 2): ("score", None), (1, 3): ("score", None), (2, 0): ("area", None)}
    assert {(r.idx, r.drop_reason) for r in perception.detections(df, size, per_class=True).filter("image_id = 1").collect()} == {(0, None), (1, None), (2, "score"), (3, "score")}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.5, 1.0])
def test_suppression_of_many_frames_at_once(monkeypatch, threshold):
    """Frames judged together fall as each does alone, with boxes without area or of negative size, and whether pairs are many or few."""
    from driftline.operators import perception

    rng = np.random.default_rng(5)
    group = np.sort(np.concatenate([rng.integers(0, 40, 900), np.full(200, 40)]))
    x, y, w, h = (rng.integers(lo, hi, len(group)).astype(float) for lo, hi in ((0, 60), (0, 40), (-1, 25), (0, 25)))
    want = np.concatenate([np.where((f := perception.greedy(x[g], y[g], w[g], h[g], threshold)) < 0, -1, f + g[0]) for g in (np.flatnonzero(group == k) for k in np.unique(group))])
    for pairs in (1 << 20, 700, 1):
        monkeypatch.setattr(perception, "PAIRS", pairs)
        assert (perception.fallen(group, x, y, w, h, threshold) == want).all()


def test_frames_longer_than_a_batch(spark):
    """A frame that runs over several batches is judged as one, and so are small ones around it."""
    from driftline.operators import perception

    rng = np.random.default_rng(6)
    rows = [(im, k, float(s), float(a), float(b), 9.0, 9.0) for im, n in ((1, 3), (2, 90), (3, 1), (4, 40), (5, 30)) for k, (s, a, b) in enumerate(zip(rng.random(n), rng.integers(0, 30, n), rng.integers(0, 30, n), strict=True))]
    df = spark.createDataFrame(rows, "image_id long, idx long, score double, x double, y double, w double, h double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        want = {tuple(r) for r in perception.suppress(df, 0.3).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        assert {tuple(r) for r in perception.suppress(df, 0.3).collect()} == want and len(want) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_funnel_counts_the_whole_table(spark):
    from compare import DATA

    from driftline.plans import scenes

    items = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") * 10 >= 0.35).alias("passed"))
    got = {r.image_id: (r.raw, r.after_score) for r in scenes.det_funnel(spark, f"{DATA}/sf0.001").collect()}
    assert got == {r.l_suppkey: (r.n, r.passed) for r in items.collect()}


def test_predictions(spark):
    rows = spark.createDataFrame([(1, "car 0.9 1 2 3 4 truck 0.8 5"), (2, "car 0.9 1 2 3 4"), (3, "boat 0.9 1 2 3 4"), (4, "car 1.5 1 2 3 4"), (5, "")], "image_id long, prediction string")
    got = {r.image_id: (r.fault.rule, r.fault.group) if r.fault else len(r.boxes) for r in perception.parse_predictions(rows).collect()}
    assert got == {1: ("token_count", 1), 2: 1, 3: ("class", 0), 4: ("score_range", 0), 5: 0}


def test_straight_run(spark):
    f = track(spark, [(0, 9000 - 300 * k) for k in range(25)])
    a, s = behaviour.approach(f).first(), behaviour.sweep(f).first()
    assert (a.closing_30, a.closing_60, a.closing_120, a.heading_cos, s.sweep_deg) == (1800, 3600, 7200, pytest.approx(1), pytest.approx(0))
    assert behaviour.stop_spells(f, 25).count() == 0


def test_circle(spark):
    f = track(spark, [(1600 * np.sin(np.radians(10 * k)), 1600 * np.cos(np.radians(10 * k))) for k in range(25)])
    assert behaviour.sweep(f).first().sweep_deg == pytest.approx(240) and behaviour.closest(f).first().range_spread == pytest.approx(0)


def test_jitter_is_one_stop(spark):
    f = track(spark, [(0, 1600 + 5 * (-1) ** k) for k in range(25)])
    r = behaviour.loiter(behaviour.stop_spells(f, 25), 3000).first()
    assert (r.stop_spells, r.loiter_min) == (1, 120) and behaviour.approach(f).first().heading_cos is None


def spells(points, still):
    out, start = [], 0
    while start < len(points) - 1:
        end = start
        for i in range(start + 1, len(points)):
            if np.hypot(points[i][0] - points[start][0], points[i][1] - points[start][1]) > still:
                break
            end = i
        if end - start >= 2:
            out.append((start * 300.0, end * 300.0))
            start = end
        else:
            start += 1
    return out


def test_stops_by_brute_force(spark):
    rng = np.random.default_rng(5)
    tracks = {k: [tuple(p) for p in np.cumsum(rng.normal(0, 12, (60, 2)), axis=0).tolist()] for k in range(12)}
    df = track(spark, tracks[0], number=0)
    for k in range(1, 12):
        df = df.unionByName(track(spark, tracks[k], number=k))
    got = {k: [] for k in tracks}
    for r in behaviour.stop_spells(df, 25).collect():
        got[r.track_id].append((r.start_s, r.end_s))
    assert {k: sorted(v) for k, v in got.items()} == {k: spells(v, 25) for k, v in tracks.items()}


def test_profiles(spark):
    p = kinematics.profile(track(spark, [(0, 3000 * k) for k in range(5)])).first()
    assert (p.n_steps, p.speed_mean, p.speed_max, p.moving_fraction, p.total_m) == (4, 10, 10, 1, 12000)
    back = kinematics.profile(track(spark, [(0, 0), (0, 1000), (0, 2000), (0, 1000), (0, 0)])).first()
    assert back.reversals == 1


def test_waited_then_moved(spark):
    f = track(spark, [(0, 0)] * 21 + [(6000, 0), (12000, 0)])
    assert "waited_then_moved" in kinematics.profile(f).select(kinematics.flags()).first()[0]


def test_later_fixes_change_nothing(spark):
    f = track(spark, [(100 * k, 50 * k) for k in range(20)])
    more = f.unionByName(track(spark, [(9e3, 9e3)]).withColumn("t_s", F.lit(1e6)))
    assert kinematics.state(kinematics.as_of(more, 1e5)).first() == kinematics.state(f).first()


def test_downgrades_wait():
    state, out = None, []
    for p in (1, 2, 0, 0):
        state = rules.steady(state, p, 2)
        out.append(state[0])
    assert out == [1, 2, 2, 0]


def test_another_lower_level_starts_anew():
    state, out = None, []
    for p in (2, 0, 1, 0, 0):
        state = rules.steady(state, p, 2)
        out.append(state[0])
    assert out == [2, 2, 2, 2, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 30, (n, m)).astype(float)
    got = matching.assign(cost)
    total = sum(cost[i, j] for i, j in enumerate(got) if j >= 0)
    small, large = (cost, m) if n <= m else (cost.T, n)
    assert (got >= 0).sum() == min(n, m) and len(set(got[got >= 0])) == min(n, m)
    assert total == min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))


def test_matching_takes_most_pairs_first(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 28.0, 0.0)], "image_id long, track_id long, e_m double, n_m double")
    d = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 8, -20.0, 0.0)], "image_id long, det_id long, e_m double, n_m double")
    assert {(r.det_id, r.track_id) for r in matching.exclusive(matching.pairs(d, t, 30)).collect()} == {(7, 2), (8, 1)}


def test_reports(spark):
    zones = spark.createDataFrame([("Z01", 0, "Kuzey Kapisi"), ("Z02", 1, "Kuzey Kapisi Yolu")], "zone_id string, zone_no int, name string")
    said = {
        "a": "39.925 N, 32.871 E konumunda 3 araclik bir kamyon konvoyu ilerliyor.", "b": "Kuzey Kapısı Yolu bolgesinde trafik akisi normal.", "c": None,
        "d": "39.9 S, 32.8 W konumundaki otomobilin usse dogru ilerleyen hali", "e": "39.9 N, 32.8 E cevresinde genellikle 5 arac olur", "f": "39.9 N, 32.8 E konumunda kamyonlar bekliyor",
    }
    got = {r.k: r for r in reports.parse(spark.createDataFrame(list(said.items()), "k string, text string"), zones).collect()}
    assert (got["a"].kind, got["a"].count_ if hasattr(got["a"], "count_") else got["a"]["count"], got["a"].vehicle_type, got["a"].motion) == ("sighting", 3, "truck", "moving")
    assert (got["b"].kind, got["b"].zone_id) == ("zone_status", "Z02")
    assert got["c"].kind == "irrelevant" and got["c"].lat is None
    assert (got["d"].lat, got["d"].lon, got["d"].motion) == (-39.9, -32.8, "toward_base")
    assert (got["e"].kind, got["e"].usual_count) == ("density", 5)
    assert got["f"]["count"] is None and got["f"].motion == "stopped"


def test_frames_of_a_report_follow_each_other(spark):
    """By brute force at the edges of slices too; and the rows of one report come in long runs, which files hold short."""
    rng = np.random.default_rng(3)
    t = np.concatenate([np.arange(0, 30_000, 900.0), np.arange(450, 30_000, 900.0), rng.integers(0, 30_000, 134) * 1.0, np.nextafter(np.arange(0, 30_000, 900.0), -1), np.nextafter(np.arange(0, 30_000, 900.0), 1e9)])
    c = np.concatenate([np.repeat(np.arange(0, 28_800, 60.0), 10), np.nextafter(np.arange(0, 28_800, 900.0), -1)])
    said = spark.createDataFrame([(i, float(x), None, "unknown", False, None, None) for i, x in enumerate(t)], "report_id long, t_s double, zone_id string, kind string, located boolean, e_m double, n_m double")
    seen = spark.createDataFrame([(i, float(x), "Z01", -60.0, 60.0, -50.0, 50.0) for i, x in enumerate(c)], "image_id long, capture_s double, zone_id string, west double, east double, south double, north double")
    rows = reports.relevant(said, seen).toArrow()
    image, report = rows["image_id"].to_numpy(), rows["report_id"].to_numpy()
    want = (t[None, :] <= c[:, None]) & (t[None, :] >= c[:, None] - 7200)
    got = np.zeros_like(want)
    got[image, report] = True
    assert len(image) == want.sum() and (got == want).all()
    assert len(report) > 50 * (1 + np.count_nonzero(np.diff(report)))


def test_config_is_checked():
    with pytest.raises(ValueError, match="nest"):
        Config(base=Base(critical_m=5000))
    assert Config().version("base") != Config().version("threat")


def test_breakdown_sums_to_the_score(spark):
    rows = spark.createDataFrame([(0.335, 0.115, 0.114, 0.106), (0.5, 0.125, 0.125, 0.25)], "s double, a double, b double, c double")
    for s, parts in rows.select("s", rules.breakdown(F.col("s"), [F.col("a"), F.col("b"), F.col("c")])).collect():
        assert sum(parts) == int(np.floor(s * 100 + 0.5))


def test_reports_of_a_frame(spark):
    """Coordinates come before a zone's name and are held to the footprint; an irrelevant report counts only by its place."""
    from driftline.operators import reports

    rows = [
        (1, 100.0, "Z01", "sighting", True, 200.0, 0.0), (2, 100.0, "Z01", "sighting", True, 300.0, 0.0), (3, 100.0, "Z02", "sighting", True, 0.0, 0.0), (4, 100.0, "Z01", "sighting", False, None, None),
        (5, 100.0, "Z02", "sighting", False, None, None), (6, 100.0, None, "irrelevant", False, None, None), (7, 100.0, None, "irrelevant", True, 0.0, 0.0), (8, 100.0, None, "unknown", False, None, None), (9, 9000.0, None, "unknown", False, None, None),
    ]
    r = spark.createDataFrame(rows, "report_id long, t_s double, zone_id string, kind string, located boolean, e_m double, n_m double")
    f = spark.createDataFrame([(1, 7300.0, "Z01", -60.0, 60.0, -50.0, 50.0)], "image_id long, capture_s double, zone_id string, west double, east double, south double, north double")
    assert {x.report_id for x in reports.relevant(r, f).collect()} == {1, 3, 4, 7, 8}


def test_reports_and_frames_that_only_share_their_hours_do_not_meet(spark):
    """Joins are by place, and what is equal is compared once: forty copies of a report and of a frame make one joined row, and all their pairs."""
    r = spark.createDataFrame([(k, 100.0, z, "sighting", e is not None, e, e) for k, (z, e) in enumerate([("Z01", None), ("Z02", None), (None, 5.0), (None, 9e4), (None, None)] * 40)], "report_id long, t_s double, zone_id string, kind string, located boolean, e_m double, n_m double")
    f = spark.createDataFrame([(k, 600.0, "Z01", -10.0, 10.0, -10.0, 10.0) for k in range(40)], "image_id long, capture_s double, zone_id string, west double, east double, south double, north double")
    found = reports.relevant(r, f)
    got = found.collect()
    assert len(got) == len({tuple(x) for x in got}) == 3 * 40 * 40 and {x.report_id % 5 for x in got} == {0, 2, 4}
    keys = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(keys) == 3 and any("zone_id" in k for k in keys) and any("cx" in k and "cy" in k for k in keys)


def test_levels_and_their_filters(spark):
    from pyspark.sql import functions as F

    from driftline.operators import views

    rows = spark.createDataFrame([(None,), (0,), (1,), (2,)], "level_rank int")
    for wanted, want in {"all": {None, 0, 1, 2}, "judged": {0, 1, 2}, "unassessed": {None}, "ALERT": {2}, "CLEAR": {0}}.items():
        assert {r.level_rank for r in rows.filter(views.passes(F.col("level_rank"), F.lit(wanted))).collect()} == want


def test_a_lone_sector_is_the_circle(spark):
    from driftline.operators import views

    zones = spark.createDataFrame([("Z01", 0, 0.0, 100.0, 10.0, 20.0)], "zone_id string, zone_no int, zone_e double, zone_n double, radius_m double, buffer_m double")
    assert [tuple(r) for r in views.sectors(zones).collect()] == [("Z01", 0.0, 360.0, 130.0)]
    two = zones.unionByName(zones.selectExpr("'Z02' zone_id", "1 zone_no", "100e0 zone_e", "0e0 zone_n", "radius_m", "buffer_m"))
    assert {r.zone_id: (r.from_deg, r.to_deg) for r in views.sectors(two).collect()} == {"Z01": (225.0, 405.0), "Z02": (45.0, 225.0)}


def test_headlines_of_tracks_that_enter_no_zone(spark):
    from driftline.operators import activity

    rows = [(t, i, 600.0 * i, e, 0.0) for t, es in {1: [9000, 9000, 9000, 9000, 9000], 2: [9000, 8000, 7000, 6000, 5000], 3: [5000, 6000, 7000, 8000, 9000], 4: [9000, 8000, 7000, 8000, 9000], 5: [5000, 4000, 2200, 4000, 5000], 6: [5000, 4000, 1000, 4000, 5000], 7: [9000]}.items() for i, e in enumerate(map(float, es))]
    fixes = spark.createDataFrame(rows, "track_id long, fix_no long, t_s double, e_m double, n_m double")
    zones = spark.createDataFrame([("Z01", 1, "near", 1000.0, 0.0, 250.0, 1000.0)], "zone_id string, zone_no long, name string, zone_e double, zone_n double, radius_m double, buffer_m double")
    points = activity.route(fixes, 3000.0)
    got = {x.track_id: (x.kind, x.name, round(x.value, 3)) for x in activity.headline(activity.summary(points, 25.0), activity.passes(points, zones)).collect()}
    assert got == {1: ("parked", None, 40.0), 2: ("approaching", None, 4000.0), 3: ("receding", None, 4000.0), 4: ("roaming", None, 4000.0), 5: ("buffer", "near", 19.722), 6: ("zone", "near", 19.167), 7: ("roaming", None, 0.0)}


def test_route_ends_between_fixes_at_the_clock(spark):
    from driftline.operators import activity

    fixes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 600.0, 600.0, 0.0), (2, 2, 900.0, 1.0, 1.0), (3, 3, 0.0, 5.0, 0.0), (3, 4, 300.0, 5.0, 0.0)], "track_id long, fix_no long, t_s double, e_m double, n_m double")
    got = sorted((x.track_id, x.t_s, x.e_m, x.complete) for x in activity.route(fixes, 300.0).collect())
    assert got == [(1, 0.0, 0.0, False), (1, 300.0, 300.0, False), (3, 0.0, 5.0, True), (3, 300.0, 5.0, True)]


def test_recorded_decisions(spark):
    from driftline.operators import views

    alerts = spark.createDataFrame([(1, 10, "WATCH", 0.4), (1, 11, "ALERT", 0.9)], "image_id long, track_id long, level string, priority double")
    asked = spark.createDataFrame([(1, 1, None, "op", "x"), (2, 1, 10, "op", "x"), (3, 1, 99, "op", "x"), (4, 2, None, "op", "x"), (5, 1, None, " ", "x"), (6, 1, 10, "op", None)], "request_id long, image_id long, track_id long, operator string, note string")
    got = {x.request_id: (x.target_id, x.level, x.error) for x in views.recorded(asked, alerts).collect()}
    assert got == {1: (11, "ALERT", None), 2: (10, "WATCH", None), 3: (None, None, "no_alert"), 4: (None, None, "no_alert"), 5: (None, None, "no_operator_or_note"), 6: (None, None, "no_operator_or_note")}


def test_classes_come_from_the_exclusive_match(spark):
    """A track has the class of the detection that is its own, though another may be nearer, and none where it has no detection."""
    from compare import DATA

    from driftline.plans import relations, scenes, views

    sf = f"{DATA}/sf0.001"
    own = {r.track_id: r.det_id for r in scenes.match_exclusive(spark, sf).collect()}
    kinds = {r.det_id: (r.cls, r.score) for r in relations.scene_detections(spark, sf).collect()}
    got = {r.track_id: (r.det_id, r.cls, r.score) for r in views.join_class(spark, sf).collect()}
    assert len(set(own.values())) == len(own) > 3
    assert got == {r.track_id: (own[r.track_id], *kinds[own[r.track_id]]) if r.track_id in own else (None, None, None) for r in relations.scene_tracks(spark, sf).collect()}


def test_first_object_of_an_answer(spark):
    from driftline.operators import guards

    said = {
        '{"a": 1}': '{"a": 1}', 'so: {"a": {"b": "}"}} and {"c": 2}': '{"a": {"b": "}"}}', '```json\n{"x": "\\"}"}\n``` {"y": 1}': '{"x": "\\"}"}', "```\nno\n``` {\"y\": 1}": '{"y": 1}', '{bad} {"ok": true}': '{"ok": true}',
        '{"a": 1': None, "none": None, "": None, '"{" {"z": [{"q": 1}]}': '{"z": [{"q": 1}]}', '{"s": "\\\\"} x': '{"s": "\\\\"}', '{{"a": 1}}': '{"a": 1}', '[1, {"a": 2}]': None, '```[1]``` {"b": 1}': '{"b": 1}',
    }
    rows = spark.createDataFrame([(t,) for t in [*said, None]], "t string").select("t", guards.first_object(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == said | {None: None}


def test_what_is_left_of_the_match(spark):
    """Duplicates, untracked and unseen ones, and the untracked rows, each worked out by hand from the match."""
    import math

    from compare import DATA

    from driftline.plans import relations, scenes

    sf = f"{DATA}/sf0.001"
    d = {r.det_id: r for r in relations.scene_detections(spark, sf).collect()}
    t = {r.track_id: r for r in relations.scene_tracks(spark, sf).collect()}
    zones = relations.zones(spark, sf).collect()
    own = {r.det_id: r.track_id for r in scenes.match_exclusive(spark, sf).collect()}
    away = lambda a, b: math.hypot(a.e_m - b.e_m, a.n_m - b.n_m)
    near = lambda x, among: min(((away(x, t[k]), k) for k in among if t[k].image_id == x.image_id), default=None)
    copies = {}
    for k, x in d.items():
        if k not in own and (best := near(x, own.values())) and best[0] <= 12.0:
            copies[k] = best[1]
    assert {r.det_id: r.track_id for r in scenes.match_duplicates(spark, sf).collect()} == copies
    assert {r.det_id for r in scenes.match_untracked(spark, sf).collect()} == d.keys() - own.keys() - copies.keys()
    unseen = {k for k, x in t.items() if k not in own.values()}
    assert {r.track_id for r in scenes.match_not_seen(spark, sf).collect()} <= unseen
    bearing = lambda e, n: math.degrees(math.atan2(e, n)) % 360
    rows = {r.det_id: r for r in scenes.match_untracked_rows(spark, sf).collect()}
    assert rows.keys() == d.keys() - own.keys() and rows
    for k, r in rows.items():
        m, track = near(d[k], t) or (None, None)
        assert (r.nearest_track, r.duplicate_of, r.cls) == (track, copies.get(k), d[k].cls) and (m is None or abs(r.nearest_m - m) <= 0.006)
        gap = lambda z, k=k: abs(bearing(d[k].e_m, d[k].n_m) - bearing(z.zone_e, z.zone_n))
        told = min(zones, key=lambda z: (min(gap(z), 360 - gap(z)), z.zone_no)).zone_id if math.hypot(d[k].e_m, d[k].n_m) <= 100 else None
        assert r.sector == told


def test_nearest_fixes_are_found_in_one_pass_each_way(spark, capsys):
    fixes = track(spark, [(i, 0) for i in range(4)])
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate((-400.0, -100.0, 150.0, 151.0, 600.0, 1000.0, 1300.0))], "track_id long, key long, target_s double")
    found = behaviour.as_of_join(asked, fixes, 300.0, nearest=True)
    assert {r.key: r.fix and r.fix.fix_no for r in found.collect()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: None}
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()  # such a frame is gone through anew from every row


def test_what_is_near_is_looked_up_once_a_place(spark, monkeypatch):
    said = spark.createDataFrame([(i, 1, 0.0, float(i % 2) * 1000) for i in range(50)] + [(50, 1, None, None)], "report_id long, image_id long, e_m double, n_m double")
    seen = spark.createDataFrame([(1, 7, 30.0, 0.0, "van"), (1, 8, 100.0, 0.0, "car"), (2, 9, 0.0, 0.0, "bus")], "image_id long, det_id long, e_m double, n_m double, cls string")
    near = spark.createDataFrame([(1, k, 10.0 * (5 - k), 0.0) for k in range(1, 5)], "image_id long, track_id long, e_m double, n_m double")
    asked = []
    monkeypatch.setattr(reports, "pairs", lambda d, t, gate: asked.append(d.count()) or matching.pairs(d, t, gate))
    told = {r.report_id: (r.n_150, r.n_50, r.n_van, r.n_car, r.n_bus, r.tracks) for r in reports.around(said, seen, near).collect()}
    assert told == {i: (2, 1, 1, 0, 0, [4, 3, 2]) if i < 50 and i % 2 == 0 else (0, 0, 0, 0, 0, None) for i in range(51)}
    assert asked == [3, 3]  # the two places, and none


def test_density_of_many_in_few_places(spark):
    crowd = spark.range(100_000).select(F.lit(1).alias("clock"), "id", F.lit(2200.0).alias("e_m"), F.lit(0.0).alias("n_m"), F.lit(3).alias("weight"))
    lone = spark.createDataFrame([(1, 100_000, 0.0, 0.0, 1)], "clock int, id long, e_m double, n_m double, weight int")
    got = {r.id: r.density for r in density.field(crowd.unionByName(lone)).filter("id >= 99999").collect()}
    far = np.exp(-(2200**2) / (2 * 350**2))
    assert got[100_000] == pytest.approx(1 + 300_000 * far, abs=1e-9) and got[99_999] == pytest.approx(300_000 + far, abs=1e-6)


def test_density_by_brute_force(spark):
    """Of a crowd, a knot and a lone vehicle at two clocks: as all pairs give it. A vehicle without a place has no density, but a row."""
    rng = np.random.default_rng(5)
    rows = []
    for clock, n in ((1, 1500), (2, 20_000)):
        at = rng.normal(0, 1500, (n, 2))
        at[:300] = at[300] + rng.normal(0, 30, (300, 2))
        at[0] = 30_000, -20_000
        rows += [(clock, clock * 100_000 + i, float(e), float(n), int(w)) for i, ((e, n), w) in enumerate(zip(at, rng.integers(1, 4, n), strict=True))]
    vehicles = spark.createDataFrame([*rows, (2, 0, None, 1.0, 1)], "clock long, id long, e_m double, n_m double, weight int")
    got = {(r.clock, r.id): r.density for r in density.field(vehicles).collect()}
    assert len(got) == 21_501 and got.pop((2, 0)) is None
    for clock in (1, 2):
        ids, e, n, w = (np.array(x) for x in zip(*(r[1:] for r in rows if r[0] == clock), strict=True))
        some = np.arange(0, len(ids), 7)
        want = np.exp(-((e[some, None] - e) ** 2 + (n[some, None] - n) ** 2) / (2 * 350**2)) @ w
        assert np.allclose([got[clock, i] for i in ids[some]], want, rtol=1e-12, atol=1e-10)


def test_zones_as_near_in_bearing_are_told_by_number(spark):
    zones = spark.createDataFrame([(f"Z{k + 1:02d}", k, float(3200 * np.sin(np.radians(14.4 * k))), float(3200 * np.cos(np.radians(14.4 * k)))) for k in range(25)], "zone_id string, zone_no int, zone_e double, zone_n double")
    south = spark.createDataFrame([(k, 0.0, -80.0 * k) for k in range(1, 50)], "track_id long, e_m double, n_m double")
    turned = zones.withColumns({"zone_no": 24 - F.col("zone_no")})
    assert {r.zone_id for r in proximity.sector(south, zones).collect()} == {"Z13"} and {r.zone_id for r in proximity.sector(south, turned).collect()} == {"Z14"}


def test_a_half_circle_is_no_wrap(spark):
    rows = [(k * 20 + j, i, float(i), (k / 100 if i % 2 == 0 else -(k / 100) * (1 + i)) * 40, (j if i % 2 == 0 else -j * (1 + i)) * 80.0) for k in range(1, 200) for j in range(1, 20) for i in range(4)]
    fixes = spark.createDataFrame(rows, "track_id long, fix_no long, t_s double, e_m double, n_m double")
    assert {round(r.sweep_deg, 6) for r in behaviour.sweep(fixes).collect()} == {180.0}
