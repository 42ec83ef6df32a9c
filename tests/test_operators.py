"""Operators without SQL, and edges, against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from pulsegrid import catalog
from pulsegrid.operators import aggregates, features, filters, grids, interpolate, joins, ml, normalize, windows
from pulsegrid.plans import clinical_views, pipeline, series, severity
from pulsegrid.sources import files, generated, messages


def points(spark, rows):
    rows = [(a, float(t), None if v is None else float(v), i) for a, t, v, i in rows]
    return spark.createDataFrame(rows, "label string, t double, value double, seq long").select("label", F.timestamp_seconds("t").alias("ts"), "value", "seq")


def test_unit_vectors(spark):
    got = aggregates.window_stats(points(spark, [("aaa", 0.001, 1.0, 1), ("aaa", 0.002, 2.0, 2)]), "1 minute").first()
    assert (got.mean_v, got.stdev_v, got.min_v, got.max_v) == (1.5, 0.5, 1.0, 2.0)


def test_zscore_is_the_plain_loop(spark):
    r = np.random.default_rng(1)
    xs = [0.0, 0.0, 5.0, *r.normal(3, 2, 60)]
    got = normalize.online_zscore(points(spark, [("a", i, float(x), i) for i, x in enumerate(xs)])).orderBy("seq").collect()
    n, total, squares = 0, 0.0, 0.0
    for row, x in zip(got, xs, strict=True):
        n, total = n + 1, total + x
        m = total / n
        squares += (x - m) ** 2
        sd = math.sqrt(squares / n)
        want = (x - m) / sd if sd > 0 else x - m if m > 0 else 0.0
        assert abs(row.z - want) < 1e-9


def test_sliced_zscore_is_the_same(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(t), float(v), i) for i, (k, t, v) in enumerate(zip(r.choice(["a", "b"], 400), r.integers(0, 9000, 400), r.normal(5, 3, 400), strict=True))]
    p = points(spark, rows)
    a, b = ({x.seq: x.z for x in normalize.online_zscore(p, slice_seconds=s).collect()} for s in (None, 500))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_spline_goes_through_its_knots():
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, 2.0, 5.0])
    for a, b in zip(x, y, strict=True):
        assert abs(interpolate.natural_spline(x, y, a) - b) < 1e-9
    line = np.arange(6.0)
    assert abs(interpolate.natural_spline(line, 2 * line + 1, 2.3) - 5.6) < 1e-9
    assert interpolate.natural_spline(x[:2], y[:2], 0.5) == 0.0
    assert interpolate.natural_spline(x, y, 9.0) == 0.0


def test_interpolation_modes(spark):
    p = points(spark, [("a", 0, 10.0, 0), ("a", 240, 20.0, 1), ("a", 480, 30.0, 2)])
    value = lambda mode: interpolate.interpolate(p, "10 minutes", "10 minutes", 10, mode).first().value
    assert value("linear") == 20.0 + 10.0 * 60 / 240
    assert value("locf") == 20.0
    assert value("nocb") == 30.0
    assert interpolate.interpolate(p.where("false"), "10 minutes", "10 minutes", 10).count() == 0


def test_entropy_of_a_plain_loop():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, 40)
    tolerance, n = 0.3 * x.std(), 38
    c = [0, 0, 0]
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(2):
                if abs(x[i + k] - x[j + k]) > tolerance:
                    break
                c[k + 1] += 1
    assert features.multiscale_entropy(x, 0.3, 1, 2) == [(0, 0, -math.log(c[2] / c[1]))]
    assert math.isnan(features.multiscale_entropy(x[:1], 0.3, 1, 2)[0][2])


def test_sample_entropy_edges():
    assert features.sample_entropy(np.array([1.0, 2.0, 3.0]), 2, 0.1) == 0.0
    assert features.sample_entropy(np.array([1.0, 2.0, 1.0, 5.0, 1.1, 2.0, 9.0]), 2, 0.2) == float("inf")


def test_filters_take_nulls(spark):
    p = points(spark, [("a", 0, None, 0), ("a", 1, float("nan"), 1), ("a", 2, float("inf"), 2), ("a", 3, -1.0, 3), ("a", 4, 7.0, 4)])
    assert [r.value for r in filters.defined(filters.present(p)).collect()] == [7.0]


def test_lstm_rows_do_not_depend_on_the_batch(spark):
    model = ml.BiLSTM.seeded(2, 4)
    x = np.random.default_rng(0).normal(size=(3, 5, 2))
    assert np.allclose(model.predict(x)[1], model.predict(x[1:2])[0])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "i int, x array<array<double>>")
    got = ml.lstm_score(df, "x", model).orderBy("i").collect()
    assert np.allclose([g.p0 for g in got], model.predict(x)[:, 0])
    assert got[0].lstm_label == ("shock" if got[0].p0 > got[0].p1 else "Nonshock")


def test_hours_have_their_end_and_not_their_first_second(spark):
    stays = spark.sql("select 1L as icustay_id, timestamp'2020-01-01 00:00:00' as start")
    rows = spark.sql("""select 1L as icustay_id, cast(t as timestamp) as charttime, 'platelet' as label, cast(v as double) as value from values
      ('2020-01-01 00:00:00.5', 1), ('2020-01-01 00:00:01', 40), ('2020-01-01 01:00:00', 15), ('2020-01-01 01:30:00', 200) as x(t, v)""")
    got = severity.hourly_sofa(stays, rows, hours=3).orderBy("hr").collect()
    assert [g.coagulation for g in got] == [4, 0, None]
    assert [g.sofa for g in got] == [4, 0, 0]


def test_gcs(spark):
    df = spark.sql("""select 1 as icustay_id, cast(t as timestamp) as charttime, m as motor, v as verbal, e as eyes from values
      ('2020-01-01 00:00:00', 6, 0, 1), ('2020-01-01 01:00:00', 5, 4, cast(null as int)), ('2020-01-01 02:00:00', cast(null as int), 4, 3), ('2020-01-01 09:00:00', cast(null as int), 4, 3) as x(t, m, v, e)""")
    assert [r.gcs for r in severity.gcs(df).orderBy("charttime").collect()] == [15, 13, 12, 13]


def test_messages_round_trip(spark):
    p = points(spark, [("a", 1.5, 2.25, 0)])
    got = messages.decode(messages.encode(p)).first()
    assert (got.key, got.value) == ("a", 2.25)
    odd = messages.decode(spark.sql("select cast('x' as binary) as value")).first()
    assert odd.ts is None and odd.value is None


def test_wide_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TIME,HR,ABPSys\n10:00:00 01/02/2020,80,-1.0\n10:01:00 01/02/2020,x,120\n")
    got = {(r.label, r.value) for r in files.read_wide(spark, str(tmp_path / "a.csv"), ("HR", "ABPSys")).collect()}
    assert got == {("HR", 80.0), ("ABPSys", -1.0), ("ABPSys", 120.0)}


def test_numerics_directory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "r1.csv").write_text("'Time and date','HR','SpO2'\n'[hh:mm:ss dd/mm/yyyy]','bpm','%'\n'[10:00:00 01/02/2020]',80,-\n")
    (tmp_path / "d" / "r2.csv").write_text("'Time and date','SpO2'\n'[hh:mm:ss dd/mm/yyyy]','%'\n'[10:00:00 01/02/2020]',97\n")
    got = {(r.record, r.HR, r.SpO2) for r in files.read_numerics_dir(spark, str(tmp_path), ("HR", "SpO2")).collect()}
    assert got == {("r1", 80.0, 0.0), ("r2", 0.0, 97.0)}


def test_bounded_fill_stops(spark):
    df = spark.createDataFrame([(1, i, 5.0 if i == 1 else None) for i in range(6)], "k int, t int, v double")
    assert [r.v_filled for r in grids.bounded_fill(df, "k", "v", 2, "t").orderBy("t").collect()] == [None, 5.0, 5.0, 5.0, None, None]


def test_feature_rows_need_every_label(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "t int, label string, value double")
    assert [tuple(r) for r in features.feature_rows(df, ["b", "a"]).collect()] == [(1, 2.0, 1.0)]
    assert features.feature_rows(df, ["b", "a"], complete=False).count() == 2


def test_correlation_divides_by_the_first_signal(spark):
    p = points(spark, [("a", i, v, i) for i, v in enumerate([1.0, 2.0, 4.0, 9.0])] + [("b", i + 0.5, v, 10 + i) for i, v in enumerate([2.0, 3.0, 7.0])])
    got = features.correlation(p, "1 minute", [("a", "b")]).first().value
    x, y, n = np.array([1.0, 2.0, 4.0]), np.array([2.0, 3.0, 7.0]), 4
    cov = (x * y).sum() / n - x.sum() * y.sum() / n**2
    var = ((x * x).sum() / n - (x.sum() / n) ** 2) * ((y * y).sum() / n - (y.sum() / n) ** 2)
    assert abs(got - cov / math.sqrt(var)) < 1e-9


def test_reformat_and_overlaps(spark):
    df = spark.sql("select timestamp'2020-02-01 10:00:00' as ts, cast(null as double) as a, 2.5D as b")
    assert grids.reformat(df, "ts", ["a", "b"]).first().line == "10:00:00 01/02/2020,-1.0,2.5"
    o = spark.sql("select 1 as a, 3 as b, 3 as c, 5 as d, 4 as e")
    assert o.select(grids.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert not o.select(grids.overlaps(F.col("a"), F.col("b"), F.col("e"), F.col("d"))).first()[0]


def test_missing_values_are_injected_by_chance(spark):
    df = spark.range(4000).select("id", F.lit(5.0).alias("v"))
    n = grids.inject_missing(df, "v", 0.2, 0, "id").where("v = -1.0").count()
    assert 700 < n < 900


def test_online_zscore_of_nothing(spark):
    assert normalize.online_zscore(points(spark, [("a", 0, 1.0, 0)]).where("false")).count() == 0


def test_feature_tables_and_fixed_numerics(spark, tmp_path):
    (tmp_path / "f.csv").write_text("index,DateVitals,a,b,label\n0,2020-01-01 10:00:00,1.5,x,3\n")
    r = files.read_features(spark, str(tmp_path / "f.csv"), 2, 4, 4).first()
    assert (r.key, r.label, r.features, r.ts.hour) == ("patientId", "3", [1.5, None], 10)
    cells = ["'[10:00:00 01/02/2020]'", *map(str, range(1, 16))]
    cells[4] = "-"
    (tmp_path / "n.csv").write_text(",".join(cells) + "\n")
    got = {x.label: x.value for x in files.read_numerics(spark, str(tmp_path / "n.csv")).collect()}
    assert got["HR"] == 1.0 and got["ABPMean"] == 0.0 and got["NBPMean"] == 14.0 and len(got) == 8


def plain_weighted(rows, size, n):
    """One window of points (minute, value) in order of arrival, after the definition: times are in milliseconds."""
    ts = [int(m * 60_000) for m, _ in rows]
    step = size * 60_000 // 10
    k = 0
    while abs(k * step - ts[0]) > step:
        k += 1
    at = (k * step - ts[0]) + n // 2 * 60_000
    if len(rows) >= n:
        return ts[n // 2], rows[n // 2][1]
    hit = [v for t, (_, v) in zip(ts, rows) if t == at]
    if hit:
        return at, hit[0]
    before = [(t, v) for t, (_, v) in zip(ts, rows) if t < at][-1:]
    after = [(t, v) for t, (_, v) in zip(ts, rows) if t > at][:1]
    weights = [2.0 ** (n - abs(t - at) // 60_000) for t, _ in before + after]
    return at, sum(w * v for w, (_, v) in zip(weights, before + after)) / sum(weights)


def test_weighted_interpolation_after_its_definition(spark):
    r = np.random.default_rng(3)
    for size, n, m in ((10, 10, 4), (20, 6, 3), (10, 4, 6), (30, 30, 12), (10, 10, 1)):
        for grid in (1, 0.5, 1 / 3):
            rows = sorted((float(t) * grid, float(v)) for t, v in zip(r.choice(int(size / grid), m, replace=False), r.normal(5, 2, m)))
            p = points(spark, [("a", t * 60, v, i) for i, (t, v) in enumerate(rows)])
            got = interpolate.weighted(p, f"{size} minutes", f"{size} minutes", n).select((F.unix_micros("t") / 1000).alias("ms"), "value").first()
            want = plain_weighted(rows, size, n)
            assert abs(got.value - want[1]) < 1e-9 and abs(got.ms - want[0]) <= 1, (rows, size, n)


def test_nothing_is_rounded(spark):
    p = points(spark, [("a", 0, 1 / 3, 0), ("a", 1, 2 / 7, 1)])
    assert aggregates.window_stats(p, "1 minute").first().mean_v == (1 / 3 + 2 / 7) / 2


def test_signals_with_themselves(spark):
    p = points(spark, [("a", i, float(v), i) for i, v in enumerate([3, 1, 4, 1, 5])])
    assert abs(features.correlation(p, "1 minute", [("a", "a")], "30 seconds").first().value - 1) < 1e-9


def test_a_hundred_pairs_are_one_aggregate(spark):
    p = points(spark, [(k, i, float((i * (j + 3)) % 7), 10 * j + i) for j, k in enumerate("abc") for i in range(9)])
    plan = features.correlation(p, "1 minute", [("a", "b"), ("a", "c"), ("b", "c")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0


def test_differences_of_differences(spark):
    rows = [("a", 60 * i, float(v), i) for i, v in enumerate([1, 4, 9, 20, 22])]
    got = features.delta_delta(points(spark, rows), "2 minutes", "1 minute").orderBy("ts").collect()
    first = {}
    for i in range(4):  # window i holds points i and i + 1, and its result falls in the windows that hold its last instant
        first[i] = rows[i + 1][2] - rows[i][2]
    assert [(r.label, r.value) for r in got] == [("deltadeltaa", first[i + 1] - first[i]) for i in range(3)]


def test_models_are_saved_and_loaded(spark, tmp_path):
    model = ml.BiLSTM.seeded(3, 5)
    model.save(str(tmp_path / "m.npz"))
    again = ml.BiLSTM.load(spark, str(tmp_path / "m.npz"))
    x = np.random.default_rng(0).normal(size=(2, 4, 3))
    assert np.array_equal(model.predict(x), again.predict(x))


def test_integrated_scores(spark):
    """Windows of three rows each, as sequences of all features but the first, scored one by one."""
    names = ["f0", "f1", "f2"]
    df = spark.sql("select timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) as win_start, id * 1.0D as f0, sin(id) as f1, cos(id) as f2 from range(7)")
    model = ml.BiLSTM.seeded(2, 4, seed=3)
    got = {r.start: r for r in pipeline.integrated(df, names, model, "3 hours", "1 hour").collect()}
    assert len(got) == 9
    rows = sorted((r.win_start, (r.f1, r.f2)) for r in df.collect())
    for start, r in got.items():
        inside = [v for t, v in rows if start <= t < r.stop]
        p = model.predict(np.array([inside]))[0]
        assert (r.key, r.n, (r.stop - start).total_seconds()) == (start.year if start.year == 2020 else 2020, len(inside), 10_800)
        assert abs(r.p0 - p[0]) < 1e-9 and abs(r.p1 - p[1]) < 1e-9 and r.label == ("shock" if p[0] > p[1] else "Nonshock")


def test_integrated_query_is_its_parts(spark, small):
    names = pipeline.feature_names(pipeline.SIGNALS)
    assert len(names) == 58 and names[:2] == ["CorrHRRESP", "CorrHRABPMean"] and names[-1] == "SOFA_SCORE"
    rows = sorted((r.win_start, [r[n] for n in names[1:]]) for r in pipeline.generate_features(series.named(spark, small), pipeline.SIGNALS).collect())
    model = ml.BiLSTM.seeded(57, 8)
    got = catalog.QUERIES["integrated_score"](spark, small).collect()
    assert rows and got
    for r in got:
        p = model.predict(np.array([[v for t, v in rows if r.start <= t < r.stop]]))[0]
        assert abs(r.p0 - p[0]) < 2e-6 and r.label == ("shock" if r.p0 > r.p1 else "Nonshock")


def test_splines_against_a_dense_solution(spark, small):
    """Each window's spline from the full system of equations for second derivatives."""
    s = series.signals(spark, small).where("label = 'view' and seq % 3 = 0").limit(60)
    got = {(r.label, r.win_start): r for r in interpolate.spline(s, "360 minutes", "60 minutes", 360).collect()}
    w = interpolate._at(s, "360 minutes", "60 minutes", 360, ("label",)).collect()
    for key, r in got.items():
        pts = sorted((x.us, x.seq, x.value, x.expected) for x in w if (x.label, x.win_start) == key)
        xs, ys = [], []
        for us, _, v, e in pts:
            if (us - e) / 60e6 not in xs:
                xs.append((us - e) / 60e6)
                ys.append(v)
        k = len(xs)
        want = 0.0
        if k >= 3 and xs[0] <= 0 <= xs[-1]:
            a, b = np.eye(k), np.zeros(k)
            for i in range(1, k - 1):
                h0, h1 = xs[i] - xs[i - 1], xs[i + 1] - xs[i]
                a[i, i - 1], a[i, i], a[i, i + 1] = h0, 2 * (h0 + h1), h1
                b[i] = 6 * ((ys[i + 1] - ys[i]) / h1 - (ys[i] - ys[i - 1]) / h0)
            m = np.linalg.solve(a, b)
            i = max(j for j in range(k - 1) if xs[j] <= 0)
            h, t = xs[i + 1] - xs[i], -xs[i]
            want = ys[i] + t * ((ys[i + 1] - ys[i]) / h - h * (2 * m[i] + m[i + 1]) / 6) + t * t * m[i] / 2 + t**3 * (m[i + 1] - m[i]) / (6 * h)
        assert abs(r.value - want) < 1e-6


def plain_entropies(x, r, tau, m_max):
    """Sample entropies of coarse series, template by template."""
    out, tolerance = {}, r * np.std(x)
    for scale in range(1, tau + 1):
        y = [sum(x[i : i + scale]) / scale for i in range(0, len(x), scale)]
        n = len(y) - m_max
        c = [sum(all(abs(y[i + k] - y[j + k]) <= tolerance for k in range(m)) for i in range(n) for j in range(i + 1, n)) for m in range(m_max + 1)]
        for m in range(1, m_max):
            v = -math.log(c[m + 1] / c[m]) if c[m] and c[m + 1] else math.log(n * (n - 1)) if n > 1 else None
            if v is not None and math.isfinite(v):
                out[scale - 1, m - 1] = v
    return out


def test_multiscale_query_against_plain_code(spark, small):
    got = {(r.label, r.win_start, r.scale, r.m): r.value for r in catalog.QUERIES["multiscale_entropy"](spark, small).collect()}
    w = windows.windowed(series.signals(spark, small), "2880 minutes").orderBy("ts", "seq").collect()
    want = {}
    for key in {(r.label, r.win_start) for r in w}:
        x = [r.value for r in w if (r.label, r.win_start) == key]
        want |= {(*key, *sm): v for sm, v in plain_entropies(x, 0.2, 3, 4).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_scores_of_sequences_against_plain_code(spark, small):
    model = ml.BiLSTM.seeded(1, 8)
    seqs = {(r.entity, r.rn): r.seq_values for r in ml.sequences(series.signals(spark, small), "entity", "value", "value", 3, "ts", "seq").collect()}
    gate = lambda v: 1 / (1 + np.exp(-v))
    for r in catalog.QUERIES["lstm_score"](spark, small).limit(50).collect():
        ends = []
        for k, order in ((0, 1), (3, -1)):
            kernel, recurrent, bias = model.weights[k : k + 3]
            h, c = np.zeros(8), np.zeros(8)
            for v in seqs[r.entity, r.rn][::order]:
                z = np.array([v / 100]) @ kernel + h @ recurrent + bias
                c = gate(z[8:16]) * c + gate(z[:8]) * np.tanh(z[16:24])
                h = gate(z[24:]) * np.tanh(c)
            ends.append(h)
        z = np.exp(np.concatenate(ends) @ model.weights[6] + model.weights[7])
        assert abs(r.p0 - z[0] / z.sum()) < 2e-6 and r.label == ("shock" if r.p0 > r.p1 else "Nonshock")


def test_scores_within_the_hour_only(spark):
    df = spark.sql("""select 1 as icustay_id, cast(t as timestamp) as charttime, h as hr, m as motor, v as verbal, e as eyes from values
      ('2020-01-01 00:50:00', 0, 3, 2, 1), ('2020-01-01 01:10:00', 1, cast(null as int), 4, cast(null as int)), ('2020-01-01 01:20:00', 1, 5, cast(null as int), cast(null as int)) as x(t, h, m, v, e)""")
    assert [r.gcs for r in severity.gcs(df, ("icustay_id", "hr")).orderBy("charttime").collect()] == [6, 14, 13]
    assert [r.gcs for r in severity.gcs(df).orderBy("charttime").collect()] == [6, 8, 13]


def test_one_class_counts_as_the_second(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 9.0), ("c", None)], "k string, s double")
    assert sorted((r.k, r.label, r.shock, r.Nonshock) for r in ml.labelled(df, "s", 4, "k").collect()) == [("a", "Nonshock", 0, 1), ("a", "shock", 1, 0), ("b", "shock", 0, 1), ("c", "Nonshock", 0, 1)]


def test_csv_and_a_source_of_ones_own(spark, tmp_path):
    spark.dataSource.register(generated.SignalSource)
    df = spark.read.format("signals").option("labels", "HR,RESP").option("rows", 250).option("rowsPerSplit", 100).load()
    assert df.rdd.getNumPartitions() == 6 and df.count() == 500 and df.select("label", "seq").distinct().count() == 500
    files.write_csv(df.coalesce(1), str(tmp_path / "out"))
    again = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert again.columns == df.columns and again.count() == 500
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))


def test_forms_of_messages(spark):
    p = points(spark, [("a", 1.5, 2.25, 0), ("b", 2, None, 1)])
    text = lambda df: sorted(bytes(r.value).decode() for r in df.collect() if r.key is None)
    assert text(messages.encode_keyed(p)) == ["key: a, time: 1500, value: 2.25", "key: b, time: 2000, value: "]
    assert text(messages.encode_row(p.select("label", "value"))) == ["a,2.25", "b,"]


def test_tables_are_written_as_a_whole(spark, tmp_path):
    df = spark.range(5)
    for n in (5, 3):
        clinical_views.materialise({"five": df.limit(n)}, str(tmp_path))
        assert spark.table("five").count() == n


def test_read_of_a_database_is_lazy_in_its_options(spark):
    """Without a driver here, only that the call reaches Spark's reader with what it was given."""
    import pytest

    with pytest.raises(Exception, match="(?i)suitable driver|ClassNotFound"):
        files.read_jdbc(spark, "jdbc:none://x", "t", fetchsize="10")


def test_slices_change_nothing(spark):
    """As-of, the row before and sessions: long keys dealt to slices of time give what one run gives."""
    r = np.random.default_rng(6)
    p = points(spark, [(str(k) if k else None, int(t), float(v), i) for i, (k, t, v) in enumerate(zip(r.integers(0, 3, 300), r.choice(40_000, 300, replace=False), r.normal(0, 1, 300)))]).withColumn("bad", F.col("value") > 1.5)
    left, right = p.where("seq % 2 = 0"), p.where("seq % 2 = 1")
    for f in (
        lambda s: joins.as_of(left, right, "label", "ts", 900, "value", "seq", slice_seconds=s),
        lambda s: joins.previous_within(p, "label", "value", 1, slice_seconds=s),
        lambda s: joins.sessions(p, "label", 200, breaks=F.col("bad"), slice_seconds=s),
    ):
        one = sorted(map(str, f(None).collect()))
        assert len(one) in (150, 300) and all(sorted(map(str, f(s).collect())) == one for s in (100, 5000))


def test_trailing_frames_run_on_and_keep_every_row(spark):
    """Against the plain definition; no window frame is gathered anew for each row, which at size never ends."""
    r = np.random.default_rng(7)
    rows = [(k, int(t), v, i) for i, (k, t, v) in enumerate(zip(r.choice(["a", "b"], 300), r.integers(-300, 900, 300), r.normal(5, 3, 300).round(2).tolist(), strict=True))]
    rows += [("c", t, v, 1000 + i) for i, (t, v) in enumerate([(0, 1.0), (59, None), (60, 3.0), (60, 3.0), (61, math.inf), (120, 0.5), (121, 0.25), (122, math.nan), (200, 1e9), (200, 1e9 + 1), (500, None)])]
    rows += [(None, 10, 2.0, 2000), (None, 20, 4.0, 2001)]
    p = points(spark, rows)
    timeless = spark.createDataFrame([("a", None, 2.0, 3000), ("a", None, 4.0, 3001)], p.schema)
    out = windows.trailing(p.unionByName(timeless), 60)
    got = {x.seq: x for x in out.collect()}
    assert len(got) == len(rows) + 2
    rows += [("a", None, 2.0, 3000), ("a", None, 4.0, 3001)]
    same = lambda x, y: x is y or (None not in (x, y) and (x == y or math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)))
    for k, t, _, i in rows:
        v = [x for a, u, x, _ in rows if a == k and x is not None and (u is None if t is None else u is not None and t - 60 < u <= t)]
        want = [sum(v) / len(v) if v else None, None, None, None]
        if v:
            numbers = [x for x in v if not math.isnan(x)]
            want[2:] = min(numbers, default=math.nan), max(numbers) if len(numbers) == len(v) else math.nan
            if len(v) > 1:
                want[1] = float(np.std(v, ddof=1)) if all(map(math.isfinite, v)) else math.nan
        assert all(map(same, (got[i].mean_v, got[i].std_v, got[i].min_v, got[i].max_v), want)), (k, t, i, got[i], want)
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "windowframe" in plan and plan.count("windowframe") == plan.count("unboundedpreceding")
