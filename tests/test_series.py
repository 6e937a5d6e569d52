"""Series, readers, regressions and budget fits on inputs with known answers."""

import datetime as dt
import math
import shutil

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from marshlight.operators import budget as U
from marshlight.operators import gapfill as G
from marshlight.operators import regress as M
from marshlight.operators import series as S
from marshlight.operators import stats as T
from marshlight.sources import gauges as D
from marshlight.sources import tiles as X


def months(n, start=2000):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def test_circle_and_reverse(spark):
    pts = [("a", i, math.cos(i / 64 * math.tau), math.sin(i / 64 * math.tau)) for i in range(64)]
    pts += [("b", -i, x, y) for _, i, x, y in pts] + [("c", 0, 1.0, 2.0), ("c", 1, 2.0, 3.0), ("c", 2, None, 1.0)]
    out = {r.k: r for r in S.phase_loops(spark.createDataFrame(pts, "k string, o int, x double, y double"), ["k"], "x", "y", "o").collect()}
    assert out["a"].direction == "CCW" and 0.99 < out["a"].circularity <= 1
    assert out["b"].direction == "CW" and out["c"].direction == "NA" and out["c"].circularity is None


def test_reservoir_crosses_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    df = spark.createDataFrame([("k", m, float(v)) for m, v in zip(months(40), x)], "k string, month date, v double")
    got = [r.reservoir for r in S.exp_reservoir(df, ["k"], "v", [3.0], block=7).orderBy("month").collect()]
    a, r, want = 1 - math.exp(-1 / 3), 0.0, []
    for v in x:
        r = a * v + (1 - a) * r
        want.append(r)
    assert got == pytest.approx(want)


def test_exact_alpha(spark):
    rng = np.random.default_rng(1)
    rows = [("p", m, float(f), float(x)) for m, f, x in zip(months(24), rng.normal(size=24), rng.normal(size=24))]
    cum = spark.createDataFrame([(p, m, -0.7 * x, 0.0, x) for p, m, _, x in rows], "dataset string, month date, cum_flux double, cum_ds double, cum_x1 double")
    fit = U.fit_one(U.closure_sums(cum, ["x1"])).first()
    assert fit.alpha == pytest.approx(0.7) and fit.rmse_tuned == pytest.approx(0, abs=1e-7) and fit.improvement_pct == pytest.approx(100, abs=1e-4)


def test_two_parameters_and_collinear(spark):
    rng = np.random.default_rng(2)
    x1, x2, e = rng.normal(size=(3, 30))
    r = 1.5 * x1 - 0.4 * x2 + 0.1 * e
    schema = "dataset string, cum_flux double, cum_ds double, cum_x1 double, cum_x2 double"
    data = [("p", float(a), 0.0, float(b), float(c)) for a, b, c in zip(r, x1, x2)] + [("q", float(a), 0.0, float(b), float(2 * b)) for a, b in zip(r, x1)]
    fit = {f.dataset: f for f in U.fit_two(U.closure_sums(spark.createDataFrame(data, schema), ["x1", "x2"])).collect()}
    want = np.linalg.lstsq(np.column_stack([x1, x2]), -r, rcond=None)[0]
    assert (fit["p"].alpha, fit["p"].beta) == pytest.approx(tuple(want)) and fit["q"].alpha is None


def ridge(x, y, alpha, scale=True):
    m, s = x.mean(0), x.std(0) if scale else np.ones(x.shape[1])
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + ((q - m) / s) @ w


def design(n=47, p=3, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 0.2] + [0, 10, 3]
    return x, x @ [1.0, -0.3, 4.0] + rng.normal(size=n)


def frame(spark, x, y):
    data = [("k", m, float(t), *map(float, r)) for m, t, r in zip(months(len(y)), y, x)]
    return spark.createDataFrame(data, "k string, month date, y double, a double, b double, c double")


@pytest.mark.parametrize("scale", [True, False])
def test_ridge_folds_equal_refits(spark, scale):
    x, y = design()
    got = {(r.alpha, r.fold): r for r in M.ridge_cv(frame(spark, x, y), ["k"], ["a", "b", "c"], "y", "month", 5, [0.5, 10.0], scale).collect()}
    size = 47 // 6
    for alpha in (0.5, 10.0):
        for fold in range(1, 6):
            a = 47 - (6 - fold) * size
            yt = y[a : a + size]
            e = yt - ridge(x[:a], y[:a], alpha, scale)(x[a : a + size])
            r = got[alpha, fold]
            assert r.mse == pytest.approx((e**2).mean(), rel=1e-6) and r.n_test == size
            assert r.r2 == pytest.approx(1 - (e**2).sum() / ((yt - yt.mean()) ** 2).sum(), rel=1e-6)


def test_leave_one_out_equals_refitting(spark):
    x, y = design(12)
    z = (x - x.mean(0)) / x.std(0)  # the scaler sees every row
    df = frame(spark, x, y).withColumn("gap", F.when(F.month("month") != 2, 1.0))
    got = [r.predicted for r in M.leave_one_out(df, ["k"], ["a", "b", "c", "gap"], "y").orderBy("month").collect()]
    want = [float(ridge(np.delete(z, i, 0), np.delete(y, i), 1.0, False)(z[i])) for i in range(12)]
    assert got == pytest.approx(want, rel=1e-8)
    assert M.leave_one_out(df.limit(3), ["k"], ["a"], "y").count() == 0


def test_prediction_and_metrics(spark):
    x, y = design(30)
    df = frame(spark, x, y)
    model = M.ridge_fit(df, ["k"], ["a", "b", "c"], "y", 2.0)
    pred = M.predict(df, model, ["k"], ["a", "b", "c"])
    want = ridge(x, y, 2.0)(x)
    assert [r.predicted for r in pred.orderBy("month").collect()] == pytest.approx(list(want))
    m = M.metrics(pred, ["k"], "y", "predicted").first()
    assert m.rmse == pytest.approx(math.sqrt(((y - want) ** 2).mean()))


def test_spline_reproduces_a_parabola(spark):
    y = [0.5 * i * i - 3 * i + 2.0 for i in range(30)]
    holes = {0, 4, 5, 10, 11, 12, 20, 29}
    df = spark.createDataFrame([("k", m, None if i in holes else v) for i, (m, v) in enumerate(zip(months(30), y))], "k string, month date, q double")
    out = [r.filled for r in G.fill_gaps(df, ["k"], "q").orderBy("month").collect()]
    for i, v in enumerate(out):
        if i in {0, 10, 11, 12, 29}:
            assert v is None  # too long, leading or trailing
        else:
            assert v == pytest.approx(y[i], abs=1e-8)


def dense_spline(x, y, at):
    """Quadratic B-splines by the recurrence from degree 0, and one dense solve."""
    middle = (x[1:] + x[:-1]) / 2
    knots = np.concatenate([np.repeat(x[0], 3), middle[1:-1], np.repeat(x[-1], 3)])

    def values(q):
        inside = np.clip(np.searchsorted(knots, q, side="right") - 1, 2, len(x) - 1)
        v = np.eye(len(knots) - 1)[inside]
        for d in (1, 2):
            rise, fall = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
            up = np.divide(q[:, None] - knots[: -d - 1], rise, out=np.zeros((len(q), len(rise))), where=rise > 0)
            down = np.divide(knots[d + 1 :] - q[:, None], fall, out=np.zeros((len(q), len(fall))), where=fall > 0)
            v = up * v[:, :-1] + down * v[:, 1:]
        return v

    return values(at) @ np.linalg.solve(values(x), y)


def test_spline_equals_a_dense_solve(spark):
    """Short and long series, gaps anywhere, chunks of seven readings."""
    rng = np.random.default_rng(1)
    rows, series = [], {}
    for k, n in enumerate([2, 3, 4, 5, 9, 40, 300]):
        y, gone = rng.normal(size=n).cumsum(), rng.random(n) < 0.25
        if n < 6:
            gone = np.arange(n) == (1 if n > 3 else -1)
        series[k] = np.where(gone, np.nan, y)
        rows += [(k, m, None if g else float(v)) for m, v, g in zip(months(n), y, gone)]
    filled = G.fill_gaps(spark.createDataFrame(rows, "k int, month date, q double"), ["k"], "q", 2, chunk=7).orderBy("k", "month").collect()
    count = 0
    for k, y in series.items():
        known = np.flatnonzero(~np.isnan(y))
        got = [r.filled for r in filled if r.k == k]
        assert len(got) == len(y) and all(got[i] == y[i] for i in known)
        for i in np.flatnonzero(np.isnan(y)):
            before, after = known[known < i], known[known > i]
            if len(known) >= 3 and len(before) and len(after) and after[0] - before[-1] <= 3:
                assert got[i] == pytest.approx(dense_spline(known.astype(float), y[known], np.array([float(i)]))[0], abs=1e-9)
                count += 1
            else:
                assert got[i] is None
    assert count > 50


def test_a_long_system_is_solved_in_chunks(spark):
    n = 40_000
    f = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), *[F.lit(v).alias(c) for c, v in (("a", 0.25), ("b", 0.5), ("c", 0.2))], (F.sin(F.col("id") / 9) + 0.1).alias("y")).repartition(6)
    got = np.array([r.w for r in G.spline_weights(f, ["k"], 1000).orderBy("i").collect()])
    y = np.sin(np.arange(n) / 9) + 0.1
    left = 0.5 * got + 0.25 * np.concatenate([[0], got[:-1]]) + 0.2 * np.concatenate([got[1:], [0]])
    assert np.abs(left - y).max() < 1e-9
    assert "Python" not in plan(G.spline_weights(f, ["k"], 1000))


@pytest.mark.parametrize("n", [5, 6, 12, 31])
def test_student_tail(spark, n):
    r = 0.43
    t, df = r * math.sqrt((n - 2) / (1 - r * r)), n - 2
    u = np.linspace(0, t, 200001)
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + u * u / df) ** (-(df + 1) / 2)
    want = 1 - 2 * np.trapezoid(density, u)
    got = spark.range(1).select(T.student_tail(F.lit(r), F.lit(n))).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_harmonic_recovers_its_parts(spark):
    data = [("k", m, 5 + 2 * math.cos(math.tau * (i + 1) / 12) - 1.5 * math.sin(math.tau * (i + 1) / 12)) for i, m in enumerate(months(50))]
    f = T.annual_harmonic(spark.createDataFrame(data, "k string, month date, v double"), ["k"], "v").first()
    assert (f.intercept, f.a, f.b, f.r2) == pytest.approx((5, 2, -1.5, 1)) and f.amplitude == pytest.approx(2.5)


GAUGE = """# GRDC-No.:  1234567
# Station:   NORTH/FORD (678)
# Latitude (DD):  -18,25
# Catchment area (km\xb2):  1000.5
#    hh:mm - Time
YYYY-MM-DD;hh:mm; Level; Discharge
1975-01-01;--:--;  1.0;  123.000
1975-01-02;--:--;  1.1;  -999.000
1975-01-03;--:--;  x;  7.5

1975-02-31;--:--;  1.3;  9
"""


def test_gauge_files(spark, tmp_path):
    (tmp_path / "1234567_Q_Day.Cmd.txt").write_bytes(GAUGE.encode("latin-1"))
    (tmp_path / "odd.Cmd.txt").write_text("# Station: PLAIN\nYYYY-MM-DD;hh:mm; Value\n1980-01-02;06:30; 3\n1980-01-01;--:--; 2\n")
    (tmp_path / "ignored.txt").write_text("# Station: NO\n")
    lines = D.read_lines(spark, str(tmp_path))
    folder = D.by_station(D.station_table(lines)).collect()
    assert [r.file for r in folder] == ["1234567_Q_Day.Cmd.txt", "odd.Cmd.txt"]
    a = folder[0]
    assert (a.grdc_no, a.lat, a.catchment_area_km2, a.station_name, a.station_code, a.file_tag) == (1234567, -18.25, 1000.5, "NORTH/FORD", "678", "Q_Day")
    assert folder[1].station_name == "PLAIN" and folder[1].file_station_id is None
    values = D.gauge_values(lines)
    long = [(r.ts.isoformat(), r["column"], r.value) for r in values.where("file like '123%'").orderBy("ts", "position").collect()]
    assert long == [("1975-01-01T00:00:00", "Level", 1.0), ("1975-01-01T00:00:00", "Discharge", 123.0), ("1975-01-02T00:00:00", "Level", 1.1),
                    ("1975-01-02T00:00:00", "Discharge", None), ("1975-01-03T00:00:00", "Level", None), ("1975-01-03T00:00:00", "Discharge", 7.5)]
    picked = {r.file: r["column"] for r in D.discharge_column(values).collect()}
    assert picked == {"1234567_Q_Day.Cmd.txt": "Discharge", "odd.Cmd.txt": "Value"}
    timed = [r.ts.isoformat() for r in D.discharge(values).where("file = 'odd.Cmd.txt'").orderBy("ts").collect()]
    assert timed == ["1980-01-01T00:00:00", "1980-01-02T06:30:00"]


def test_gauge_listing(spark, tmp_path):
    """A listing of many files gives what the files give, in whatever order and pieces its lines lie."""
    plain = "# Station: PLAIN: A\nYYYY-MM-DD;hh:mm; Value\n1980-01-02;06:30; 3\n1980-01-01;--:--; 2\n"
    folder, listing = tmp_path / "folder", tmp_path / "listing"
    folder.mkdir(), listing.mkdir()
    lines = []
    for name, text in (("1234567_Q_Day.Cmd.txt", GAUGE), ("odd.Cmd.txt", plain), ("ignored.txt", "# Station: NO\n")):
        (folder / name).write_bytes(text.encode("latin-1"))
        lines += [f"{name}:{k + 1}:{line}" for k, line in enumerate(text.splitlines())]
    lines.reverse()
    for k in range(3):
        (listing / f"part-{k}").write_bytes("".join(x + "\n" for x in lines[k::3]).encode("latin-1"))
    a, b = D.read_lines(spark, str(folder)), D.read_listing(spark, str(listing))
    for made in (D.header_items, lambda x: D.header_items(x, strict=True), D.station_table, D.gauge_values, lambda x: D.discharge(D.gauge_values(x)), D.strict_values):
        assert sorted(map(repr, made(a).collect())) == sorted(map(repr, made(b).collect()))


def test_gauges_cost_no_files(spark, tables):
    """The scan of gauges writes tasks' files, not one per gauge."""
    from marshlight.plans import scans

    lines = scans._scanned(tables)
    assert len(lines.inputFiles()) < lines.select("file").distinct().count()


def test_strict_header_types(spark, tmp_path):
    (tmp_path / "s.Cmd.txt").write_text("# GRDC-No.: 12\n# Altitude (m ASL): 3.5\n# Last update: 2001-02-03\n# River:  A   B\n#   note: x\nYYYY-MM-DD;hh:mm;Value\n# late: 1\n")
    items = {r.key: r for r in D.typed_items(D.header_items(D.read_lines(spark, str(tmp_path)), strict=True)).collect()}
    assert {k: r.kind for k, r in items.items()} == {"GRDC-No.": "int", "Altitude (m ASL)": "float", "Last update": "date", "River": "text"}
    assert items["River"].value == "A B"


def test_tiles_from_files(spark, tmp_path):
    schema = "iy int, ix int, lat double, lon double, value double"
    for name, v in (("t_20010105", 1.0), ("z_2001-01-05", 2.0), ("t_20019999", 3.0)):
        one = spark.createDataFrame([(0, 0, -19.0, 22.0, v), (0, 1, -19.0, 22.1, float("nan"))], schema)
        path = tmp_path / name
        one.coalesce(1).write.parquet(str(path))
        shutil.copy(next(path.glob("part-*.parquet")), tmp_path / f"{name}.parquet")
    stacked = X.read_tiles(spark, [str(p) for p in sorted(tmp_path.glob("*.parquet")) if p.is_file()], schema)
    assert stacked.where("value is null").count() == 3
    merged = X.merge_tiles(stacked).orderBy("ix").collect()
    assert [(str(r.time), r.ix, r.value) for r in merged] == [("2001-01-05", 0, 1.0), ("2001-01-05", 1, None)]


def test_variables_are_dealt_before_they_are_sorted(spark, tmp_path):
    """No task that reads a split sorts it; a file whose variables all score below 0 has no choice."""
    from conftest import plan

    path = str(tmp_path / "catalogue")
    rows = [("a", "/x/", "depth", ["lat", "lon"], True, 0), ("a", "/", "depth", ["lat", "lon"], True, 1), ("a", "/", "lat", ["lat"], True, 2), ("b", "/", "lon", ["lon"], True, 0)]
    spark.createDataFrame(rows, "file string, grp string, var string, dims array<string>, is_numeric boolean, entry int").write.parquet(path)
    catalogue = spark.read.parquet(path)
    for made in (X.choose_variable(catalogue), X.resolve_name(catalogue, "depth")):
        above, below = plan(made).split("Exchange", 1)
        assert "SortAggregate" in above and "Sort" not in below
    assert [(r.file, r.grp, r["var"], r.score) for r in X.choose_variable(catalogue).collect()] == [("a", "/", "depth", 4)]
