"""Every core query with SQL against DuckDB, and the numeric kernels against small cases."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

import numpy as np
import oracle
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomstat.functions import dist
from loomstat.functions import text as X
from loomstat.operators import changepoint as P
from loomstat.operators import contracts as C
from loomstat.operators import dominance as D
from loomstat.operators import hashes
from loomstat.operators import measure as M
from loomstat.operators import regress as G
from loomstat.operators import resample as B
from loomstat.operators import trend as T
from loomstat.plans import catalogue
from loomstat.sources import files as S
from loomstat.streaming import windows


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert oracle.difference(catalogue.queries()[name](spark, DATA), duck, catalogue.oracle_sql()[name]) == ""


def test_tails():
    assert math.isclose(dist.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.chi2_tail(4.420314, 2), math.exp(-4.420314 / 2), rel_tol=1e-9)
    assert math.isclose(dist.student_two_sided(2.042272456301238, 30), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.student_quantile(0.975, 30), 2.042272456301238, rel_tol=1e-9)


def test_iqr_needs_four_and_weights_must_be_positive(spark):
    rows = [("a", float(x), 1.0) for x in (1, 2, 3)] + [("b", float(x), 1.0) for x in (1, 2, 3, 4)] + [("c", 5.0, 0.0), ("c", float("nan"), 1.0), ("c", None, 2.0)]
    out = {r["g"]: r for r in spark.createDataFrame(rows, "g string, score double, weight double").groupBy("g").agg(M.raw_iqr().alias("q"), M.weighted_mean().alias("m")).collect()}
    assert out["a"]["q"] is None and out["b"]["q"] == 1.5 and out["c"]["m"] is None


def test_weighted_iqr_equals_repeated_scores():
    rng = np.random.default_rng(0)
    s, c = rng.normal(size=9), rng.integers(0, 3, (20, 9))
    for got, k in zip(B._weighted_iqr(s, c), c):
        x = np.repeat(s, k)
        assert (np.isnan(got) and len(x) < 4) or math.isclose(got, np.subtract(*np.percentile(x, [75, 25])), abs_tol=1e-12)


def test_dominance_adds_up_to_full_r2():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(40, 4))
    p[:, 0] += p[:, 1]
    x = np.column_stack([np.ones(40), p[:, 1:]])
    e = p[:, 0] - x @ np.linalg.lstsq(x, p[:, 0], rcond=None)[0]
    assert math.isclose(D.general_dominance(p).sum(), 1 - e @ e / ((p[:, 0] - p[:, 0].mean()) ** 2).sum(), abs_tol=1e-10)


def test_kernels_over_many_panels_equal_the_plain_ones():
    rng = np.random.default_rng(8)
    p = rng.normal(size=(50, 40, 4))
    p[:, :, 0] += p[:, :, 1]
    p[3, :, 2] = p[3, :, 1]  # predictors that depend on each other
    p[4, :, 0] = 1.0  # no variance
    assert np.allclose(D.general_dominance_of(p), [D.general_dominance(x) for x in p], atol=1e-9)
    y, x1 = rng.normal(size=(20, 40, 2)).cumsum(axis=1) * 0.3, rng.normal(size=(20, 40))
    x = np.stack([np.ones((20, 40)), x1 - x1.mean(axis=1, keepdims=True), np.broadcast_to(np.arange(40) - 19.5, (20, 40))], axis=2)
    for order in (0, 1):
        many, each = G.bivariate_of(y, x, order), [G.bivariate(y[i], x[i], order) for i in range(20)]
        assert all(np.allclose(many[k], [f[k] for f in each], atol=1e-6) for k in ("phi", "loglik", "bic", "beta"))


def test_stationary_draws_run_on():
    at = D.stationary_indices(np.random.default_rng(2), 30, 5, 8)
    assert at.shape == (8, 30) and ((np.diff(at, axis=1) % 30) == 1).mean() > 0.5 and at.min() >= 0 and at.max() < 30


def test_measurement_layer_adds_to_the_temporal(spark):
    rows = catalogue.queries()["stationary_bootstrap"](spark, DATA.replace("0.001", "0.01")).collect()  # has complete panels
    by = {(r["block_length"], r["layer"], r["statistic"]): r["mean"] for r in rows}
    assert len(by) == 42 and all(by[b, "temporal", x] != by[b, "temporal_and_measurement", x] for b in (3, 4, 5) for x in ("q2", "q3", "q4", "full_r2"))


def test_ar_likelihood_equals_covariance_form():
    rng = np.random.default_rng(3)
    y = rng.normal(size=25)
    for phi in ((0.4,), (0.3, -0.2)):
        ll, _, s2, _ = P._profile(y, np.ones((25, 1)), phi)
        u, _ = P.whiten(np.eye(25), phi)
        cov = s2 * np.linalg.inv(u.T @ u)
        ones = np.ones(25)
        b = ones @ np.linalg.solve(cov, y) / (ones @ np.linalg.solve(cov, ones))
        e = y - b
        direct = -0.5 * (25 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))
        assert math.isclose(ll, direct, rel_tol=1e-9)


def test_search_finds_the_planted_shift(spark):
    rng = np.random.default_rng(4)
    y = np.where(np.arange(30) < 14, 0.0, 6.0) + rng.normal(size=30) * 0.5
    assert [r["onsets"] for r in P.winners(P.search(spark, y.tolist(), "x", durations=(5, 8), most=2, orders=(0,))).collect()] == [[15], [15]]


@pytest.mark.parametrize("phi", [(0.5,), (0.5, -0.3)])
def test_search_finds_breaks_under_autoregressive_errors(spark, phi):
    rng = np.random.default_rng(len(phi))
    e = np.zeros(48)
    for t in range(48):
        e[t] = sum(f * e[t - k] for k, f in enumerate(phi, 1) if t >= k) + rng.normal() * 0.3
    y = np.repeat([0.0, 6.0, -3.0], [15, 14, 19]) + e
    best = {r["min_duration"]: r for r in P.winners(P.search(spark, y.tolist(), "x", durations=(4, 16), most=2)).collect()}
    assert best[4]["onsets"] == [16, 30] and all(r["shortest"] >= d for d, r in best.items()) and best[16]["onsets"] != [16, 30]


def test_queries_find_four_breaks_with_short_regimes(spark, monkeypatch):
    from loomstat.plans import series

    rng = np.random.default_rng(6)
    level = np.repeat([0.0, 8, 1, 9, 2], [8, 3, 9, 4, 12])
    y = level + rng.normal(size=36) * 0.3
    monkeypatch.setattr(series, "_values", lambda *_: y.tolist())
    found = {(r["series"], r["min_duration"]): r["onsets"] for r in series.changepoint_winners(spark, DATA).collect()}
    assert found["gap", 3] == found["index", 3] == [9, 12, 21, 25] and len(found) == 8
    monkeypatch.setattr(series, "_values", lambda *_: (y + 0.5 * np.arange(36)).tolist())
    best = {r["model_class"]: r for r in series.trend_break_comparison(spark, DATA).where("min_duration = 3").collect()}
    assert best["break_plus_trend"]["selected"] and not best["trend_only"]["selected"]
    assert best["break_plus_trend"]["onsets"] == [9, 12, 21, 25] and best["break_plus_trend"]["delta"] == 0


def test_bootstrap_queries_have_5000_replicates(spark):
    from loomstat.plans import series

    assert series.cluster_bootstrap(spark, DATA).select("replicate").distinct().count() == 5000
    assert series.replicate_regressions(spark, DATA.replace("0.001", "0.01")).groupBy("ar_order").count().collect()[0]["count"] > 4750


def test_few_valid_replicates_give_no_summary(spark):
    fits = spark.createDataFrame([(i, -1.0 - i, 1.0, None if i < 2 else -2.0) for i in range(20)], "replicate int, rep_polarization double, dem_polarization double, contrast double").withColumn("k", F.lit(0))
    out = {r["effect"]: r for r in G.effects_summary(fits, 20, ["k"]).collect()}
    assert out["rep_polarization"]["probability_negative"] == 1.0 and out["contrast"]["mean"] is None and out["contrast"]["n_valid"] == 18


def test_joint_band_is_wider_than_either(spark):
    rng = np.random.default_rng(9)
    rows = [(3, "temporal", i, float(a), float(b), float(c), 1.0) for i, (a, b, c) in enumerate(rng.normal(size=(400, 3)))]
    r = D.simultaneous_contrasts(spark.createDataFrame(rows, D._DRAW)).first()
    one = np.abs([c - a for *_, a, b, c, _ in rows] - np.mean([c - a for *_, a, b, c, _ in rows]))
    assert r["radius"] >= np.quantile(one, 0.95) and not r["both_positive"]


def test_influence_uses_the_selected_order(spark, monkeypatch):
    from loomstat.plans import series

    rng = np.random.default_rng(7)
    e = np.zeros((60, 2))
    for t in range(1, 60):
        e[t] = 0.8 * e[t - 1] + rng.normal(size=2)
    rows = [(t, str(t), float(rng.normal()), float(a), float(b)) for t, (a, b) in enumerate(e)]
    panel = spark.createDataFrame(rows, "t int, year_month string, polarization double, rep double, dem double")
    monkeypatch.setattr(series.I, "panel", lambda *_: panel)
    assert all(r["phi"] > 0.5 for r in series.influence(spark, DATA).collect())


def test_trend_test_of_ranks_with_three_swaps(spark):
    y = np.array([1.0, 3, 2, 5, 4, 6, 8, 7, 9, 10])
    out = T.hamed_rao(y, 2)
    assert out["S"] == 39 and math.isclose(out["variance"], 125.0)


def test_autoregressive_regression_recovers_slopes():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(60), rng.normal(size=60), np.arange(60) - 29.5])
    y = x @ np.array([[1.0, 2.0], [0.5, -0.5], [0.0, 0.1]]) + rng.normal(size=(60, 2)) * 0.01
    for order in (0, 1):
        assert np.allclose(G.bivariate(y, x, order)["beta"][1], [0.5, -0.5], atol=0.02)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [("2024-01", i, p, q, float(i % 7), 1.0) for i in range(20) for p in M.PARTIES for q in ("q1", "q2")]
    df = spark.createDataFrame(rows, "year_month string, article long, party string, dimension string, score double, weight double")
    a, b = (B.cluster_bootstrap(df.repartition(n), 6).orderBy("replicate", "party", "dimension").collect() for n in (1, 5))
    assert a == b and len(a) == 24


def test_months_drawn_apart_follow_one_stream(spark):
    rows = [(m, i, p, "q1", float((7 * i) % 11), 1.0) for m, n in (("2024-01", 9), ("2024-02", 12)) for i in range(n) for p in M.PARTIES]
    df = spark.createDataFrame(rows, "year_month string, article long, party string, dimension string, score double, weight double")
    states = B.sequential_states({"2024-01": 9, "2024-02": 12}, 5, 123)
    got = {(r["year_month"], r["replicate"]): r["mean"] for r in B.cluster_bootstrap(df, 5, states=states).where("party = 'democrat'").collect()}
    rng = np.random.default_rng(123)
    for month, n in (("2024-01", 9), ("2024-02", 12)):
        counts, s = rng.multinomial(n, np.full(n, 1 / n), size=5), np.array([float((7 * i) % 11) for i in range(n)])
        assert all(math.isclose(got[month, k], c @ s / n) for k, c in enumerate(counts))


def test_suggested_onsets():
    assert P.suggested_onsets(34, 6) == [(), (18,), (12, 24), (10, 18, 26), (8, 15, 21, 28)]
    assert P.valid_onsets((4, 8), 10, 3) and not P.valid_onsets((4, 9), 10, 3) and not P.valid_onsets((8, 4), 10, 3)


def test_replicate_sums_are_exact_in_any_order(spark):
    rows = [(i, "2024-01", p, "q1", float(100 * np.sin(i)), float(np.log(2 + i % 5))) for i in range(400) for p in M.PARTIES]
    df = spark.createDataFrame(rows, "article long, year_month string, party string, dimension string, score double, weight double")
    runs = [sorted(map(tuple, B.replicate_measures(df.repartition(n, *by), 20).collect())) for n in (1, 2, 3, 5, 7) for by in ((), ("score",))]
    assert len(runs) == 10 and all(r == runs[0] for r in runs)


def test_counts_of_keys_and_replicates_are_md5(spark):
    keys = ["", "7", "1234567", "é" * 5, "x" * 47, "x" * 50, "x" * 51, "x" * 52, "y" * 90]
    got = hashes.counts(pa.array(keys), 1001, B._POISSON)
    for k, row in zip(keys, got):
        for r in (1, 9, 10, 99, 100, 999, 1000, 1001):
            u = int(hashlib.md5(f"{k}:{r}".encode()).hexdigest()[:8], 16) % 10_000
            assert row[r - 1] == sum(u >= p for p in B._POISSON)


def test_replicate_measures_equal_counts_one_by_one(spark):
    """Whether brackets hold every drawn quartile or are too narrow at first; no row is made for each replicate."""
    rng = np.random.default_rng(3)
    n, reps = 6000, 15
    values = {"q1": rng.lognormal(size=n), "q2": np.round(rng.normal(size=n), 1), "q3": np.where(np.arange(n) < 9, np.arange(n) / 7, np.nan)}
    rows = [(i, None if d == "q2" else "2024-01", "democrat", d, float(x), 1.0 + i % 3) for d, v in values.items() for i, x in enumerate(v) if x == x]
    df = spark.createDataFrame([*rows, (1, "2024-01", "democrat", "q1", None, 1.0)], "article long, year_month string, party string, dimension string, score double, weight double").repartition(3)
    counts = hashes.counts(pa.array([str(i) for i in range(n)]), reps, B._POISSON)
    for deviations in (B.DEVIATIONS, 0.0):
        made = B.replicate_measures(df, reps, deviations=deviations)
        got = {(r["dimension"], r["replicate"]): r for r in made.collect()}
        assert made.count() == len(got) == 3 * reps
        for (d, k), r in got.items():
            v, c = values[d], counts[:, k - 1] * (values[d] == values[d])
            drawn = np.repeat(v, c)
            w = (1.0 + np.arange(n) % 3)[c > 0] * c[c > 0]
            assert r["n_drawn"] == len(drawn) and abs(r["mean"] - (w * v[c > 0]).sum() / w.sum()) < 1e-5
            assert np.isclose(r["raw_iqr"], np.subtract(*np.quantile(drawn, [0.75, 0.25])), rtol=1e-12) if len(drawn) >= 4 else r["raw_iqr"] is None
    assert "Generate" not in B.replicate_measures(df, reps)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["percentile_intervals", "trajectory", "stance_with_intervals"])
def test_intervals_make_no_row_for_each_article_and_replicate(spark, name):
    assert "Generate" not in catalogue.queries()[name](spark, DATA)._jdf.queryExecution().toString()


def test_cells_of_a_month_share_one_draw(spark):
    """Counts are drawn once a month, and brackets, wide or too narrow, give what counting whole gives."""
    rng = np.random.default_rng(8)
    n = 3000
    rows = [(i, "2024-01", p, d, None if i % 7 == 3 else float(x), 1.0 + i % 3) for p in M.PARTIES for d in ("q1", "q2") for i, x in enumerate(np.round(rng.lognormal(size=n), 2))]
    df = spark.createDataFrame(rows, "article long, year_month string, party string, dimension string, score double, weight double")
    made = B.cluster_bootstrap(df, 12)
    assert "dimension" not in made._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas [")[1].split("]")[0]
    got = {(r["party"], r["dimension"], r["replicate"]): r for r in made.collect()}
    counts = np.concatenate([c for _, c in B.draws(n, 12, 42, "joint_article_cluster_2024-01")])
    for (p, d, k), r in got.items():
        part = [(x[4], x[5], x[0]) for x in rows if x[2:4] == (p, d) and x[4] is not None]
        s, w, at = (np.array(v) for v in zip(*part))
        c = counts[k, at]
        assert np.isclose(r["mean"], (c * w * s).sum() / (c * w).sum(), rtol=1e-12)
        assert np.isclose(r["raw_iqr"], np.subtract(*np.quantile(np.repeat(s, c), [0.75, 0.25])), rtol=1e-12)
    assert len(got) == 48
    part = pd.DataFrame({"score": s, "weight": w, "at": at})
    narrow, wide = B._Cell(part, 0.0), B._Cell(part)
    (a, b), (x, y) = (c.measured(counts, counts @ c.columns(n)) for c in (narrow, wide))
    assert (a == x).all() and (b == y).all() and (b == B._weighted_iqr(s, counts[:, at])).all()


def test_regression_table_of_a_constant_outcome(spark):
    """An outcome without dispersion has errors of 0, and a constant gap no coefficient; neither is a failure."""
    panel = spark.createDataFrame([(t, float(t * t % 7), 12.0, float(t % 3)) for t in range(12)], "t int, polarization double, rep double, dem double")
    rows = {(r["outcome"], r["term"]): r for r in G.table_ar0(panel).collect()}
    assert len(rows) == 6 and all(rows["rep", k]["standard_error"] == 0 for k in ("intercept", "polarization", "time"))
    assert rows["rep", "intercept"]["t"] == math.inf and math.isnan(rows["rep", "time"]["t"]) and math.isfinite(rows["dem", "time"]["t"])
    flat = G.table_ar0(panel.withColumn("polarization", F.lit(1.0))).collect()
    assert len(flat) == 6 and all(r["estimate"] is None and r["t"] is None for r in flat if r["term"] != "intercept")


def test_quartiles_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(10)
    groups = {"a": rng.lognormal(size=50_000), "ties": np.round(rng.normal(size=40_000), 1), "one": np.full(30_000, 7.0), None: rng.normal(size=5), "single": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "g string, x double").repartition(4)
    got = {r["g"]: r for r in M.group_quartiles(df, ["g"], "x").collect()}
    for k, v in groups.items():
        assert got[k]["n"] == len(v) and np.allclose([got[k]["q25"], got[k]["median"], got[k]["q75"]], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_ingest_operators(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) as publisher").repartition(5).write.parquet(str(tmp_path / "t"))
    rows = M.with_row_numbers(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r["row_no"] for r in rows) == list(range(1000))
    df = spark.createDataFrame([("a", "REP", "success"), ("b", "x", "range_error")], "publisher string, party string, llm_error_type string")
    assert [r["source"] for r in M.with_fallback(M.successful(df), "source", "publisher").collect()] == ["a"] and M.with_fallback(df, "party", "publisher").first()["party"] == "REP"
    assert df.where("publisher = 'a'").select(M.party_or_error(F.col("party"))).first()[0] == "republican"
    with pytest.raises(Exception, match="no party: x"):
        df.select(M.party_or_error(F.col("party"))).collect()
    aligned = M.align(df.select("publisher"), df.where("publisher = 'a'").select("publisher", "party"), ["publisher"]).collect()
    assert {r["publisher"]: r["party"] for r in aligned} == {"a": "REP", "b": None}


def test_contracts(spark):
    df = spark.createDataFrame([("2024-01", 1), ("2024-03", 1)], "year_month string, k int")
    assert [tuple(r) for r in C.calendar_gaps(df, "2024-01", "2024-03").collect()] == [("2024-02", "missing")]
    with pytest.raises(C.ContractError):
        C.assert_unique(df, "k")
    with pytest.raises(C.ContractError):
        C.assert_columns(df, "nope")


def test_text_functions(spark):
    df = spark.createDataFrame([("Sen. Smith met the GOP GOP leaders . Rep. Doe's plan",)], "t string")
    r = df.select(X.mask(F.col("t"), ["GOP"]).alias("m"), X.remove_titles(F.col("t"), ["Sen", "Rep"], ["Senator"]).alias("r"), X.score_error(F.lit('{"q1": "101"}'), ["q1"]).alias("e"), X.score_error(F.lit("[1]"), ["q1"]).alias("j"), X.score_of(F.lit('{"q1": "70"}'), "q1").alias("s")).first()
    assert r["m"].count(X.TOKEN) == 1 and r["r"].startswith("Smith met") and (r["e"], r["j"], r["s"]) == ("range_error", "json_error", 70.0)
    assert X.child_seed(42, "a") != X.child_seed(42, "b") and 0 < X.search_seed(42, "a") < 2**31


def test_catalog_reads_named_tables(spark):
    tables = S.Catalog(spark, DATA, {"nations": "nation.parquet", "zones": "region.parquet"})
    assert tables["nations"].count() == 25 and tables["zones"].count() == 5 and spark.sql("select count(*) from nations").first()[0] == 25
    with pytest.raises(C.ContractError):
        S.read_any(spark, "x.docx")


def test_partial_autocorrelation_equals_yule_walker(spark):
    y = np.random.default_rng(11).normal(size=40).cumsum()
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series string, t int, y double")
    assert np.allclose([r["pacf"] for r in T.partial_autocorrelations(df).orderBy("lag").collect()], T.pacf(y, 6), atol=1e-9)


def test_cleaning_modes(spark):
    df = spark.createDataFrame([("Sen. Ann Lee told the GOP that Kyiv Kyiv needs Governor's office help, said Rep. Joe's aide",)], "t string")
    args = (["Kyiv"], ["Sen", "Rep"], ["Governor"], ["GOP"], ["office"])
    masked, removed = df.select(X.clean(F.col("t"), *args, True), X.clean(F.col("t"), *args, False)).first()
    assert masked == "[ENTITY] told the that [ENTITY] needs office help, said [ENTITY] aide" and removed == "told the that needs office help, said aide"


def test_lists_with_bars(spark):
    df = spark.createDataFrame([([7, 14],), ([],), (None,)], "a array<int>").select(X.pipe_list(F.col("a")).alias("t"))
    assert [r[0] for r in df.collect()] == ["7|14", "", None] and [r[0] for r in df.select(X.from_pipe_list(F.col("t"), "int")).collect()] == [[7, 14], [], None]


def test_reference_tables_and_reports(spark, tmp_path, capsys):
    made = []

    def fetch(path):
        made.append(path)
        Path(path).write_text("first_name,birthday\nAnn,1930-05-05\nBob,1950-01-01\n")

    path = str(tmp_path / "names.csv")
    for _ in range(2):
        old = S.cached_reference(spark, path, fetch)
    assert made == [path] and S.cached_reference(spark, str(tmp_path / "none.csv")) is None
    assert [r["first_name"] for r in S.reference_names(None, old).collect()] == ["Bob"] and S.reference_names(None, None) is None
    with S.tee(str(tmp_path / "report.txt")):
        print("S = 185")
    assert (tmp_path / "report.txt").read_text() == "S = 185\n" == capsys.readouterr().out


def test_translated_headers_and_clean_articles(spark):
    raw = spark.createDataFrame([("1", "T", "812 words", "2024/03/01", "a", None), ("2", "T", "x", "bad", "a", None)], "Nr string, Titel string, Wortzahl string, Datum string, body_1 string, body_2 string")
    df = S.clean_articles(S.translate(raw, {"Nr": "row_index", "Titel": "title", "Wortzahl": "word_count", "Datum": "date", "body_1": "body_1", "body_2": "body_2"}).withColumn("date", F.when(F.col("date").rlike("^[0-9]"), F.col("date"))))
    r = df.collect()
    assert len(r) == 1 and r[0]["word_count"] == 812 and str(r[0]["date"]) == "2024-03-01" and r[0]["body"] == "a"
    with pytest.raises(C.ContractError):
        S.translate(raw, {"nope": "x"})


def test_measurement_run_and_tables(spark, tmp_path):
    from loomstat.plans import publication

    one = publication.measurement_run(spark, DATA, str(tmp_path / "a"), replicates=40)
    two = publication.measurement_run(spark, DATA, str(tmp_path / "b"), replicates=40)
    assert one["run_id"] == two["run_id"] and set(one["outputs"]) == {"replicates", "stance", "polarization", "coherence", "index"} and json.loads((tmp_path / "a" / "run.json").read_text())["run_id"] == one["run_id"]
    assert publication.measurement_run(spark, DATA, str(tmp_path / "c"), replicates=40, seed=1)["run_id"] != one["run_id"]
    text = json.loads(Path(publication.write_tables(spark, DATA, str(tmp_path / "t"), ("s_decomposition", "regimes", "dominance_observed", "candidate_models"))).read_text())
    assert text["regimes"]["header"][0] == "Regime" and text["regimes"]["rows"][0][-1] == "" and len(text) == 4
    assert len(publication.TABLES) == 14 and spark.read.option("header", True).csv(str(tmp_path / "t" / "regimes")).count() == len(text["regimes"]["rows"])


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"one\ntwo ""q""",2\n')
    assert S.read_csv(spark, str(tmp_path / "a.csv"), ("x", "y")).first()["x"] == 'one\ntwo "q"'
    df = spark.range(5)
    table = str(tmp_path / "t")
    assert S.write_if_changed(df, table) and not S.write_if_changed(df.repartition(3), table) and S.read_current(spark, table).count() == 5
    assert S.write_if_changed(spark.range(6), table) and S.read_current(spark, table).count() == 6 and S.write_if_changed(df, table)
    assert sorted(p.name[:2] for p in Path(table).iterdir() if not p.name.startswith(".")) == ["_C", "v-", "v-"]
    with pytest.raises(S.ContractError):
        S.read_current(spark, str(tmp_path / "no"))
    S.write_json_lines(df, str(tmp_path / "j"))
    assert S.read_json_lines(spark, str(tmp_path / "j")).count() == 5
    assert json.loads(Path(tmp_path, "m.json").read_text())["run_id"] == run if (run := S.write_metadata(str(tmp_path / "m.json"), a=1)) else False
    S.reserve_root(str(tmp_path / "out_v1"), str(tmp_path))
    with pytest.raises(FileExistsError):
        S.reserve_root(str(tmp_path / "out_v1"), str(tmp_path))


def test_stream_equals_batch(spark, tmp_path):
    from loomstat.plans.texts import daily_weighted_events
    from loomstat.session import read_table

    read_table(spark, DATA, "events").repartition(3).write.parquet(str(tmp_path / "e"))
    windows.run_to_memory(windows.windowed_mean(windows.event_stream(spark, str(tmp_path / "e"))), "w", checkpoint=str(tmp_path / "c"))
    got = {(str(r["window_start"])[:10], r["event_type"]): (round(r["weighted_mean"], 6), r["n_events"]) for r in spark.table("w").collect()}
    want = {(r["day"], r["event_type"]): (r["weighted_mean"], r["n_events"]) for r in daily_weighted_events(spark, DATA).collect()}
    assert got == want
