import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import scenarios
from creditloom.operators.scenarios import PATH_SCENARIOS, PEAK_SCENARIOS

SCORE = scenarios.logistic_scorer(-4.0, {"ur_3m_lag": 0.2, "hpi_change": 1.0, "loan_age": 0.01})


@pytest.fixture(scope="module")
def loans(spark):
    return spark.createDataFrame([(i, 10.0 * i, 100_000.0 + i, 4.0, 1.0) for i in range(20)], "id int, loan_age double, orig_upb double, ur_3m_lag double, hpi_change double")


def paths(spark, table=PATH_SCENARIOS, rate=4.0, **kw):
    return scenarios.macro_paths(spark.createDataFrame([(rate,)], "rate double"), table, **kw)


def test_floors_and_final_levels(spark):
    p = {(r["scenario"], r["quarter"]): r for r in paths(spark).collect()}
    assert len(p) == 63
    assert p[("Adverse", 20)]["ur"] == 4.5 and p[("Severe", 20)]["ur"] == 5.4 and p[("Severe", 6)]["ur"] == 10.0
    low = {(r["scenario"], r["quarter"]): r["ur"] for r in paths(spark, rate=0.0).collect()}
    assert low[("Base", 1)] == 0.5
    peak = {(r["scenario"], r["quarter"]): r["ur"] for r in paths(spark, PEAK_SCENARIOS, rate=-1.0, floor_state=False).collect()}
    assert peak[("Adverse", 0)] == -1.0 and peak[("Adverse", 1)] == 0.5 and abs(peak[("Adverse", 2)] - 0.8) < 1e-12


def test_model_route_equals_closed_form(spark, loans):
    p = paths(spark)
    predict = lambda df: df.withColumn("pd", F.expr(SCORE({})))
    a = scenarios.path_ecl(scenarios.attach_path_pds(loans, p, SCORE), PATH_SCENARIOS, ["id"]).orderBy("id").toPandas()
    b = scenarios.path_ecl(scenarios.model_path_pds(loans, p, predict, ["id"]), PATH_SCENARIOS, ["id"]).orderBy("id").toPandas()
    assert np.allclose(a, b[a.columns], rtol=1e-12)
    q = scenarios.peak_quarters(paths(spark, PEAK_SCENARIOS, floor_state=False))
    c = scenarios.scenario_pds(loans, q, SCORE, ["id", "ur_3m_lag"]).orderBy("id").toPandas()
    d = scenarios.model_scenario_pds(loans, q, predict, ["id", "ur_3m_lag"]).orderBy("id").toPandas()
    assert np.allclose(c, d[c.columns], rtol=1e-12) and (c.pd_severe > c.pd_base).all()
    e, f = scenarios.sensitivity(loans, SCORE).toPandas(), scenarios.model_sensitivity(loans, predict).toPandas()
    assert np.allclose(e.delta_pd_pp, f.delta_pd_pp, rtol=1e-9) and (e.delta_pd_pp > 0).all()


def test_losses_by_hand_and_monotone(spark, loans):
    e = scenarios.path_ecl(loans.withColumns({f"pds_{s.name.lower()}": F.array(*[F.lit(0.1)] * 20) for s in PATH_SCENARIOS}), PATH_SCENARIOS, ["id"])
    r = e.filter("id = 0").first()
    for h, name in ((4, "1Y"), (8, "2Y"), (12, "3Y"), (20, "5Y")):
        want = sum(0.1 * 0.9 ** (q - 1) * 0.4 * 100_000 / 1.05 ** (q / 4) for q in range(1, h + 1))
        assert abs(r[f"ecl_base_{name}"] - want) < 1e-6
    assert r["ecl_base_1Y"] <= r["ecl_base_2Y"] <= r["ecl_base_3Y"] <= r["ecl_base_5Y"]


def test_losses_of_short_empty_and_missing_paths(spark):
    whole = [0.1 + 0.01 * q for q in range(20)]
    paths = [whole, whole[:6], [], None, [*whole[:9], None, *whole[10:]], [0.2, 1.0, *whole[2:]]]
    df = spark.createDataFrame([(i, 1000.0, p, p, p) for i, p in enumerate(paths)], "id int, orig_upb double, pds_base array<double>, pds_adverse array<double>, pds_severe array<double>")
    out = scenarios.path_ecl(df.repartition(2), PATH_SCENARIOS, ["id"])
    got = {r["id"]: r for r in out.collect()}
    for i, p in enumerate(paths):
        for h, name in ((4, "1Y"), (8, "2Y"), (12, "3Y"), (20, "5Y")):
            alive, want = 1.0, 0.0
            for q, x in enumerate((p or [])[:h], 1):
                want, alive = (None, None) if x is None or want is None else (want + x * alive * 1.05 ** (-q / 4), alive * (1 - x))
            for s in ("base", "adverse", "severe"):
                value = got[i][f"ecl_{s}_{name}"]
                assert value is None if want is None else abs(value - want * 0.4 * 1000) < 1e-9, (i, name)
    # a chain of conditions for each quarter is too long for compiled code
    assert out._jdf.queryExecution().executedPlan().toString().count("get(") < 20


def test_certain_default_leaves_nobody_alive(spark):
    df = spark.createDataFrame([(1, "Base", q, p) for q, p in ((1, 0.0), (2, 1.0), (3, 0.5))], "id int, scenario string, quarter int, pd double")
    got = {r["quarter"]: (r["alive_before"], r["alive"]) for r in scenarios.survival_window(df, ["id"]).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, 0.0), 3: (0.0, 0.0)}


def test_projection_is_narrow(spark, loans):
    plan = scenarios.path_ecl(scenarios.attach_path_pds(loans, paths(spark), SCORE), PATH_SCENARIOS, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_mean_paths_of_arrays_need_no_fan_out(spark):
    rng = np.random.default_rng(2)
    pds = [[*map(float, rng.random(20))] for _ in range(7)]
    pds[2][0], pds[3][2] = 1.0, 0.0
    rows = [(i, *[pds[(i + k) % 7] if (i, k) != (5, 1) else None for k in range(3)]) for i in range(7)]
    df = spark.createDataFrame(rows, "id int, pds_base array<double>, pds_adverse array<double>, pds_severe array<double>").repartition(3)
    want = scenarios.mean_paths(scenarios.long_paths(df, PATH_SCENARIOS, ["id"])).orderBy("scenario", "quarter").toPandas()
    mean = scenarios.mean_array_paths(df, PATH_SCENARIOS)
    got = mean.orderBy("scenario", "quarter").toPandas()
    assert len(got) == 60 and got.dtypes.equals(want.dtypes) and list(got.columns) == list(want.columns)
    assert (got.scenario == want.scenario).all() and np.allclose(got.iloc[:, 1:], want.iloc[:, 1:], rtol=1e-12)
    assert "Generate" not in mean._jdf.queryExecution().executedPlan().toString()
    assert scenarios.mean_array_paths(df.limit(0), PATH_SCENARIOS).count() == 0
