import itertools

import numpy as np
import pandas as pd

from creditloom.operators import survival
from creditloom.session import fresh_path


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(20 / np.exp(0.8 * x[:, 0] - 0.4 * x[:, 1]))).clip(1, 60).astype(int)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "duration": t, "event": (rng.random(n) < 0.7).astype(int), "risk": np.round(x[:, 0], 1)})


def efron(pdf, beta, penalizer):
    z = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std()
    eta, total = z.to_numpy() @ beta, 0.0
    for t in pdf.loc[pdf.event == 1, "duration"].unique():
        dead = ((pdf.duration == t) & (pdf.event == 1)).to_numpy()
        risk, tied, d = np.exp(eta[(pdf.duration >= t).to_numpy()]).sum(), np.exp(eta[dead]).sum(), dead.sum()
        total += eta[dead].sum() - sum(np.log(risk - k / d * tied) for k in range(d))
    return total - penalizer / 2 * len(pdf) * beta @ beta


def test_cox_is_the_maximum_of_the_penalised_likelihood(spark):
    pdf = sample()
    m = survival.fit_cox(spark.createDataFrame(pdf), ["a", "b"], penalizer=0.1)
    beta = m.coef * m.scales
    best = efron(pdf, beta, 0.1)
    assert abs(best - m.log_likelihood) < 1e-6 * abs(best)
    for step in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert efron(pdf, beta + np.array(step), 0.1) <= best + 1e-9
    free = survival.fit_cox(spark.createDataFrame(sample(4000, 5)), ["a", "b"], penalizer=0.0)
    assert abs(free.coef[0] - 0.8) < 0.12 and abs(free.coef[1] + 0.4) < 0.12
    pds = survival.horizon_pds(free, spark.createDataFrame(pdf.assign(loan_seq_num=range(len(pdf)))), (12, 24)).toPandas()
    assert (pds.pd_24m >= pds.pd_12m).all() and pds.pd_12m.between(0, 1).all()


def test_tie_sums_agree_for_many_ties():
    direct = survival._tie_sums(20_000, 50_000.5)
    u = 50_000.5 - np.arange(20_001)
    more = survival._tie_sums(20_001, 50_000.5)
    assert abs(more[1] - (1 / u).sum()) < 1e-9 and abs(more[3] - (1 / u**2).sum()) < 1e-9 and abs(more[0] - np.log(u).sum()) < 1e-5
    assert more[1] > direct[1]


def test_concordance_by_pairs(spark, monkeypatch):
    pdf = sample(250)
    won = pairs = 0.0
    for i, j in itertools.permutations(range(len(pdf)), 2):
        a, b = pdf.iloc[i], pdf.iloc[j]
        if a.event == 1 and (a.duration < b.duration or (a.duration == b.duration and b.event == 0)):
            pairs += 1
            won += 1.0 if a.risk > b.risk else 0.5 if a.risk == b.risk else 0.0
    for durations, places in ((2048, 1 << 21), (7, 5)):  # one range of durations, many
        monkeypatch.setattr(survival, "DURATIONS", durations)
        monkeypatch.setattr(survival, "PLACES", places)
        r = survival.concordance_index(spark.createDataFrame(pdf), "risk").first()
        assert r["n_pairs"] == pairs and abs(r["c_index"] - won / pairs) < 1e-12


def test_survival_without_censoring_is_one_minus_ecdf(spark):
    pdf = sample().assign(event=1, g="x")
    km = survival.kaplan_meier(spark.createDataFrame(pdf), ["g"]).toPandas().sort_values("duration")
    for t, s in zip(km.duration, km.survival):
        assert abs(s - (pdf.duration > t).mean()) < 1e-12


def test_concordance_of_long_durations(spark):
    rows = spark.createDataFrame([(0.9, 500, 1), (0.1, 600, 1), (0.95, 10, 1), (0.5, 400, 0)], "risk double, duration int, event int")
    assert survival.concordance_index(rows, "risk").first()["n_pairs"] == 4


def test_concordance_of_unrounded_risks_in_groups(spark, monkeypatch):
    monkeypatch.setattr(survival, "DURATIONS", 100)
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "risk": rng.normal(size=n), "duration": rng.integers(1, 1_000_000, n), "event": rng.integers(0, 2, n)})
    pdf.loc[::7, "duration"] = 500
    got = {r["g"]: r for r in survival.concordance_index(spark.createDataFrame(pdf), "risk", ["g"]).collect()}
    for g, own in pdf.groupby("g"):
        d, e, r = own.duration.to_numpy(), own.event.to_numpy(), own.risk.to_numpy()
        comparable = (e[:, None] == 1) & ((d[:, None] < d[None]) | ((d[:, None] == d[None]) & (e[None] == 0)))
        won = (comparable * ((r[:, None] > r[None]) + 0.5 * (r[:, None] == r[None]))).sum()
        assert got[g]["n_pairs"] == comparable.sum() and abs(got[g]["c_index"] - won / comparable.sum()) < 1e-12


def test_cox_of_long_durations_and_its_artefact(spark, monkeypatch):
    monkeypatch.setattr(survival, "COX_RANGES", 5)
    pdf = sample()
    wide = pdf.assign(duration=pdf.duration * 50_000)
    a, b = (survival.fit_cox(spark.createDataFrame(p), ["a", "b"]) for p in (pdf, wide))
    assert np.allclose(a.coef, b.coef, atol=1e-12) and np.allclose(a.cumulative_hazards([12, 24]), b.cumulative_hazards([600_000, 1_200_000]), atol=1e-12)
    back = survival.CoxArtefact.load(survival.CoxArtefact(a).save(fresh_path(spark, "cox"))).model
    assert np.array_equal(back.coef, a.coef) and back.cumulative_hazards([5, 60]) == a.cumulative_hazards([5, 60])
    # residuals of each covariate at the maximum add up to the penalty's pull
    r = survival.schoenfeld_residuals(b, spark.createDataFrame(wide)).groupBy("feature").sum("residual").collect()
    assert len(r) == 2


def plain_log_rank(pdf):
    groups = sorted(pdf.g.unique())
    oe, v = np.zeros(len(groups)), np.zeros((len(groups), len(groups)))
    for t in sorted(pdf.duration.unique()):
        at = pdf[pdf.duration >= t]
        n, d = len(at), ((at.duration == t) & (at.event == 1)).sum()
        share = np.array([(at.g == g).sum() / n for g in groups])
        oe += np.array([((at.g == g) & (at.duration == t) & (at.event == 1)).sum() for g in groups]) - d * share
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(share) - np.outer(share, share))
    k = len(groups) - 1
    return len(groups), float(oe[:k] @ np.linalg.pinv(v[:k, :k]) @ oe[:k])


def test_log_rank_of_many_groups_and_long_durations(spark):
    rng = np.random.default_rng(0)
    for groups, longest in ((3, 125_000), (2, 40), (201, 900)):
        pdf = pd.DataFrame({"g": [f"g{i % groups:03d}" for i in range(420)], "duration": rng.integers(1, longest, 420), "event": rng.integers(0, 2, 420)})
        got = survival.log_rank(spark.createDataFrame(pdf), "g", max_t=None).first()
        n, stat = plain_log_rank(pdf)
        assert got["n_groups"] == n and got["dof"] == n - 1 and abs(got["statistic"] - stat) < 1e-6 * max(1.0, stat)


def test_log_rank_of_five_thousand_groups(spark):
    """All durations equal but for one early death in some groups: a closed form for the statistic."""
    k = 5001
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": [f"g{i % k:04d}" for i in range(2 * k)], "duration": rng.integers(1, 4, 2 * k), "event": (rng.random(2 * k) < 0.4).astype(int)})
    got = survival.log_rank(spark.createDataFrame(pdf), "g", max_t=None).first()
    n, stat = plain_log_rank_by_sums(pdf)
    assert got["n_groups"] == n == k and abs(got["statistic"] - stat) < 1e-6 * stat


def plain_log_rank_by_sums(pdf):
    names, at = np.unique(pdf.g, return_inverse=True)
    k = len(names)
    oe, v = np.zeros(k), np.zeros((k, k))
    for t in sorted(pdf.duration.unique()):
        risk = np.bincount(at[pdf.duration >= t], minlength=k).astype(float)
        dead = np.bincount(at[(pdf.duration == t) & (pdf.event == 1)], minlength=k).astype(float)
        n, d, share = risk.sum(), dead.sum(), risk / risk.sum()
        oe += dead - d * share
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(share) - np.outer(share, share))
    return k, float(oe[:-1] @ np.linalg.solve(v[:-1, :-1], oe[:-1]))
