import numpy as np
import pandas as pd
import pytest

from barwright.operators import series, tuning


@pytest.fixture(scope="module")
def steps(spark):
    rng = np.random.default_rng(1)
    close = np.r_[rng.normal(50, 1, 150), rng.normal(70, 1, 150), rng.normal(40, 1, 150)]
    pdf = pd.DataFrame({"symbol": "A", "ts": range(450), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0})
    return spark.createDataFrame(pdf)


def test_change_points_find_steps(steps):
    out = series.change_points(steps).orderBy("ts").toPandas()
    assert list(out.ts[out.is_change == 1]) == [150, 300]


def test_spectrum_matches_transform(steps):
    out = series.spectrum(steps).orderBy("ts").toPandas()
    amp = np.abs(np.fft.rfft(out.close[100:200]))
    share = amp**2 / (amp**2).sum()
    assert out.spectral_entropy[200] == pytest.approx(-(share * np.log2(share)).sum())
    assert out.spectral_entropy[:100].isna().all() and (out.dominant_freq[:100] == 0).all()


def test_wavelet_energies_are_shares(steps):
    out = series.wavelet(steps).toPandas()
    total = sum(out[f"wavelet_energy_level_{i}"].iloc[0] for i in range(1, 6))
    assert 0 < total <= 1


def test_hidden_states_are_ordered(steps):
    out = series.hidden_states(steps, 2).toPandas()
    assert set(out.regime_hmm) <= {0.0, 1.0}


def test_studies_round_trip(spark, tmp_path):
    space = [tuning.ParamSpec("max_depth", 2, 6, integer=True), tuning.ParamSpec("num_leaves", 8, 256, log=True, integer=True), tuning.ParamSpec("min_leaf", 1, 50)]
    found = tuning.suggest(space, 12)
    assert found == tuning.suggest(space, 12)
    assert all(p["num_leaves"] <= 2 ** p["max_depth"] and p["min_leaf"] >= 10 for p in found)
    trials = tuning.optimize(spark, "s", found, lambda p: -p["min_leaf"])
    tuning.save_study(trials, str(tmp_path / "study"))
    again = tuning.load_study(spark, str(tmp_path / "study"), "s")
    assert tuning.warm_start(again) == found
    assert tuning.history(again).orderBy("trial_id").toPandas()["best"].is_monotonic_increasing
    told = tuning.meta_knowledge(again).toPandas().set_index("param")
    assert told.correlation["min_leaf"] == pytest.approx(-1)


def test_median_pruning(spark):
    rows = [(t, s, float(t)) for t in range(8) for s in range(3)] + [(8, s, 0.5) for s in range(3)]
    out = tuning.median_pruned(spark.createDataFrame(rows, "trial_id long, step int, score double")).toPandas()
    assert list(out[out.prune].trial_id.unique()) == [8]


def test_fits(spark, steps, tmp_path):
    from barwright.operators import fits

    out = fits.garch(steps).toPandas()
    assert out.garch_vol.gt(0).all() and out.garch_alpha.iloc[0] + out.garch_beta.iloc[0] < 1
    pca = fits.rolling_pca(steps, ["open", "high", "low", "close", "volume"]).orderBy("ts").toPandas()
    assert pca.pca_component_1[:100].isna().all() and pca.pca_exp_var_ratio_1[100:].between(0, 1.0001).all()
    box = fits.box_cox(steps, "close").toPandas()
    assert box.box_cox_lambda.between(-2, 2).all() and box.box_cox_close.notna().all()
    text = fits.report("Report", {"kpss": fits.kpss(steps)}, str(tmp_path / "r.txt"))
    assert "kpss_stat" in text and (tmp_path / "r.txt").read_text() == text
