import numpy as np
import pandas as pd

from tidemark.operators import risk


def test_style_returns_and_specific_risk(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(60):
        f = rng.normal(size=6)
        for i in range(40):
            z = rng.normal(size=5)
            ret = None if rng.random() < 0.05 else float(f[0] + z @ f[1:] + rng.normal() * 0.1)
            rows.append((f"T{i}", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), t, ret, float(rng.random() + 0.1), *map(float, z)))
    columns = ["ticker", "date", "t", "ret", "w", *(f"z_{s}" for s in risk.STYLES)]
    df = spark.createDataFrame(rows, "ticker string, date date, t int, ret double, w double, " + ", ".join(f"z_{s} double" for s in risk.STYLES))
    got = risk.factor_returns(df)
    found = got.toPandas().set_index("date")
    p = pd.DataFrame(rows, columns=columns)
    p["fit"] = np.nan
    for date, g in p.dropna(subset=columns).groupby("date"):
        x = np.column_stack([np.ones(len(g)), g[columns[5:]]])
        root = np.sqrt(g.w.to_numpy())[:, None]
        b = np.linalg.lstsq(x * root, g.ret.to_numpy() * root[:, 0], rcond=None)[0]
        assert np.allclose(found.loc[date, list(risk.NAMES)].astype(float), b) and found.loc[date, "n"] == len(g)
        p.loc[g.index, "fit"] = x @ b
    p["e"] = p.ret - p.fit
    want = np.sqrt(p.pivot(index="date", columns="ticker", values="e").ewm(halflife=63, min_periods=21).var() * 252)
    have = risk.specific_risk(df, got).toPandas().pivot(index="date", columns="ticker", values="risk")
    assert np.allclose(have.to_numpy(float), want.to_numpy(float), equal_nan=True, rtol=1e-8)
    assert all(r.market is None for r in risk.factor_returns(df, least=41).collect())
