"""Registered queries of this package, and SQL written by hand for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dialect import DUCKDB, SPARK, doubles
from tidemark.ml import monitoring, training
from tidemark.plans import blocks, catalog
from tidemark.sources import panels
from tidemark.storage import stage

#: Rows of the grid up to which the earlier sample goes.
SPLIT = 308


def _values(spark, sf_dir: str) -> DataFrame:
    """(factor, value, later): all factors after the warm-up, in two samples."""
    views = {"panel": catalog.panel_view(spark, sf_dir, "brand_week")}
    text = f"SELECT factor, value, t > {SPLIT} AS later FROM ({blocks.long_factors(blocks.ALL)}) AS v WHERE t > {blocks.warm()}"
    return stage(catalog.evaluate(spark, text, views), "drift-values")


def psi_query(spark, sf_dir: str) -> DataFrame:
    found = monitoring.psi(_values(spark, sf_dir))
    return found.select("factor", F.round("psi", 6).alias("psi"), monitoring.drift_status(F.col("psi")).alias("status"))


def ks_query(spark, sf_dir: str) -> DataFrame:
    return monitoring.ks_statistic(_values(spark, sf_dir)).select("factor", F.round("ks", 6).alias("ks"))


def drift_query(spark, sf_dir: str) -> DataFrame:
    found = monitoring.feature_drift_table(_values(spark, sf_dir))
    return found.select("factor", *(F.round(c, 5).alias(c) for c in ("psi", "ks", "mean_before", "mean_after")), F.round("shift", 4).alias("shift"), "status")


def rolling_psi_query(spark, sf_dir: str) -> DataFrame:
    views = {"panel": catalog.panel_view(spark, sf_dir, "brand_week")}
    rows = stage(catalog.evaluate(spark, blocks.long_factors(catalog.EVAL), views), "rolling-values")
    return monitoring.rolling_feature_psi(rows, 104, 52).select("date", "factor", F.round("psi", 6).alias("psi"))


def _ic(spark, sf_dir: str) -> DataFrame:
    views = {"panel": catalog.panel_view(spark, sf_dir, "brand_week")}
    return stage(catalog.evaluate(spark, catalog.known_ics(SPARK), views).select("date", "ic"), "ic")


def alerts_query(spark, sf_dir: str) -> DataFrame:
    return monitoring.alerts(monitoring.cusum(_ic(spark, sf_dir))).select("date", "direction", F.round("size", 5).alias("size"))


def report_query(spark, sf_dir: str) -> DataFrame:
    """One model's report as one row of JSON figures."""
    d = monitoring.monitoring_report(_ic(spark, sf_dir), "mom_21").as_dict()
    return spark.createDataFrame([(d["model"], d["n_days"], d["ic_mean"], d["ic_tstat"], d["last_63d_ic"], d["staleness_days"], d["n_alerts"])], "model string, n_days long, ic_mean double, ic_tstat double, last_63d_ic double, staleness_days long, n_alerts long")


_PANEL = panels.dense_ctes(DUCKDB, panels.bars_sql("brand_week"))
_SAMPLE = f"{_PANEL}, v AS MATERIALIZED (SELECT factor, value, t > {SPLIT} AS later FROM ({blocks.long_factors(blocks.ALL)}) AS x WHERE t > 260)"
_PSI = """e AS (SELECT factor, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM v WHERE NOT later GROUP BY factor),
sizes AS (SELECT factor, count(*) FILTER (WHERE NOT later) AS n0, count(*) FILTER (WHERE later) AS n1 FROM v GROUP BY factor),
bins AS (SELECT factor, unnest(generate_series(1, len(edges) - 1)) AS no, edges FROM e),
counted AS (SELECT b.factor, b.no, count(*) FILTER (WHERE NOT v.later) AS c0, count(*) FILTER (WHERE v.later) AS c1 FROM bins AS b JOIN v ON v.factor = b.factor
            AND v.value >= b.edges[b.no] AND (v.value < b.edges[b.no + 1] OR b.no = len(b.edges) - 1 AND v.value = b.edges[b.no + 1]) GROUP BY b.factor, b.no),
parts AS (SELECT b.factor, greatest(coalesce(c.c0, 0) / s.n0, 0.000001) AS r, greatest(coalesce(c.c1, 0) / s.n1, 0.000001) AS a FROM bins AS b JOIN sizes AS s ON s.factor = b.factor LEFT JOIN counted AS c ON c.factor = b.factor AND c.no = b.no),
psi AS (SELECT s.factor, CASE WHEN s.n0 >= 10 AND s.n1 >= 10 THEN CASE WHEN len(e.edges) < 3 THEN 0.0 ELSE (SELECT sum(least(greatest((a - r) * ln(a / r), -25), 25)) FROM parts AS p WHERE p.factor = s.factor) END END AS psi
        FROM sizes AS s LEFT JOIN e ON e.factor = s.factor)"""
_STATUS = "CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"
_KS = """steps AS (SELECT factor, value, sum(CASE WHEN later THEN 0.0 ELSE 1.0 END) AS a, sum(CASE WHEN later THEN 1.0 ELSE 0.0 END) AS z FROM v GROUP BY factor, value),
ks AS (SELECT factor, max(abs(ca / ta - cz / tz)) AS ks FROM (SELECT factor, sum(a) OVER w AS ca, sum(z) OVER w AS cz, sum(a) OVER (PARTITION BY factor) AS ta, sum(z) OVER (PARTITION BY factor) AS tz
       FROM steps WINDOW w AS (PARTITION BY factor ORDER BY value)) AS s GROUP BY factor)"""

SQL = {
    "mon_psi": doubles(f"WITH {_SAMPLE}, {_PSI} SELECT factor, round(psi, 6) AS psi, {_STATUS} AS status FROM psi"),
    "mon_ks": doubles(f"WITH {_SAMPLE}, {_KS} SELECT factor, round(ks, 6) AS ks FROM ks"),
    "mon_drift_table": doubles(f"""WITH {_SAMPLE}, {_PSI}, {_KS}, m AS (SELECT factor, avg(value) FILTER (WHERE NOT later) AS m0, avg(value) FILTER (WHERE later) AS m1, stddev_samp(value) FILTER (WHERE NOT later) AS s0 FROM v GROUP BY factor)
      SELECT psi.factor, round(psi, 5) AS psi, round(ks, 5) AS ks, round(m0, 5) AS mean_before, round(m1, 5) AS mean_after, round((m1 - m0) / nullif(s0, 0), 4) AS shift, {_STATUS} AS status FROM psi JOIN ks USING (factor) JOIN m USING (factor)"""),
}
QUERIES: dict[str, Callable] = training.QUERIES | {
    "mon_psi": psi_query, "mon_ks": ks_query, "mon_drift_table": drift_query, "mon_psi_rolling": rolling_psi_query, "mon_alerts": alerts_query, "mon_report": report_query,
}
__all__ = ["QUERIES", "SQL"]
