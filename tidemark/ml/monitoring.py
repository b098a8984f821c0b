"""Is a model, or what feeds it, still what it was? Drift of features between two samples, and of an information coefficient."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import cumulative, quantiles

FLOOR, CLIP = 1e-6, 25.0
#: Borders of the bands of drift.
STABLE, MODERATE = 0.10, 0.25


def psi(values: DataFrame, by: Sequence[str] = ("factor",), bins: int = 10) -> DataFrame:
    """(by..., n0, n1, psi) of (by..., value, later): population stability of the later sample against the earlier one.

    Bins are cut at the earlier sample's quantiles, repeated ones once; the last bin is closed. Values outside count in the
    sample's size only. 0 for fewer than three edges; NULL where either sample has fewer than ``bins`` values.
    """
    by = list(by)
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    edges = quantiles(known.filter("not later"), by, "value", [k / bins for k in range(bins + 1)]).select(*by, F.array_distinct("q").alias("edges"))
    sizes = known.groupBy(*by).agg(F.count_if(~F.col("later")).alias("n0"), F.count_if("later").alias("n1"))
    placed = known.join(edges, by).select(*by, "later", F.size("edges").alias("k"), F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("no"), (F.col("value") <= F.element_at("edges", -1)).alias("inside"))
    placed = placed.filter("inside and no > 0").withColumn("no", F.least("no", F.col("k") - 1))
    counts = placed.groupBy(*by, "no", "k").agg(F.count_if(~F.col("later")).alias("c0"), F.count_if("later").alias("c1")).join(sizes, by)
    e, a = (F.greatest(F.col(f"c{i}") / F.greatest(F.col(f"n{i}"), F.lit(1)), F.lit(FLOOR)) for i in (0, 1))
    part = F.least(F.greatest((a - e) * F.log(a / e), F.lit(-CLIP)), F.lit(CLIP))
    found = counts.groupBy(*by).agg(F.sum(part).alias("total"), F.max("k").alias("k"))
    out = sizes.join(found, by, "left")
    value = F.when((F.col("n0") >= bins) & (F.col("n1") >= bins), F.when(F.coalesce("k", F.lit(0)) < 3, 0.0).otherwise(F.col("total")))
    return out.select(*by, "n0", "n1", value.alias("psi"))


def ks_statistic(values: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    """(by..., ks): the largest gap of the two samples' distributions; NULL where one has fewer than two values."""
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    sums = cumulative(known, list(by), "value", {"a": (~F.col("later")).cast("int"), "z": F.col("later").cast("int")})
    gap = F.abs(F.try_divide("a", "a_total") - F.try_divide("z", "z_total"))
    enough = (F.max("a_total") >= 2) & (F.max("z_total") >= 2)
    return sums.groupBy(*by).agg(F.when(enough, F.max(gap)).alias("ks"))


def drift_status(psi: Column) -> Column:
    known = psi.isNotNull() & ~F.isnan(psi)
    return F.when(~known, "unknown").when(psi < STABLE, "stable").when(psi < MODERATE, "moderate").otherwise("significant")


def feature_drift_table(values: DataFrame, bins: int = 10) -> DataFrame:
    """(factor, psi, status, ks, mean_before, mean_after, shift in deviations of the earlier sample), most drift first."""
    means = values.groupBy("factor").agg(
        F.avg(F.expr("CASE WHEN NOT later THEN value END")).alias("mean_before"),
        F.avg(F.expr("CASE WHEN later THEN value END")).alias("mean_after"),
        F.stddev_samp(F.expr("CASE WHEN NOT later THEN value END")).alias("sd"),
    )
    out = psi(values, bins=bins).join(ks_statistic(values), "factor").join(means, "factor")
    shift = F.try_divide(F.col("mean_after") - F.col("mean_before"), F.col("sd"))
    return out.select("factor", "psi", drift_status(F.col("psi")).alias("status"), "ks", "mean_before", "mean_after", shift.alias("shift")).orderBy(F.desc_nulls_last("psi"), "factor")


def rolling_feature_psi(features: DataFrame, window: int = 252, step: int = 63, bins: int = 10, label: str = "start") -> DataFrame:
    """(date, factor, psi) every ``step`` dates: the ``window`` dates from a date on against the ``window`` before it.

    ``features``: (date, ticker, factor, value). The label is the date that parts the two samples, or with ``end`` the last
    date used, which is when the figure can be known. ValueError for fewer than two windows of dates.
    """
    days = features.select("date").distinct()
    n = days.count()
    if n < 2 * window:
        raise ValueError(f"rolling drift needs {2 * window} dates or more, not {n}")
    order = Window.orderBy("date")
    numbered = days.select("date", (F.row_number().over(order) - 1).alias("i"))  # dates only
    starts = numbered.filter((F.col("i") >= window) & (F.col("i") <= n - window) & ((F.col("i") - window) % step == 0)).select(F.col("i").alias("at"))
    used = numbered.join(F.broadcast(starts), (F.col("i") >= F.col("at") - window) & (F.col("i") < F.col("at") + window))
    rows = features.join(F.broadcast(used), "date").select("at", "factor", "value", (F.col("i") >= F.col("at")).alias("later"))
    shown = F.col("at") + (window - 1 if label == "end" else 0)
    found = psi(rows, ("at", "factor"), bins).withColumn("i", shown)
    return found.join(F.broadcast(numbered), "i").select("date", "factor", "psi")


def rolling_ic(ic: DataFrame, window: int = 63) -> DataFrame:
    """(date, mean, std, se, lower, upper, t) of (date, ic) over the last ``window`` dates, half of them at least."""
    w = Window.orderBy("date").rowsBetween(1 - window, 0)  # one row a date
    enough = F.count("ic").over(w) >= window // 2
    s = ic.select("date", F.when(enough, F.avg("ic").over(w)).alias("mean"), F.when(enough, F.stddev_samp("ic").over(w)).alias("std"))
    s = s.withColumn("se", F.col("std") / math.sqrt(window))
    return s.select("*", (F.col("mean") - 1.96 * F.col("se")).alias("lower"), (F.col("mean") + 1.96 * F.col("se")).alias("upper"), F.try_divide("mean", "se").alias("t"))


def cusum(ic: DataFrame, slack: float = 0.25, threshold: float = 2.0) -> DataFrame:
    """(date, z, pos, neg, alarm): two-sided cumulative sums, in closed form: a running sum less its running minimum."""
    whole = Window.partitionBy(F.lit(1))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = ic.filter("ic is not null")
    z = known.select("date", F.coalesce(F.try_divide(F.col("ic") - F.avg("ic").over(whole), F.stddev_samp("ic").over(whole)), F.lit(0.0)).alias("z"))
    sums = z.select("date", "z", F.sum(F.col("z") - slack).over(run).alias("up"), F.sum(-F.col("z") - slack).over(run).alias("down"))
    out = sums.select("date", "z", *((F.col(c) - F.least(F.lit(0.0), F.min(c).over(run))).alias(n) for c, n in (("up", "pos"), ("down", "neg"))))
    return out.withColumn("alarm", (F.col("pos") > threshold) | (F.col("neg") > threshold))


def alerts(chart: DataFrame) -> DataFrame:
    """(date, direction, size): where an alarm begins."""
    before = F.lag("alarm", 1, False).over(Window.orderBy("date"))
    begun = chart.withColumn("before", before).filter("alarm and not before")
    lost = F.col("neg") > F.col("pos")
    return begun.select("date", F.when(lost, "skill_loss").otherwise("skill_gain").alias("direction"), F.greatest("pos", "neg").alias("size"))


def regimes(ic: DataFrame, n: int = 6, least: int = 60) -> DataFrame:
    """(regime, start, end, n_days, mean, t, positive) of ``n`` stretches of dates; ValueError for fewer than ``least``."""
    known = ic.filter("ic is not null")
    days = known.count()
    if days < least:
        raise ValueError(f"regimes need {least} dates or more, not {days}")
    parts = known.withColumn("regime", F.ntile(n).over(Window.orderBy("date")))
    t = F.try_divide(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count("ic")))
    return parts.groupBy("regime").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("ic").alias("n_days"), F.avg("ic").alias("mean"), t.alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


@dataclass(frozen=True)
class DriftAlert:
    date: datetime.date
    direction: str
    size: float


@dataclass(frozen=True)
class MonitoringReport:
    model: str
    n_days: int
    ic_mean: float
    ic_tstat: float | None
    last_63d_ic: float
    staleness_days: int
    alerts: list[DriftAlert] = field(default_factory=list)
    regimes: list[dict] = field(default_factory=list)

    def as_dict(self) -> dict:
        shown = {k: getattr(self, k) for k in ("model", "n_days", "staleness_days")}
        shown |= {k: None if getattr(self, k) is None else round(getattr(self, k), d) for k, d in (("ic_mean", 4), ("ic_tstat", 2), ("last_63d_ic", 4))}
        shown["n_alerts"] = len(self.alerts)
        shown["alerts"] = [{"date": str(a.date), "direction": a.direction, "cusum": round(a.size, 2)} for a in self.alerts]
        shown["regimes"] = [{k: str(v) if k in ("start", "end") else v if v is None or isinstance(v, int) else round(v, 4) for k, v in r.items()} for r in self.regimes]
        return shown


def monitoring_report(ic: DataFrame, model: str = "model", as_of: datetime.date | None = None) -> MonitoringReport:
    """Everything about one model's (date, ic), up to ``as_of``; ValueError for fewer than 30 dates. Staleness in calendar days."""
    known = ic.filter("ic is not null").select("date", "ic")
    if as_of is not None:
        known = known.filter(F.col("date") <= F.lit(as_of))
    recent = known.withColumn("no", F.row_number().over(Window.orderBy(F.desc("date"))))
    s = recent.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.max("date").alias("last"), F.avg(F.when(F.col("no") <= 63, F.col("ic"))).alias("late")).first()
    if s.n < 30:
        raise ValueError(f"a report needs 30 dates or more, not {s.n}")
    found = [DriftAlert(r.date, r.direction, r["size"]) for r in alerts(cusum(known)).orderBy("date").collect()]  # dates only
    parts = [r.asDict() for r in regimes(known).orderBy("regime").collect()] if s.n >= 60 else []
    return MonitoringReport(model, s.n, s["mean"], s["mean"] / (s.sd / math.sqrt(s.n)) if s.sd else None, s.late, ((as_of or s["last"]) - s["last"]).days, found, parts)
