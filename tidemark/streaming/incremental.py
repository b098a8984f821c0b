"""Incremental refresh of a stored dataset: new days, revisions of the last ones, and whole histories of new tickers."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.repository import FIELDS, DataRepository, Fetch, PriceDownloader


@dataclass(frozen=True)
class UpdateReport:
    dataset: str
    watermark_before: str
    watermark_after: str
    n_rows_before: int
    n_rows_after: int
    new_rows: int
    revised_rows: int
    new_tickers: list[str] = field(default_factory=list)
    dropped_tickers: list[str] = field(default_factory=list)

    @property
    def up_to_date(self) -> bool:
        return self.watermark_after == self.watermark_before

    def to_dict(self) -> dict:
        return asdict(self) | {"up_to_date": self.up_to_date}


def _known(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def revised(old: str, new: str, rtol: float) -> Column:
    """A fresh value that is there and not within ``rtol`` of the stored one."""
    same = F.abs(F.col(new) - F.col(old)) <= rtol * F.abs(F.col(new))
    return _known(new) & (~_known(old) | ~same)


def revisions(stored: DataFrame, fresh: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """(date, ticker) of rows that both have, with a close, where a field was revised."""
    both = stored.select("date", "ticker", *(F.col(c).alias(f"old_{c}") for c in FIELDS)).join(fresh.filter(_known("close")), ["date", "ticker"])
    any_field = revised("old_close", "close", rtol)
    for c in FIELDS:
        any_field = any_field | revised(f"old_{c}", c, rtol)
    return both.filter(any_field).select("date", "ticker")


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows, replaced or joined by fresh ones that have a close; a fresh field that is missing keeps the stored one."""
    both = stored.select("date", "ticker", *FIELDS, F.lit(0).alias("_new")).unionByName(fresh.filter(_known("close")).select("date", "ticker", *FIELDS, F.lit(1).alias("_new")))
    key = Window.partitionBy("date", "ticker")
    whole = key.orderBy("_new").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latest = [F.last(F.when(_known(c), F.col(c)), ignorenulls=True).over(whole).alias(c) for c in FIELDS]
    return both.select("date", "ticker", *latest, F.row_number().over(key.orderBy(F.desc("_new"))).alias("_no")).filter("_no = 1").drop("_no")


class IncrementalUpdater:
    """Watermark, overlap and merge over a repository. What can fail happens before the new version is named."""

    def __init__(self, repository: DataRepository, fetch: Fetch, overlap_days: int = 10, rtol: float = 1e-6, batch: int = 100, pause: float = 1.0):
        self.repository, self.overlap_days, self.rtol = repository, overlap_days, rtol
        self.downloader = PriceDownloader(repository.spark, fetch, batch, pause=pause)

    def update(self, name: str, tickers: Sequence[str] | None = None, end: str | None = None) -> UpdateReport:
        """FileNotFoundError if there is no such dataset. ``tickers``: what it should cover; new ones get their whole history."""
        stored = self.repository.load_long(name)
        s = stored.agg(F.max("date").alias("last"), F.min("date").alias("first"), F.count(F.lit(1)).alias("n")).first()
        have = sorted(r.ticker for r in stored.select("ticker").distinct().collect())  # a row a ticker
        since = s["last"] - datetime.timedelta(days=self.overlap_days)
        fresh, _ = self.downloader.download(have, str(since), end)
        added = sorted(set(tickers or ()) - set(have))
        more = fresh.filter("false")
        if added:
            try:
                more, report = self.downloader.download(added, str(s["first"]), end)
                added = sorted(set(added) - set(report.failed_tickers))
            except RuntimeError:
                added = []
        overlap = stored.filter(F.col("date") >= F.lit(since))
        n_revised = revisions(overlap, fresh.filter(F.col("date") <= F.lit(s["last"])), self.rtol).count()
        n_new = fresh.filter(_known("close") & (F.col("date") > F.lit(s["last"]))).count()
        merged = stored.filter(F.col("date") < F.lit(since)).unionByName(merge(overlap, fresh))
        recent = fresh.filter(F.col("date") >= F.lit(s["last"] - datetime.timedelta(days=14)))
        seen = {r.ticker for r in recent.select("ticker").distinct().collect()}  # a row a ticker
        manifest = self.repository.load_manifest(name)
        about = {"universe": manifest.universe, "source": manifest.source, "notes": "incremental update"}
        manifest = self.repository.save_panel(name, merge(merged, more) if added else merged, **about)
        dropped = sorted(set(have) - seen) if seen and manifest.end == str(s["last"]) else []
        return UpdateReport(name, str(s["last"]), manifest.end, s.n, manifest.n_rows, n_new, n_revised, added, dropped)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over weekly bars: stored up to a watermark without one name, then updated from the whole table."""
    import uuid

    from tidemark.plans import catalog
    from tidemark.storage import shared_root

    bars = catalog.panel(spark, sf_dir, "brand_week").filter("close is not null").select("date", "ticker", *FIELDS)
    repository = DataRepository(spark, f"{shared_root(spark)}/incremental-{uuid.uuid4().hex}")
    repository.save_panel("prices", bars.filter("date <= DATE '1996-06-03' and ticker <> 'Brand#7'"))
    rows = bars.toPandas()  # a week a row and name: what a price service would hold

    def fetch(names, start, end):
        return rows[rows["ticker"].isin(names) & (rows["date"] >= datetime.date.fromisoformat(start))]

    IncrementalUpdater(repository, fetch).update("prices", [*sorted(rows["ticker"].unique())])
    return repository.load_long("prices").select("date", "ticker", F.round("close", 6).alias("close"), F.round("volume", 2).alias("volume"))


def _sql() -> str:
    """What the job must end with: the whole table."""
    from tidemark.functions.dialect import DUCKDB, doubles
    from tidemark.sources.panels import bars_sql, dense_ctes

    return doubles(f"WITH {dense_ctes(DUCKDB, bars_sql('brand_week'))} SELECT date, ticker, round(close, 6) AS close, round(volume, 2) AS volume FROM panel WHERE close IS NOT NULL")


SQL = _sql()
