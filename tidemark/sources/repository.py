"""Stored datasets: long bars as Parquet versions beside a manifest, universes, fundamentals and downloads.

A dataset is a folder with one subfolder a version and ``manifest.json``, which names the current one. A version is written
whole before the manifest that names it, so readers never see half a table and a failed write changes nothing. Paths may lie
in any store that Spark writes to.
"""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import panels

FIELDS = ("open", "high", "low", "close", "volume")
LONG = "date date, ticker string, " + ", ".join(f"{c} double" for c in FIELDS)


@dataclass(frozen=True)
class Settings:
    """Where data lies, and two conventions."""

    data_dir: str
    trading_days: int = 252
    cost_bps: float = 10.0

    @property
    def cache_dir(self) -> str:
        return f"{self.data_dir}/cache"

    @property
    def universe_dir(self) -> str:
        return f"{self.data_dir}/universe"


def settings(variable: str = "TIDEMARK_DATA") -> Settings:
    """From the environment, else the nearest folder ``data`` above the working one, else one in the home folder."""
    if os.environ.get(variable):
        return Settings(os.environ[variable])
    for folder in (Path.cwd(), *Path.cwd().parents):
        if (folder / "data").is_dir():
            return Settings(str(folder / "data"))
    return Settings(str(Path.home() / ".tidemark"))


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")


@dataclass(frozen=True)
class Manifest:
    universe: str = ""
    source: str = ""
    start: str = ""
    end: str = ""
    n_tickers: int = 0
    n_rows: int = 0
    created_at: str = field(default_factory=_now)
    notes: str = ""
    version: str = ""

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Manifest:
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in known})


class DataRepository:
    """Named datasets of long bars under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest_path(self, name: str) -> str:
        return f"{self.root}/{name}/manifest.json"

    def panel_path(self, name: str) -> str:
        """The current version's folder; FileNotFoundError without one."""
        return f"{self.root}/{name}/{self._manifest(name).version}"

    def has_panel(self, name: str) -> bool:
        fs, p = self._file(self.manifest_path(name))
        return fs.exists(p)

    def load_manifest(self, name: str) -> Manifest | None:
        if not self.has_panel(name):
            return None
        rows = self.spark.read.text(self.manifest_path(name), wholetext=True).collect()
        return Manifest.from_dict(json.loads(rows[0].value))

    def _manifest(self, name: str) -> Manifest:
        found = self.load_manifest(name)
        if found is None:
            raise FileNotFoundError(f"no dataset {name} in {self.root}")
        return found

    def load_long(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.panel_path(name)).select("date", "ticker", *FIELDS)

    def load_panel(self, name: str) -> DataFrame:
        """The dense panel; rows without a price are only padding."""
        return panels.from_long(self.load_long(name))

    def save_panel(self, name: str, bars: DataFrame, **about: str) -> Manifest:
        """Write long bars as a new version and then name it; the versions before stay until vacuum()."""
        version = f"v-{uuid.uuid4().hex}"
        have = [F.col(c).cast("double").alias(c) if c in bars.columns else F.lit(None).cast("double").alias(c) for c in FIELDS]
        bars.select("date", "ticker", *have).withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{self.root}/{name}/{version}")
        s = self.spark.read.parquet(f"{self.root}/{name}/{version}").agg(F.min("date").alias("a"), F.max("date").alias("z"), F.count_distinct("ticker").alias("k"), F.count(F.lit(1)).alias("n")).first()
        manifest = Manifest(start=str(s.a or ""), end=str(s.z or ""), n_tickers=s.k, n_rows=s.n, version=version, **about)
        self._write(self.manifest_path(name), json.dumps(manifest.to_dict(), indent=2))
        return manifest

    def _write(self, path: str, text: str) -> None:
        """Through a file beside it that is then renamed."""
        fs, p = self._file(path)
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(beside)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"{path} can't be written")

    def vacuum(self, name: str) -> int:
        """Delete all versions but the current one."""
        current, n = self._manifest(name).version, 0
        fs, p = self._file(f"{self.root}/{name}")
        for status in fs.listStatus(p):
            if status.isDirectory() and status.getPath().getName() not in (current,):
                fs.delete(status.getPath(), True)
                n += 1
        return n

    def fetch_and_cache(self, name: str, fetch: Fetch, tickers: Sequence[str], start: str, end: str | None = None, benchmark: str | None = None, **about: str) -> tuple[Manifest, DownloadReport]:
        wanted = list(dict.fromkeys([*tickers, *([benchmark] if benchmark else [])]))
        bars, report = PriceDownloader(self.spark, fetch).download(wanted, start, end)
        return self.save_panel(name, bars, notes=f"{report.succeeded} of {report.requested} tickers", **about), report


#: (tickers, start, end) -> long bars with at least date, ticker, close. It runs on executors.
Fetch = Callable[[list[str], str, str | None], pd.DataFrame]


@dataclass(frozen=True)
class DownloadReport:
    requested: int
    succeeded: int
    failed_tickers: list[str]
    rows: int
    start: str
    end: str


def flatten(wide: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Long bars of a table with columns ``<field>|<ticker>`` beside date; rows without a close are dropped."""
    names = names or {f.title(): f for f in FIELDS}
    parts: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if "|" in c:
            a, ticker = c.split("|", 1)
            parts.setdefault(ticker, {})[names.get(a, a.lower())] = c
    rows = [F.struct(F.lit(t).alias("ticker"), *((F.col(f"`{of[f]}`").cast("double") if f in of else F.lit(None).cast("double")).alias(f) for f in FIELDS)) for t, of in sorted(parts.items())]
    return wide.select(F.to_date("date").alias("date"), F.explode(F.array(*rows)).alias("r")).select("date", "r.*").filter(F.col("close").isNotNull() & ~F.isnan("close"))


class PriceDownloader:
    """Fetches tickers in batches, one task each, with retries and growing pauses."""

    def __init__(self, spark: SparkSession, fetch: Fetch, batch: int = 50, retries: int = 3, pause: float = 1.0):
        self.spark, self.fetch, self.batch, self.retries, self.pause = spark, fetch, batch, retries, pause

    def download(self, tickers: Iterable[str], start: str, end: str | None = None) -> tuple[DataFrame, DownloadReport]:
        """(long bars, report). RuntimeError if no ticker at all succeeds."""
        from tidemark.storage import stage

        wanted = list(dict.fromkeys(tickers))
        batches = [wanted[i : i + self.batch] for i in range(0, len(wanted), self.batch)]
        fetch, retries, pause = self.fetch, self.retries, self.pause

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for names in part["tickers"]:
                    for attempt in range(retries):
                        try:
                            got = fetch(list(names), start, end)
                            break
                        except Exception:  # any failure of a source counts as a failed attempt
                            got = None
                            if attempt + 1 < retries:
                                time.sleep(pause * 2**attempt)
                    if got is None or not len(got):
                        continue
                    got = got.reindex(columns=["date", "ticker", *FIELDS])
                    got["date"] = pd.to_datetime(got["date"]).dt.date
                    yield got[got["close"].notna()]

        rows = self.spark.createDataFrame([(b,) for b in batches], "tickers array<string>").repartition(max(1, len(batches)))
        bars = stage(rows.mapInPandas(run, LONG), "download")
        count = {r.ticker: r["count"] for r in bars.groupBy("ticker").count().collect()}  # a row a ticker
        failed = sorted(set(wanted) - count.keys())
        if wanted and not count:
            raise RuntimeError("no ticker could be downloaded")
        return bars, DownloadReport(len(wanted), len(wanted) - len(failed), failed, sum(count.values()), start, end or "")


class Universe:
    """Tickers with sectors: (ticker, sector, sub_industry, date_added)."""

    def __init__(self, members: DataFrame, source: str = ""):
        self.members, self.source = members, source

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> Universe:
        """Names are trimmed, dots become dashes; of a repeated ticker the first row stays; rows without a ticker or sector go."""
        raw = spark.read.option("header", True).csv(path)
        blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
        optional = [(blank(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in ("sub_industry", "date_added")]
        rows = raw.select(F.translate(blank("ticker"), ".", "-").alias("ticker"), blank("sector").alias("sector"), *optional, F.monotonically_increasing_id().alias("_line"))
        rows = rows.filter("ticker is not null and sector is not null").withColumn("_no", F.row_number().over(Window.partitionBy("ticker").orderBy("_line"))).filter("_no = 1")
        return cls(rows.select("ticker", "sector", "sub_industry", F.try_to_timestamp("date_added").cast("date").alias("date_added")), path)

    @classmethod
    def bundled(cls, spark: SparkSession, folders: Sequence[str], name: str, only: Sequence[str] | None = None) -> Universe:
        """The first of ``folders`` that has ``name``.csv; ``only`` restricts it. FileNotFoundError without one."""
        jvm = spark._jvm
        for folder in folders:
            p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.csv")
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                found = cls.from_csv(spark, f"{folder}/{name}.csv")
                return found.restrict(only) if only is not None else found
        raise FileNotFoundError(f"no snapshot {name}.csv in {list(folders)}")

    def restrict(self, tickers: Iterable[str]) -> Universe:
        return Universe(self.members.filter(F.col("ticker").isin(list(tickers))), self.source)

    def contains(self, ticker: str) -> bool:
        return not self.members.filter(F.col("ticker") == ticker).isEmpty()

    def __len__(self) -> int:
        return self.members.count()

    def sector_counts(self) -> DataFrame:
        return self.members.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))

    def by_sector(self) -> DataFrame:
        return self.members.groupBy("sector").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))

    def sector_dummies(self) -> DataFrame:
        """(ticker, one double for each sector)."""
        one = self.members.withColumn("_one", F.lit(1.0)).groupBy("ticker").pivot("sector").agg(F.first("_one"))
        return one.na.fill(0.0)


ITEMS = ("net_income_ttm", "revenue_ttm", "book_equity", "shares")


def trailing_sums(quarters: DataFrame, least: int = 1) -> DataFrame:
    """(ticker, net_income_ttm, revenue_ttm): sums of each ticker's last four quarters, of fewer where there are fewer."""
    last = Window.partitionBy("ticker").orderBy(F.desc("quarter"))
    rows = quarters.withColumn("_no", F.row_number().over(last)).filter("_no <= 4")
    return rows.groupBy("ticker").agg(*(F.when(F.count(c) >= least, F.sum(c)).alias(f"{c}_ttm") for c in ("net_income", "revenue")))


def fundamentals(quarters: DataFrame, equity: DataFrame) -> DataFrame:
    """Snapshot (ticker, *ITEMS) from (ticker, quarter, net_income, revenue) and (ticker, shares, and items of equity).

    Equity is the first known of the further columns, in their order. A ticker needs shares and one of the rest.
    """
    items = [c for c in equity.columns if c not in ("ticker", "shares")]
    rows = equity.select("ticker", F.col("shares").cast("double").alias("shares"), F.coalesce(*(F.col(c).cast("double") for c in items)).alias("book_equity")).join(trailing_sums(quarters), "ticker", "left")
    return rows.filter(F.col("shares").isNotNull() & (F.col("net_income_ttm").isNotNull() | F.col("revenue_ttm").isNotNull() | F.col("book_equity").isNotNull())).select("ticker", *ITEMS)


class FundamentalsRepository:
    """Snapshots of fundamentals, with their date."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, snapshot: DataFrame, date: datetime.date | None = None) -> None:
        day = date or datetime.datetime.now(datetime.timezone.utc).date()
        snapshot.select("ticker", *ITEMS).withColumn("snapshot_date", F.lit(day)).write.mode("append").partitionBy("snapshot_date").parquet(self.path)

    def snapshot_date(self) -> datetime.date | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(self.path).agg(F.max("snapshot_date")).first()[0]

    def load(self) -> DataFrame:
        """The latest snapshot; FileNotFoundError without one."""
        day = self.snapshot_date()
        if day is None:
            raise FileNotFoundError(f"no fundamentals at {self.path}")
        return self.spark.read.parquet(self.path).filter(F.col("snapshot_date") == F.lit(day)).select("ticker", *ITEMS)

    def refresh(self, make: Callable[[], DataFrame], older_than_days: int = 30) -> DataFrame:
        """The stored snapshot, made anew if it is too old."""
        day = self.snapshot_date()
        if day is None or (datetime.datetime.now(datetime.timezone.utc).date() - day).days > older_than_days:
            self.save(make())
        return self.load()
