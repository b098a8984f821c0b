"""Panels: bars derived from trades, the dense grid, and long Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.dialect import Dialect, trailing

#: What a panel's bars are made of: ticker, date and sector expressions over lineitem joined with its dimensions.
KINDS = {
    "brand_week": ("p_brand", "CAST(date_trunc('week', l_shipdate) AS DATE)", "lineitem JOIN part ON l_partkey = p_partkey", "brand"),
    "supp_week": ("CAST(l_suppkey AS VARCHAR(20))", "CAST(date_trunc('week', l_shipdate) AS DATE)", "lineitem", "none"),
    "nation_day": ("n_name", "CAST(l_shipdate AS DATE)", "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey", "none"),
}


#: Bars as two books report them, by nation, day and line status: where both traded, a (ticker, date) comes twice.
FEED = """SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, CAST(l_shipdate AS DATE), l_linestatus"""


def bars_sql(kind: str) -> str:
    ticker, date, source, _ = KINDS[kind]
    return f"""SELECT {ticker} AS ticker, {date} AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
FROM {source} GROUP BY {ticker}, {date}"""


def dense_ctes(d: Dialect, bars: str) -> str:
    """CTEs from bars to the table ``panel``: every date of the grid for every ticker, numbered by t."""
    return f"""bars AS ({bars}),
dates AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS t FROM (SELECT DISTINCT date FROM bars) AS x),
names AS (SELECT DISTINCT ticker FROM bars),
grid AS (SELECT names.ticker, dates.date, dates.t, bars.high, bars.low, bars.close, bars.volume
         FROM dates CROSS JOIN names LEFT JOIN bars ON bars.ticker = names.ticker AND bars.date = dates.date),
filled AS (SELECT *, {d.last_known('close', trailing(None))} AS ff FROM grid),
panel AS (SELECT ticker, date, t,
                 CASE WHEN close IS NOT NULL THEN coalesce(lag(ff, 1) OVER (PARTITION BY ticker ORDER BY t), close) END AS open,
                 high, low, close, volume, ff,
                 ff / nullif(lag(ff, 1) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS ret, close * volume AS dv FROM filled)"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names or ("lineitem", "part", "supplier", "nation", "region", "orders", "customer", "events"):
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def from_long(df: DataFrame) -> DataFrame:
    """A dense panel of long bars (date, ticker, close, and open, high, low, volume where present).

    ValueError if a (date, ticker) occurs twice. Missing columns are NULL; NaN is read as NULL.
    """
    from pyspark.sql import functions as F

    from tidemark.functions.dialect import SPARK

    for c in ("date", "ticker", "close"):
        if c not in df.columns:
            raise ValueError(f"bars need a column {c}")
    columns = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if c in df.columns else F.lit(None).cast("double") for c in ("high", "low", "close", "volume")}
    bars = df.select("date", "ticker", *(e.alias(c) for c, e in columns.items()))
    if not bars.groupBy("date", "ticker").count().filter("count > 1").isEmpty():
        raise ValueError("bars have several rows for one date and ticker")
    return df.sparkSession.sql(f"WITH {dense_ctes(SPARK, 'SELECT * FROM {bars}')} SELECT * FROM panel", bars=bars)


def to_parquet(panel: DataFrame, path: str) -> None:
    """Long bars, snappy, by year; rows without a price are kept."""
    from pyspark.sql import functions as F

    panel.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)
