"""User functions in Python: vectorised scalar, grouped and table functions. Each also has a form in SQL, which the tests hold it against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans.registry import query
from ..session import load


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_returnflag = 'R'")
def p80_scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def charge(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
        return price * (1 - discount) * (1 + tax)

    lines = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return lines.select("l_orderkey", "l_linenumber", charge("l_extendedprice", "l_discount", "l_tax").alias("charge"))


@query("SELECT event_type, round(exp(avg(ln(1 + abs(value)))) - 1, 6) AS geometric FROM events GROUP BY event_type")
def p80_aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean in two steps: Arrow batches give partial sums, which are then added, so no group must fit in one task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            logs = np.log1p(pdf["value"].abs()).groupby(pdf["event_type"])
            yield pd.DataFrame({"event_type": list(logs.groups), "total": logs.sum().to_numpy(), "n": logs.count().to_numpy()})

    parts = load(spark, sf_dir, "events").select("event_type", "value").mapInPandas(partial, "event_type string, total double, n long")
    return parts.groupBy("event_type").agg(F.round(F.exp(F.sum("total") / F.sum("n")) - 1, 6).alias("geometric"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, unnest(string_split(s_name, '#')) AS word FROM supplier")
def p80_table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for word in (text or "").split("#"):
                yield (word,)

    s = load(spark, sf_dir, "supplier")
    return s.lateralJoin(Words(F.col("s_name").outer())).select("s_suppkey", "word")


@query("SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, round(max(value) - min(value), 6) AS spread FROM events GROUP BY ALL")
def p80_grouped_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped-aggregate Arrow function: no Series is made for a group. Its values are one array in one task, so it is for groups that stay small: here a user's day."""

    @F.arrow_udf("double")
    def spread(values: pa.Array) -> float:
        ends = pa.compute.min_max(values).as_py()
        return None if ends["max"] is None else ends["max"] - ends["min"]

    events = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return events.groupBy("user_id", "day").agg(F.round(spread("value"), 6).alias("spread"))


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier")
def p80_arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("double")
    def doubled(values: pa.Array) -> pa.Array:
        return pa.compute.multiply(values, 2.0)

    return load(spark, sf_dir, "supplier").select("s_suppkey", doubled("s_acctbal").alias("doubled"))


def gap_filler(key: str, at: str, step: dt.timedelta):
    """A table function over rows partitioned by `key` and ordered by `at`: the rows, and one for each step of time between two of them that has none.

    Its columns are those of the table it is given. Added rows hold key and time, else null. Rows of one time all stay; times off the steps of the row before are kept and start steps of their own; rows without a time are kept as they are. State is one time, so a key may have any number of rows.
    """

    @F.udtf
    class FillGaps:
        def __init__(self):
            self.last = None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("a table is needed")
            missing = {key, at} - set(rows.dataType.fieldNames())
            if missing:
                raise ValueError(f"the table lacks {sorted(missing)}")
            return AnalyzeResult(StructType([StructField(f.name, f.dataType) for f in rows.dataType]))  # nulls may come into any column

        def eval(self, row):
            found = row.asDict()
            now = found[at]
            while self.last is not None and now is not None and self.last + step < now:
                self.last += step
                yield tuple(found[name] if name == key else self.last if name == at else None for name in found)
            self.last = self.last if now is None else now
            yield tuple(found.values())

    return FillGaps


@query("""WITH hours AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
spans AS (SELECT user_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hours GROUP BY user_id)
SELECT user_id, hour, coalesce(n, 0) AS n FROM spans LEFT JOIN hours USING (user_id, hour)""")
def p80_table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour for each user, hours without events included; rows are summed to hours before the function sees them."""
    hours = load(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    filled = gap_filler("user_id", "hour", dt.timedelta(hours=1))(hours.asTable().partitionBy("user_id").orderBy("hour"))
    return filled.select("user_id", "hour", F.coalesce("n", F.lit(0)).alias("n"))
