"""Names of queries, what they run, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def r6(c: str | Column) -> Column:
    """Rounded as the SQL rounds, so that sums in another order compare equal."""
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


# the logical tables, in SQL
PTS = "pts as (select user_id as curve_id, event_id as seq, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, value as y from events)"
SHORT = "pts as (select concat_ws('/', user_id, event_type) as curve_id, event_id as seq, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, value as y from events)"
PART = "pts as (select l_partkey as curve_id, l_orderkey * 10 + l_linenumber as seq, (epoch_us(l_shipdate) - 1704067200000000) / 3.6e9 as t, l_quantity as y from lineitem)"
COND = "cond as (select l_partkey as curve_id, l_orderkey * 10 + l_linenumber as seq, l_returnflag as assay, l_quantity as conc, l_discount * 100 as ph, l_extendedprice / 1000 as t50, l_suppkey as study, l_linestatus as line, l_tax as tax, p_brand as protein, p_type as construct, p_size::double as temp from lineitem join part on l_partkey = p_partkey)"
RAW = COND + ", raw as (select curve_id, seq, case when assay = 'A' then 'T' when assay = 'N' then 'O' when line = 'F' then 'R' else 'X' end || seq::varchar as entry, conc::varchar || ' microM at ' || (seq % 10)::varchar || ' Hours pH ' || (temp / 10)::varchar as parameter, case when conc < 3 then 'NA' else t50::varchar end as rate, protein from cond)"
