"""Registry of named plans: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queuelens.functions.options import Options
from queuelens.operators.model import WaitingList
from queuelens.sources.testdata import load_tables


def waiting_list_from_testdata(spark: SparkSession, sf_dir: str) -> WaitingList:
    """The model over the files that the folder holds now; nothing is kept between queries."""
    t = load_tables(spark, sf_dir)
    return WaitingList(t.inpatient, t.outpatient, t.dim)


def _bind(fn, o: Options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(waiting_list_from_testdata(spark, sf_dir), o)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_plans(o: Options = Options()) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from queuelens.plans import export, products, published, reports, statistics
    plans = {}
    for table in (reports.REPORTS, products.PRODUCTS, statistics.STATISTICS, published.PUBLISHED,
                  export.EXPORTS):
        for name, fn in table.items():
            plans[name] = _bind(fn, o)
    return plans


def all_sql() -> dict[str, str]:
    from queuelens.plans import export, products, published, reports, statistics
    out = {}
    for table in (reports.SQL, products.SQL, statistics.SQL, published.SQL, export.SQL):
        out.update(table)
    return out
