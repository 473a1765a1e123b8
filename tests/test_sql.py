"""The engine from SQL against the engine on DataFrames."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.engine import Costs, run_backtest
from barloom.operators.metrics import compute_metrics
from barloom.plans import sql

BY = ["symbol"]


@pytest.fixture(scope="module")
def names(spark, book_bars):
    return sql.register(spark, book_bars, "t_")


def test_views_and_functions_are_there(spark, names):
    assert {"t_bars", "t_panel", "t_target_sma_cross", "t_weight_xs_momentum", "t_backtest", "t_metrics"} <= set(names)
    assert spark.sql("SELECT count(*) AS n FROM t_panel").first().n > 0
    # views are plans: a filter on the symbol gets to the bars
    assert spark.sql("SELECT count(DISTINCT symbol) AS n FROM t_target_momentum WHERE symbol IN ('N1', 'N2')").first().n == 2


@pytest.mark.parametrize("how", [{}, {"lag": 3, "leverage": 0.5, "shorts": False, "capital": 10.0, "commission": 5.0, "ppy": 50}])
def test_backtest_by_partition(spark, names, how):
    """Some targets and closes are missing; every symbol is a partition."""
    rows = spark.table("t_target_sma_cross").withColumn("target", F.when(F.col("bar_idx") % 7 > 0, F.col("target"))).select("symbol", "ts", "close", "target")
    rows.createOrReplaceTempView("t_gappy")
    args = "".join(f", {k} => {str(v).lower() if isinstance(v, bool) else f'{v}D' if isinstance(v, float) else v}" for k, v in how.items())
    got = spark.sql(f"SELECT * FROM t_backtest(TABLE(t_gappy) PARTITION BY symbol ORDER BY ts{args})").orderBy("symbol", "ts").toPandas()
    engine = {"lag": how.get("lag", 1), "max_leverage": how.get("leverage", 1.0), "allow_short": how.get("shorts", True), "capital": how.get("capital", 100_000.0), "ppy": how.get("ppy", 252)}
    want = run_backtest(rows, BY, Costs(how.get("commission", 1.0)), **engine).orderBy("symbol", "ts").select(got.columns.tolist()).toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    spark.createDataFrame(got).createOrReplaceTempView("t_run")
    ppy = engine["ppy"]
    found = {r.symbol: r for r in spark.sql(f"SELECT * FROM t_metrics(TABLE(SELECT symbol, ts, net, equity FROM t_run) PARTITION BY symbol ORDER BY ts, ppy => {ppy})").collect()}
    for m in compute_metrics(spark.createDataFrame(want), BY, ppy).collect():
        r = found.pop(m.symbol)
        assert [r.n_bars, r.total_return, r.sharpe, r.max_drawdown, r.hit_rate] == pytest.approx([m.n_bars, m.total_return, m.sharpe, m.max_drawdown, m.hit_rate])
    assert not found


def test_no_rows_and_no_future(spark, names):
    none = "SELECT * FROM t_backtest(TABLE(SELECT symbol, ts, close, target FROM t_target_momentum WHERE false) PARTITION BY symbol ORDER BY ts)"
    assert spark.sql(none).count() == 0
    with pytest.raises(Exception, match="lag must be 1"):
        spark.sql("SELECT * FROM t_backtest(TABLE(SELECT symbol, ts, close, target FROM t_target_momentum) PARTITION BY symbol ORDER BY ts, lag => 0)").collect()
