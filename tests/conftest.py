import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from barloom.ship import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


def wander(days: int, seed: int, name: str = "WAVE", echo: float = 0.0, swing: float = 0.011) -> pd.DataFrame:
    """Weekday bars with gaps, uneven ranges and volumes; `echo` of a day's move carries over to the next."""
    g = np.random.default_rng(seed)
    moves = g.laplace(0.0002, swing / np.sqrt(2), days)
    for k in range(1, days):
        moves[k] += echo * moves[k - 1]
    close = 80 * np.exp(np.cumsum(moves))
    opens = np.append(80.0, close[:-1]) * (1 + g.uniform(-0.003, 0.003, days))
    top, bottom = np.maximum(opens, close), np.minimum(opens, close)
    return pd.DataFrame({
        "symbol": name, "ts": pd.bdate_range("2021-03-01", periods=days), "open": opens, "high": top * (1 + g.uniform(0, 0.01, days)), "low": bottom * (1 - g.uniform(0, 0.01, days)),
        "close": close, "volume": np.floor(g.uniform(1e4, 9e4, days)),
    })


def as_bars(spark, frame: pd.DataFrame):
    return spark.createDataFrame(frame, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="session")
def bars(spark):
    return as_bars(spark, wander(400, 21)).cache()


@pytest.fixture(scope="session")
def book_bars(spark):
    """Six names over 450 days: N1 pauses for thirty of them, N4 ends at day 200, N5 starts at day 60."""
    frames = [wander(450, 100 + k, f"N{k}", swing=0.008 + 0.002 * k) for k in range(6)]
    frames[1] = frames[1].drop(index=range(150, 180))
    frames[4] = frames[4].iloc[:200]
    frames[5] = frames[5].iloc[60:]
    return as_bars(spark, pd.concat(frames)).cache()
