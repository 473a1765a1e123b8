"""Polled bars: batches, filters inside the source, offsets over a restart, failed polls and their delays."""

import pandas as pd
import pytest
from conftest import as_bars, wander
from pyspark.sql import functions as F

from barloom.streaming import bars as live
from barloom.streaming import poll


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """Four polls of two symbols; the second one failed."""
    path = str(tmp_path_factory.mktemp("polls"))
    both = pd.concat([wander(40, 1, "A"), wander(40, 2, "B")])
    for k in range(4):
        part = both.groupby("symbol").nth(range(10 * k, 10 * k + 10))
        if k == 1:
            poll.record_failure(spark, path, k)
        else:
            poll.record(spark, as_bars(spark, part).repartition(2), path, k)
    poll.register(spark)
    return path, both


def test_polls_as_a_table(spark, recorded):
    path, both = recorded
    df = spark.read.format("bar_poll").option("path", path).load()
    assert df.count() == 60 and {r.poll for r in df.select("poll").distinct().collect()} == {0, 2, 3}
    late = both[both.symbol == "A"].ts.iloc[25]
    some = df.filter((F.col("symbol") == "A") & (F.col("ts") >= F.lit(late)) & (F.col("close") > 0))
    assert some.count() == 15 and df.filter(F.col("poll") == 2).count() == 20 and df.filter(F.col("symbol").isin("B", "C")).count() == 30
    got = df.filter("symbol = 'B'").orderBy("ts").toPandas()
    want = both[both.symbol == "B"].drop(index=range(10, 20))
    pd.testing.assert_series_equal(got.close, want.close.reset_index(drop=True))


def test_filters_reach_the_source():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    r = poll.PollReader(poll.RecordedPolls("/nowhere"))
    rest = list(r.pushFilters([EqualTo(("symbol",), "A"), GreaterThan(("close",), 1.0), StringContains(("symbol",), "x"), EqualTo(("poll",), 3)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan", "StringContains"] and r.where is not None and r.only == 3
    assert r.partitions() == []


def test_stream_goes_on_after_a_restart(spark, recorded, tmp_path):
    path, _ = recorded
    go = lambda: live.fan_out(live.new_bars(spark.readStream.format("bar_poll").option("path", str(tmp_path / "polls")).load().drop("poll")), [live.batch_sink(f"{tmp_path}/out")], f"{tmp_path}/ck")
    copy = lambda k: spark.read.parquet(f"{path}/poll={k}").write.parquet(f"{tmp_path}/polls/poll={k}")
    copy(0)
    poll.record_failure(spark, f"{tmp_path}/polls", 1)
    go().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    copy(2)
    copy(3)
    q = go()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 60 == out.select("symbol", "ts").distinct().count()  # no poll twice, none left out
    assert out.select("batch").distinct().count() == 2
    go().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60


class Fake(poll.Polls):
    def __init__(self, answers):
        self.answers = answers

    def made(self):
        x = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if x is None:
            raise poll.PollError
        return x


def stream(answers):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    return poll.PollStream(Fake(answers), 60, 900, lambda: now[0], sleep), now, slept


def test_delays_grow_with_failures_and_are_waited_for():
    ok = [(0, False), (1, False)]
    s, now, slept = stream([None, None, ok])
    assert s.latestOffset() == {"poll": 2} and len(slept) == 2 and 96 <= slept[0] <= 144 and 192 <= slept[1] <= 288 and s.failures == 0
    more = [*ok, (2, True), (3, False)]
    s, now, slept = stream([ok, None, None, more])
    assert s.latestOffset() == {"poll": 2}
    for k in (1, 2):
        assert s.latestOffset() == {"poll": 2} and s.failures == k and not slept  # nothing is thrown, nothing blocks
        due = s.due
        assert s.latestOffset() == {"poll": 2} and s.due == due  # not asked again before its time
        now[0] = s.due
    assert s.latestOffset() == {"poll": 3} and s.failures == 3  # the recorded failure counts too, and is passed
    now[0] = s.due
    assert s.latestOffset() == {"poll": 4} and s.failures == 0
    fresh, _, _ = stream([more])
    assert fresh.latestOffset() == {"poll": 4}  # a new reader takes what there is


def test_partitions_between_offsets(recorded):
    path, _ = recorded
    s = poll.PollStream(poll.RecordedPolls(path), 60, 900)
    assert {p.poll for p in s.partitions({"poll": 0}, {"poll": 3})} == {0, 2} and s.partitions({"poll": 1}, {"poll": 2}) == []
    assert s.initialOffset() == {"poll": 0} and s.latestOffset() == {"poll": 4}
