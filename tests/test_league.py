import pytest
from pyspark.sql import functions as F

from braidwork import schemas
from braidwork.operators import standings as S
from braidwork.operators.fill import Filter
from braidwork.streaming import live as L

NAMES = ["Ants", "Bees", "Cats", "Dogs", "Elks", "Foxes"]


@pytest.fixture
def teams(spark):
    return spark.createDataFrame([(n,) for n in NAMES], schemas.TEAMS)


def games(spark, rows):
    return spark.createDataFrame([(i + 1, *r, i) for i, r in enumerate(rows)], schemas.GAMES)


def test_no_games(spark, teams):
    got = S.league(games(spark, []), teams).collect()
    assert [r.name for r in got] == NAMES and all((r.wins, r.losses, r.pct) == (0, 0, 0) for r in got)


def test_a_game_counts_for_both(spark, teams):
    got = S.league(games(spark, [("Bees", "Ants", "5", "3")]), teams).collect()
    assert (got[0].name, got[0].wins, got[0].losses, got[0].run_diff, got[0].pct) == ("Bees", 1, 0, 2, 1.0)
    assert (got[-1].name, got[-1].losses, got[-1].run_diff) == ("Ants", 1, -2)


@pytest.mark.parametrize("game, error", [
    (("Ants", "Bees", "4", "4"), S.TIE), (("Ants", "Ants", "4", "3"), S.SELF), (("Ants", "Zebras", "4", "3"), S.UNKNOWN), (("Ants", "Bees", "-1", "3"), S.SCORES),
    (("Ants", "Bees", "1.5", "3"), S.SCORES), (("Ants", "Bees", None, "3"), S.SCORES), (("Ants", "Bees", "x", "3"), S.SCORES), (("", "Bees", "1", "3"), S.REQUIRED), ((None, "Bees", "1", "3"), S.REQUIRED), (("Ants", "Bees", "7.0", "3"), None),
])
def test_rules(spark, teams, game, error):
    assert S.checked(games(spark, [game]), teams).first().error == error


def test_sums_balance_and_order(spark, teams):
    rows = [(NAMES[i % 6], NAMES[(i * 5 + 1) % 6], str(i % 7), str(i * 3 % 8)) for i in range(60)]
    good = S.checked(games(spark, rows), teams).where("error IS NULL").count()
    got = S.league(games(spark, rows), teams).collect()
    assert sum(r.wins for r in got) == sum(r.losses for r in got) == good and sum(r.run_diff for r in got) == 0
    assert got == sorted(got, key=lambda r: (-r.pct, -r.run_diff, r.name.lower()))


def test_posting(spark, teams):
    held = games(spark, [("Ants", "Bees", "1", "2")])
    code, made = S.recorded({"home_team": "Cats", "away_team": "Dogs", "home_score": 2, "away_score": 9}, held, teams, 99, 2)
    assert code == 201 and made["id"] == 2 and made["winner"] == "Dogs"
    assert S.recorded({"home_team": "Cats", "away_team": "Cats", "home_score": 2, "away_score": 9}, held, teams, 99) == (400, {"error": S.SELF})
    ids = {S.recorded({"home_team": "Cats", "away_team": "Dogs", "home_score": 2, "away_score": 9}, held, teams, 99)[1]["id"] for _ in range(2)}
    assert len(ids) == 2 and min(ids) >= 0
    assert [r.game_id for r in S.newest(games(spark, [("a", "b", "1", "2")] * 3), 2).collect()] == [3, 2]


def test_stream_ends_as_batch(spark, teams, tmp_path):
    rows = [(NAMES[i % 6], NAMES[(i * 5 + 1) % 6], str(i % 7), str(i * 3 % 8)) for i in range(40)]
    games(spark, rows).repartition(3).write.parquet(str(tmp_path / "games"))
    source = spark.readStream.schema(schemas.GAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "games"))
    L.write_standings(source, teams, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, S.league(games(spark, rows), teams).collect()))


def test_segment_stream_keeps_state(spark, tmp_path):
    src = tmp_path / "rows"
    for part in ([("v", 0, 1), ("v", 10, 1)], [("v", 40, 1), ("v", 41, 2)], [("v", 42, 2), ("w", 0, 5)]):
        spark.createDataFrame(part, "video string, frame int, track int").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("video string, frame int, track int").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = L.segment_stream(stream, "video", "frame", "track")
    out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.video, r.frame): r.segment_id for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {("v", 0): 0, ("v", 10): 0, ("v", 40): 1, ("v", 41): 2, ("v", 42): 2, ("w", 0): 0}


def test_filter_stream_equals_filter(spark, tmp_path):
    points = [(0, None), (1, 5.0), (2, 7.0), (3, None), (4, 12.0)]
    for p in (points[:2], points[2:4], points[4:]):
        spark.createDataFrame([("v", f, x, x) for f, x in p], "video string, frame int, cx double, cy double").coalesce(1).write.mode("append").parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema("video string, frame int, cx double, cy double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "i"))
    L.filter_stream(stream, "video", "frame").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.frame: r.k_cx for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    kf = Filter(5.0, 5.0)
    want = {1: 5.0}
    for f, x in points[2:]:
        kf.predict()
        if x is not None:
            kf.update(x, x)
        want[f] = float(kf.state[0])
    assert got == pytest.approx(want)


def test_a_repeated_batch_is_read_once(spark, tmp_path):
    rows, stopped = tmp_path / "rows", []

    def stop_once(n):
        if n == 1 and not stopped:
            stopped.append(n)
            raise RuntimeError("between write and commit")

    for part in ([(1, "a"), (2, "b")], [(3, "a")], [(4, "b")]):
        spark.createDataFrame(part, "id int, kind string").coalesce(1).write.mode("append").parquet(str(rows))
        start = lambda: L.write_by_key(spark.readStream.schema("id int, kind string").parquet(str(rows)), str(tmp_path / "o"), str(tmp_path / "c"), "kind", stop_once).awaitTermination()
        try:
            start()
        except Exception:
            assert stopped == [1]
            start()
    assert stopped == [1]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3, 4]


def test_segments_are_closed_by_rows_and_by_timers(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    parts = [[("v", at(0), 1, "a"), ("v", at(10), 2, "a"), ("w", at(5), 3, "x")], [("v", at(20), 4, "b"), ("v", at(200), 5, "b")], [("z", "2200-01-01 00:00:00", 6, "z")], [("w", at(6), 7, "x")]]
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            df = spark.createDataFrame(part, "k string, t string, i int, who string").withColumn("t", F.col("t").cast("timestamp"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "i"))
            out = L.closed_segments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "i")), "k", "t", "i", "who", 60_000, "0 seconds")
            out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, was)
    got = sorted((r.k, r.identity, r.n) for r in spark.read.parquet(str(tmp_path / "o")).where("k <> 'z'").collect())
    assert got == [("v", "a", 2), ("v", "b", 1), ("v", "b", 1), ("w", "x", 1)]


def test_closer_knows_its_timer():
    """The timer of an open segment is told by its end, so a key's timers are never listed."""
    import pandas as pd

    from braidwork.streaming.live import Closer

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        def __init__(self):
            self.timers = set()

        def getValueState(self, name, schema):  # noqa: N802
            return Held()

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    closer, handle = Closer("k", "ts", "o", "who", 1000), Handle()
    closer.init(handle)
    rows = lambda *at: iter([pd.DataFrame({"ts": pd.to_datetime([a for a, _ in at], unit="ms"), "o": range(len(at)), "who": [w for _, w in at]})])
    assert list(closer.handleInputRows(("x",), rows((10, "a"), (5, "a")), None)) == [] and handle.timers == {1011}
    (told,) = closer.handleInputRows(("x",), rows((20, "a"), (30, "b")), None)
    assert handle.timers == {1031} and closer.open.value == ("b", 30_000, 30_000, 1)
    assert told.to_dict("records") == [{"k": "x", "identity": "a", "start": pd.Timestamp(5, unit="ms"), "end": pd.Timestamp(20, unit="ms"), "n": 3}]
