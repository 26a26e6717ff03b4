import gzip
import json

import pytest

from braidwork import schemas
from braidwork.operators import fill, markdown, motion, transcripts
from braidwork.operators import standings as S
from braidwork.sources import frames as P
from braidwork.sources.manifest import DONE, FAILED, REMOVED, REPEATED, Manifest, attempted

DDL = "id long, text string"


def work(rows):
    def counted(row):
        if row["text"] == "bad":
            raise ValueError("refused")
        return {"n": len(row["text"] or "")}

    return attempted(rows, "id", counted, "n long")


@pytest.fixture
def held(spark, tmp_path):
    return Manifest(spark, str(tmp_path / "ledger"), "id")


def state(held):
    return {r.id: (r.status, r.error, r.generation) for r in held.entries().collect()}


def results(held):
    return {r.id: (r.n, r.generation) for r in held.results().collect()}


def test_only_changed_keys_are_worked_on(spark, held):
    rows = lambda *r: spark.createDataFrame(list(r), DDL)
    assert held.entries() is None
    assert held.update(rows((1, "a"), (2, "bb"), (3, "bad"), (4, None), (None, "x")), work) == 0
    assert state(held) == {1: (DONE, None, 0), 2: (DONE, None, 0), 3: (FAILED, "ValueError: refused", 0), 4: (DONE, None, 0)}
    assert results(held) == {1: (1, 0), 2: (2, 0), 4: (0, 0)}
    asked = []
    later = rows((1, "a"), (2, "bbb"), (3, "bad"), (4, ""), (5, "new"))
    assert held.update(later, lambda df: asked.extend(r.id for r in df.collect()) or work(df)) == 1
    assert sorted(asked) == [2, 3, 4, 5]  # null and empty are different contents, a failed key is tried again
    assert results(held) == {1: (1, 0), 2: (3, 1), 4: (0, 1), 5: (3, 1)}
    held.update(rows((1, "a"), (3, "good")), work)
    assert state(held) == {1: (DONE, None, 0), 3: (DONE, None, 2), 2: (REMOVED, None, 2), 4: (REMOVED, None, 2), 5: (REMOVED, None, 2)}
    assert results(held) == {1: (1, 0), 3: (4, 2)}
    held.update(rows((1, "a"), (2, "bbb")), work)
    assert results(held) == {1: (1, 0), 2: (3, 3)}  # a key that comes back is worked on, with its old content as well
    held.update(rows((1, "a"), (2, "bbb")), work, rebuild=True)
    assert results(held) == {1: (1, 4), 2: (3, 4)}


def test_repeated_keys_fail_alone(spark, held):
    held.update(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], DDL), work)
    assert state(held) == {1: (FAILED, REPEATED, 0), 2: (DONE, None, 0)} and results(held) == {2: (1, 0)}


def test_a_stop_before_the_commit_leaves_nothing(spark, held):
    held.update(spark.createDataFrame([(1, "a")], DDL), work)

    def stop():
        raise InterruptedError

    later = spark.createDataFrame([(1, "aa"), (2, "b")], DDL)
    with pytest.raises(InterruptedError):
        held.update(later, work, before_commit=stop)
    assert results(held) == {1: (1, 0)}
    assert held.update(later, work) == 1 and results(held) == {1: (2, 1), 2: (1, 1)}


def test_no_rows(spark, held):
    held.update(spark.createDataFrame([], DDL), work)
    assert state(held) == {} and results(held) == {}


def person(x, **more):
    return {"x1": 0.0, "y1": 0.0, "x2": x, "y2": 2.0, "points": [{"x": x, "y": 1.5, "confidence": 0.5}, {"x": None, "y": 1.0}], **more}


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_frames(spark, tmp_path):
    P.register(spark)
    write(tmp_path / "in" / "one.jsonl", {"frame": 0, "people": [person(1.5, track_id=7), person(2.5)]}, "not json", "[1]", "", {"frame": 1}, {"frame": 2, "people": None})
    write(tmp_path / "in" / "sub" / "two.jsonl", {"video": "named", "frame": 3, "people": [person(3.5), {"track_id": 9}]})
    write(tmp_path / "in" / "_SUCCESS")
    for folder in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        df = spark.read.format(P.FORMAT).load(folder)
        got = [(r.video, r.frame, r.track_id, r.keypoint, r.bbox_x2, r.x, r.y, r.confidence) for r in df.orderBy("frame", "track_id", "keypoint").collect()]
        assert got == [
            ("one", 0, 1, "left_eye", 2.5, None, 1.0, None), ("one", 0, 1, "nose", 2.5, 2.5, 1.5, 0.5), ("one", 0, 7, "left_eye", 1.5, None, 1.0, None), ("one", 0, 7, "nose", 1.5, 1.5, 1.5, 0.5),
            ("named", 3, 0, "left_eye", 3.5, None, 1.0, None), ("named", 3, 0, "nose", 3.5, 3.5, 1.5, 0.5),
        ]
        assert df.rdd.getNumPartitions() == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format(P.FORMAT).load(str(tmp_path / "none")).count() == 0


def test_frames_longer_than_a_block(spark, tmp_path):
    P.register(spark)
    write(tmp_path / "in" / "v.jsonl", *({"frame": i, "people": [person(1.0)], "pad": "é" * 50_000} for i in range(30)))
    df = spark.read.format(P.FORMAT).load(str(tmp_path / "in"))
    assert sorted({r.frame for r in df.collect()}) == list(range(30))


def test_frame_stream_reads_each_file_once(spark, tmp_path):
    P.register(spark)
    for i in range(3):
        write(tmp_path / "in" / f"{i}.jsonl", {"frame": i, "people": [person(1.0)]})
        source = spark.readStream.format(P.FORMAT).load(str(tmp_path / "in"))
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()
        assert sorted(r.frame for r in spark.read.parquet(str(tmp_path / "out")).where("keypoint = 'nose'").collect()) == list(range(i + 1))


def test_a_long_file_is_read_in_ranges(tmp_path, monkeypatch):
    """Each line is in one range, wherever ranges and blocks end; a compressed file is one."""
    write(tmp_path / "in" / "v.jsonl", *({"frame": i, "people": [person(1.0)], "pad": "é" * (i % 50)} for i in range(200)), "", {"frame": 200, "people": [person(2.0)]})
    (tmp_path / "in" / "w.jsonl.gz").write_bytes(gzip.compress(json.dumps({"frame": 201, "people": [person(1.0)]}).encode()))
    reader = P.FrameReader(str(tmp_path / "in"))
    told = lambda: [(r["frame"], r["keypoint"]) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    wanted = [(i, name) for i in range(202) for name in schemas.KEYPOINT_NAMES[:2]]
    assert told() == wanted and len(reader.partitions()) == 2
    monkeypatch.setattr(P, "BLOCK", 64)
    for split in (1, 97, 250):
        monkeypatch.setattr(P, "SPLIT", split)
        assert told() == wanted
    assert len(reader.partitions()) > 100


def test_posts_can_be_repeated(spark, tmp_path):
    at, teams = str(tmp_path / "games"), spark.createDataFrame([("Ants",), ("Bees",)], schemas.TEAMS)
    games = lambda *rows: spark.createDataFrame(list(rows), schemas.GAMES)
    held = lambda: sorted((r.game_id, r.home_score) for r in spark.read.parquet(at).collect())
    first = games((1, "Ants", "Bees", "3", "1", 5), (2, "Ants", "Ants", "3", "1", 5), (3, "Bees", "Ants", "4", "2", 5), (3, "Bees", "Ants", "5", "2", 5))
    got = sorted((r.game_id, r.status, r.error, r.winner) for r in S.posted(first, teams, at).collect())
    assert got == [(1, 201, None, "Ants"), (2, 400, S.SELF, None), (3, 201, None, "Bees"), (3, 201, None, "Bees")]
    assert held() == [(1, "3"), (3, "4")]
    S.posted(first.union(games((4, "Ants", "Bees", "0", "9", 6))), teams, at)
    assert held() == [(1, "3"), (3, "4"), (4, "0")]
    assert S.posted(first.limit(0), teams, at).count() == 0 and len(held()) == 3


def test_lookup_keeps_every_row_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, x string")
    lookup = spark.createDataFrame([(1, 5), (1, 4), (3, 1), (None, 9)], "k int, v int")
    got = sorted((r.x, r.v, r.found) for r in fill.looked_up(rows, lookup, ["k"], ["v"]).collect())
    assert got == [("a", 4, True), ("a", 4, True), ("b", None, False), ("c", None, False)]


def test_lint_takes_the_upper_median(spark):
    rows = [("a", "p", "x", n) for n in (4, 1, 3, 2)] + [("b", "p", "---", 7), ("b", "q", ". x", None), (None, "p", "## H\n\n: x", 5), (None, "p", "---\nkey: v\n", 5)]
    got = {r.source_title: tuple(r)[1:] for r in markdown.lint(spark.createDataFrame(rows, "source_title string, parent_id string, text string, token_count int")).collect()}
    assert got == {"a": (4, 1, 3, 0, 0, 0), "b": (2, 2, 7, 1, 1, 0), None: (2, 1, 5, 1, 1, 1)}


def test_swept_chunks_equal_those_of_each_size(spark):
    rows = [(d, i, i * 3, " ".join(["w"] * (1 + (i * 7 + d) % 9)) + ".") for d in range(4) for i in range(30 * (d > 0) + 1)]
    said, sizes = spark.createDataFrame(rows, "doc int, n int, ts int, sentence string"), [(5, 0), (20, 6), (500, 10)]
    swept = sorted(tuple(r) for r in transcripts.swept_chunks(said, ["doc"], "n", sizes).collect())
    assert swept == sorted((w, o, *r) for w, o in sizes for r in transcripts.chunks(said, ["doc"], "n", words=w, overlap=o).collect())


def test_implement_path_on_a_straight_line(spark):
    """A tip that moves right and up at an angle of 45 degrees, fastest at its eighth row."""
    at = [float(x) for x in (0, 1, 2, 3, 4, 5, 7, 12, 17, 19, 20, 21)]
    rows = [("v", i, 0.0, 0.0, x, -x, x, -x) for i, x in enumerate(at)] + [("one", 0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0), ("none", 0, *[None] * 6)]
    track = spark.createDataFrame(rows, "video string, frame int, knob_x double, knob_y double, tip_x double, tip_y double, sweet_x double, sweet_y double")
    got = {r.video: r for r in motion.bat_path(track, 120.0).collect()}
    assert set(got) == {"v"}
    v = got["v"]
    assert v.contact_frame in (6, 7, 8) and abs(v.attack_angle_deg - 45) < 1e-9 and abs(v.attack_direction - 45) < 1e-9
    assert abs(v.swing_path_tilt_deg + 45) < 1e-9 and v.coverage_pct == 100 and not v.in_ideal_band
