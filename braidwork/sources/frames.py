"""Frames of tracked people as a Spark source: a folder of JSON-lines files, a partition for each range of SPLIT bytes of a file
(compressed files are one), a frame held at a time; rows go out in Arrow batches.

A line is a frame: {"video", "frame", "people": [{"track_id", "x1", "y1", "x2", "y2", "points": [{"x", "y", "confidence"}]}]}.
Without "video", the file's name without its ending is the video. Lines that are not JSON objects and people without points
give no rows. `register(spark)` makes the format known; it reads as a table and as a stream.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schemas

FORMAT = "pose_frames"
#: Bytes of a file whose lines are one partition.
SPLIT = 16 << 20
#: Bytes read at once, and rows of a batch.
BLOCK, ROWS = 1 << 20, 8192
_ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[kind]) for name, kind in (c.split(" ") for c in schemas.KEYPOINTS.split(", "))])


@dataclass
class File(InputPartition):
    """The lines of a file that begin in [low, high); all of them without `high`."""

    path: str
    low: int = 0
    high: int | None = None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(folder: str) -> list[tuple[str, str]]:
    """(name below the folder, path) of its files by name, subfolders too; hidden ones and those begun with _ are passed over."""
    system, base = _opened(folder)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    names = ((posixpath.relpath(f.path, base.rstrip("/")), f.path) for f in found if f.type == fs.FileType.File)
    shown = sorted(n for n in names if not any(part.startswith(("_", ".")) for part in n[0].split("/")))
    head = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    return [(name, head + path) for name, path in shown]


def ranges(path: str) -> list[File]:
    system, own = _opened(path)
    try:
        pa.Codec.detect(own)
        return [File(path)]
    except (TypeError, ValueError):  # no compression by that name
        size = system.get_file_info(own).size or 1
        return [File(path, low, min(low + SPLIT, size)) for low in range(0, size, SPLIT)]


def lines_of(data: pa.NativeFile, low: int, high: int | None) -> Iterator[bytes]:
    """The lines that begin in [low, high): the last one reaches beyond, the first range's neighbour leaves it out."""
    at, inside, rest = max(low - 1, 0), low == 0, b""
    if at:
        data.seek(at)
    while block := data.read(BLOCK):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if high is not None and at >= high:
                return
            if inside:
                yield line
            at, inside = at + len(line) + 1, True
    if inside and (high is None or at < high):
        yield rest


def frame_rows(frame: dict, video: str) -> Iterator[tuple]:
    """A row a keypoint; a person without a track has their place among the frame's people for one."""
    number = frame.get("frame")
    for i, p in enumerate(frame.get("people") or []):
        track = p.get("track_id")
        box = [p.get(c) for c in ("x1", "y1", "x2", "y2")]
        for name, k in zip(schemas.KEYPOINT_NAMES, p.get("points") or [], strict=False):
            yield (str(frame.get("video") or video), number, i if track is None else track, *box, name, k.get("x"), k.get("y"), k.get("confidence"))


class _Files:
    def __init__(self, folder: str):
        self.folder = folder

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, path = _opened(partition.path)
        video, made = posixpath.splitext(posixpath.basename(path))[0], []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _ARROW, strict=True)], schema=_ARROW)
        with system.open_input_stream(path) if partition.high is None else system.open_input_file(path) as data:
            for line in lines_of(data, partition.low, partition.high):
                made += self._rows(line, video)
                if len(made) >= ROWS:
                    yield batch()
                    made = []
        if made:
            yield batch()

    def _rows(self, line: bytes, video: str) -> Iterator[tuple]:
        try:
            frame = json.loads(line)
        except ValueError:
            return
        if isinstance(frame, dict):
            yield from frame_rows(frame, video)


class FrameReader(_Files, DataSourceReader):
    def partitions(self) -> list[File]:
        return [part for _, path in listed(self.folder) for part in ranges(path)]


class FrameStream(_Files, DataSourceStreamReader):
    """Offsets are names: a file is read once its name is beyond the last one read, so names of deliveries must rise."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"name": max((n for n, _ in listed(self.folder)), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [part for name, path in listed(self.folder) if start["name"] < name <= end["name"] for part in ranges(path)]

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.KEYPOINTS

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FrameStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)
