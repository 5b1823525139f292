"""A Spark data source of multi-line records in zstd files, read by frame.

A zstd file is a run of independent frames; compressors that work in parallel, or append, write many.  The headers of
frames and blocks give every frame's length without decompressing anything, so a file is planned as one partition for
each ``frames`` consecutive frames, or, without that option, for consecutive frames of ``bytes`` together: the number of
partitions then grows with the bytes and not with the frames.  Records do not respect frames: a partition begins at the
first record that starts in its frames and reads on into the following ones until the record that it is in ends; of those
it looks at no more than it reads.  A file of one frame is one partition, since such a frame cannot be entered in its middle.

    spark.dataSource.register(RecordFiles)
    spark.read.format("record_files").option("path", "/shared/*.zst").load()
    spark.readStream.format("record_files").option("path", "/shared/*.zst").load()

The stream's offset is the list of files with the bytes of whole frames that were there, so frames that are appended later
and files that arrive later are read once, after a restart too.  Files may only grow, by whole frames.  A record that is
open at the end of a file ends there; a stream expects a record to be appended whole.  Paths are those of a file system that
driver and executors share.
"""

from __future__ import annotations

import glob
import io
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

START, GAP, PIECE = "[Event ", "\n\n", 1 << 18  # compressed bytes to a step
RECORDS = 1024  # to a batch that Spark gets
#: Fixed values of the format: magic numbers of a frame and of frames to skip, and lengths of header fields by their codes.
MAGIC, SKIPPED = 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
DICTIONARY_BYTES, SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)


def frames_of(path: str, start: int = 0) -> list[tuple[int, int]]:
    """(start, end) in bytes of every whole frame from an offset on, from headers alone; what is cut short is left out."""
    return list(_frames(path, start))


def _frames(path: str, start: int) -> Iterator[tuple[int, int]]:
    """The frames one by one: no header is read before its frame is asked for."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        at = start
        while at + 8 <= size:
            file.seek(at)
            magic, second = struct.unpack("<II", file.read(8))
            if magic in SKIPPED:
                end = at + 8 + second
            elif magic == MAGIC:
                end = _frame_end(file, at + 4, size)
            else:
                raise ValueError(f"{path}: no frame at byte {at}")
            if end is None or end > size:
                break
            if magic == MAGIC:
                yield at, end
            at = end


def _frame_end(file: io.BufferedReader, at: int, size: int) -> int | None:
    file.seek(at)
    descriptor = file.read(1)[0]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    content = SIZE_BYTES[descriptor >> 6] or single
    at += 1 + (not single) + DICTIONARY_BYTES[descriptor & 3] + content
    while at + 3 <= size:
        file.seek(at)
        block = int.from_bytes(file.read(3), "little")
        kind, length = block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else length)  # a run of one byte holds just this byte
        if block & 1:
            return at + 4 * checksum
    return None


@dataclass
class Frames(InputPartition):
    path: str
    start: int  # of the first frame
    own: int  # end of the last own frame
    whole: int  # end of the last frame that may be read on into
    first: bool  # whether the file, or what a stream reads of it, begins here


def partitions_of(path: str, start: int, end: int, frames: int | None = None, size: int = 1 << 23) -> list[Frames]:
    """Partitions of so many frames each, or of the frames that begin within ``size`` bytes of a partition's first."""
    found = [f for f in frames_of(path, start) if f[1] <= end]
    firsts = list(range(0, len(found), frames)) if frames else []
    for k, (at, _) in enumerate([] if frames else found):
        if not firsts or at - found[firsts[-1]][0] >= size:
            firsts.append(k)
    return [Frames(path, found[k][0], found[after - 1][1], found[-1][1], k == 0) for k, after in zip(firsts, [*firsts[1:], len(found)])]


def records_in(part: Frames, window: int) -> Iterator[str]:
    """The records that start in a partition's own frames.

    A start is a gap and the mark after it; it belongs to the frames in which its gap begins, so it is found once even where
    it lies across frames.
    """
    mark = (GAP + START).encode()
    text, place, looked = b"", 0, 0  # what is held, where it begins in the partition, how much of it holds no start
    limit, open_ = None, part.first  # where the own frames end, once known; whether the text begins with a record of ours
    for piece, own in _pieces(part, window):
        if not own and limit is None:
            limit = place + len(text)
        text += piece
        while (at := text.find(mark, looked)) >= 0:
            if open_:
                yield text[:at].decode("utf-8", "replace")
            if limit is not None and place + at >= limit:
                return
            open_, looked = True, 0
            text, place = text[at + len(GAP) :], place + at + len(GAP)
        looked = max(0, len(text) - len(mark) + 1)
        if not open_:
            text, place, looked = text[looked:], place + looked, 0
            if limit is not None and place >= limit:
                return
    if open_:
        yield text.decode("utf-8", "replace")


def _pieces(part: Frames, window: int) -> Iterator[tuple[bytes, bool]]:
    """Decompressed pieces, with whether they come from the partition's own frames, line ends made plain."""
    import zstandard

    tail = b""
    with open(part.path, "rb") as file:
        for start, end in _frames(part.path, part.start):
            if end > part.whole:
                break
            file.seek(start)
            own, left, stream = start < part.own, end - start, zstandard.ZstdDecompressor(max_window_size=window).decompressobj()
            while left > 0:
                taken = file.read(min(left, PIECE))
                left -= len(taken)
                piece = tail + stream.decompress(taken)
                tail = b"\r" if piece.endswith(b"\r") else b""
                yield piece[: len(piece) - len(tail)].replace(b"\r\n", b"\n"), own
    if tail:
        yield tail, False


class RecordFiles(DataSource):
    """Options: ``path`` (a glob), ``frames`` or else ``bytes`` (to a partition, 2^23), ``window`` (bytes at most, 2^31)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> StructType:
        return StructType([StructField("record", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RecordStream(self.options)


class _Reading:
    def __init__(self, options):
        self.path, self.frames, self.window = options["path"], int(options.get("frames", 0)), int(options.get("window", 1 << 31))
        self.bytes = int(options.get("bytes", 1 << 23))

    def files(self) -> list[str]:
        return sorted(glob.glob(self.path))

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        found = filter(None, (record.strip() for record in records_in(partition, self.window)))
        while held := [r if r.startswith(START) else START + r for r in islice(found, RECORDS)]:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["record"])


class RecordReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Frames]:
        return [p for path in self.files() for p in partitions_of(path, 0, os.path.getsize(path), self.frames, self.bytes)]


class RecordStream(_Reading, DataSourceStreamReader):
    """Offsets are {file: end of its last whole frame}, as text, since an offset's values must be plain."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        ends = {}
        for path in self.files():
            if found := frames_of(path):
                ends[path] = found[-1][1]
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        began, ended = json.loads(start["files"]), json.loads(end["files"])
        return [p for path, to in sorted(ended.items()) if to > began.get(path, 0) for p in partitions_of(path, began.get(path, 0), to, self.frames, self.bytes)]

    def commit(self, end: dict) -> None:
        pass


def plain_path(path: str) -> str:
    """A path of the shared folder as ``open`` takes it."""
    return path.removeprefix("file://").removeprefix("file:")


def write_frames(df: DataFrame, path: str, records: int = 10_000, record: str = "record") -> int:
    """Write a file per task, below a folder that all tasks share, in frames of so many records; returns the number of files.

    A file gets its name when it is whole, so a task that is run again replaces its own file.
    """
    folder = plain_path(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        name = f"{folder}/{TaskContext.get().partitionId():06}.zst"
        os.makedirs(folder, exist_ok=True)
        squeeze, met = zstandard.ZstdCompressor(), 0
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as file:
            for batch in batches:
                rows = [r for r in batch.column(0).to_pylist() if r]
                for at in range(0, len(rows), records):
                    file.write(squeeze.compress((GAP.join(rows[at : at + records]) + GAP).encode()))
                    met += 1
        if met:
            os.replace(file.name, name)
            yield pa.RecordBatch.from_pylist([{"name": name}])
        else:
            os.remove(file.name)

    return df.select(record).mapInArrow(write, "name string").count()
