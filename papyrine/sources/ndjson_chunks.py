"""Newline-delimited JSON in chunks that end anywhere, as a Spark data source.

A stream of bytes is a folder of numbered chunk files; an empty file ``end`` closes it. A line may
run over any number of chunks, and a chunk may split a character. Each row is a line that is not
blank, with the chunk and the place in it where the line ends; what is left after the last newline
is a line once the stream is closed. The same bytes in other chunks give the same lines.

Reading is resumable: an offset holds how many chunks of each open stream were taken. A range of
chunks is read again the same way after a failure, as the beginning of its first line is looked up
in the chunks before. After a batch is committed, closed streams are forgotten, and deleted with
the option ``clean``. Chunks must be numbered without gaps; a gap holds the stream up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "stream string, chunk int, line int, value string"
END = "end"
#: Streams that a task reads one after another.
STREAMS_A_TASK = 64
CHUNK_BYTES = 64 * 1024


def _name(chunk: int) -> str:
    return f"{chunk:010d}"


@dataclass
class ChunkRange:
    """Chunks ``first`` to ``last`` - 1 of a stream, and whether it closes with them."""

    stream: str
    first: int
    last: int
    closed: bool


class Ranges(InputPartition):
    def __init__(self, ranges: list[ChunkRange]):
        self.ranges = ranges


class _Folder:
    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def bytes_of(self, stream: str, chunk: int) -> bytes:
        with self.files.open_input_stream(f"{self.root}/{stream}/{_name(chunk)}") as f:
            return f.read()

    def found(self) -> dict[str, tuple[int, bool]]:
        """{stream: (chunks without a gap from 0, closed)}"""
        chunks: dict[str, set[str]] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File:
                _, stream, name = info.path.rsplit("/", 2)
                chunks.setdefault(stream, set()).add(name)
        out = {}
        for stream, names in chunks.items():
            n = 0
            while _name(n) in names:
                n += 1
            out[stream] = (n, END in names and n == len(names) - 1)
        return out

    def begun(self, stream: str, chunk: int) -> bytes:
        """What stands before ``chunk`` after the last newline."""
        parts: list[bytes] = []
        while chunk > 0:
            chunk -= 1
            before, newline, rest = self.bytes_of(stream, chunk).rpartition(b"\n")
            parts.append(rest)
            if newline:
                break
        return b"".join(reversed(parts))

    def lines(self, part: ChunkRange) -> Iterator[tuple[str, int, int, str]]:
        rest = self.begun(part.stream, part.first)
        chunk = n = 0
        for chunk in range(part.first, part.last):
            *whole, rest = (rest + self.bytes_of(part.stream, chunk)).split(b"\n")
            n = 0
            for line in whole:
                if text := line.decode(errors="replace").strip():
                    yield part.stream, chunk, n, text
                    n += 1
        if part.closed and (text := rest.decode(errors="replace").strip()):
            yield part.stream, max(part.last - 1, 0), n, text


def _packed(ranges: list[ChunkRange], a_task: int) -> list[Ranges]:
    return [Ranges(ranges[i : i + a_task]) for i in range(0, len(ranges), a_task)]


class _Read:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.clean = options.get("clean", "false").lower() == "true"
        self.a_task = int(options.get("streamspertask", STREAMS_A_TASK))

    def read(self, partition: Ranges) -> Iterator[tuple[str, int, int, str]]:
        folder = _Folder(self.path)
        for part in partition.ranges:
            yield from folder.lines(part)


class ChunkReader(_Read, DataSourceReader):
    """All streams as they are; one that is still open gives its whole lines."""

    def partitions(self) -> list[Ranges]:
        return _packed([ChunkRange(s, 0, n, closed) for s, (n, closed) in sorted(_Folder(self.path).found().items())], self.a_task)


class ChunkStreamReader(_Read, DataSourceStreamReader):
    """Offsets are {stream: [chunks taken, closed]}."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: [n, closed] for s, (n, closed) in _Folder(self.path).found().items()}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        new = []
        for stream, (n, closed) in sorted(end.items()):
            had, was_closed = start.get(stream, (0, False))
            if not was_closed and (n > had or closed):
                new.append(ChunkRange(stream, had, n, closed))
        return _packed(new, self.a_task)

    def commit(self, end: dict) -> None:
        if self.clean:
            folder = _Folder(self.path)
            for stream, (_, closed) in end.items():
                if closed and folder.files.get_file_info(f"{folder.root}/{stream}").type == fs.FileType.Directory:
                    folder.files.delete_dir(f"{folder.root}/{stream}")


class ChunkWriter(DataSourceWriter):
    """Rows (stream, value), a stream's rows one after another in one partition, as chunks of
    ``chunkBytes`` bytes whatever stands there. A task that runs again writes the same files again."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.bytes = options["path"], int(options.get("chunkbytes", CHUNK_BYTES))
        self.at = schema.fieldNames().index("stream"), schema.fieldNames().index("value")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folder = _Folder(self.path)
        stream, held, n = None, bytearray(), 0

        def put(name: str, content: bytes) -> None:
            with folder.files.open_output_stream(f"{folder.root}/{stream}/{name}") as f:
                f.write(content)

        def close() -> None:
            if stream is not None:
                if held:
                    put(_name(n), bytes(held))
                put(END, b"")

        for row in iterator:
            if row[self.at[0]] != stream:
                close()
                stream, held, n = row[self.at[0]], bytearray(), 0
                folder.files.create_dir(f"{folder.root}/{stream}", recursive=True)
            held += row[self.at[1]].encode() + b"\n"
            while len(held) >= self.bytes:
                put(_name(n), bytes(held[: self.bytes]))
                del held[: self.bytes]
                n += 1
        close()
        return WriterCommitMessage()


class NdjsonChunks(DataSource):
    """``spark.read`` or ``readStream.format("ndjson_chunks").load(path)``; options ``clean``,
    ``streamsPerTask``, and ``chunkBytes`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "ndjson_chunks"

    def schema(self) -> str:
        return SCHEMA

    def _plain(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(self._plain())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChunkStreamReader(self._plain())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChunkWriter(self._plain(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NdjsonChunks)
