"""WAV files as a data source of their own: read by ranges of bytes, and written whole or not at all.

``spark.read.format("wav").load(folder)`` gives the blocks that ``wav.read_blocks`` gives, but a long file is read by as
many tasks as its bytes make ranges: the driver reads headers only. ``write`` streams each recording to a file in one
task, a block at a time, into a folder of the job's own; files get their names when all tasks are done.

Paths are opened through Arrow, so local folders and the stores that Arrow knows work.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .wav import BLOCK, BLOCK_SCHEMA, decode, encode, header

_NAME = re.compile(r"([^/]*?)(\.[^./]*)?$")
_DERIVED = re.compile(r"_(processed|roomtone)\.wav$", re.IGNORECASE)
_FIELDS = pa.schema([
    ("rec", pa.string()), ("path", pa.string()), ("rate", pa.int32()), ("bits", pa.int32()), ("format", pa.string()), ("length", pa.int64()), ("ch", pa.int32()), ("n0", pa.int64()),
    ("block", pa.list_(pa.float32())),
])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Frames first to stop of a file."""

    path: str
    rate: int
    channels: int
    bits: int
    code: int
    begin: int
    length: int
    first: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__(None)


def layout(f, size: int, path: str) -> tuple[int, int, int, int, int, int]:
    """(rate, channels, bits, format code, first byte of the samples, frames) from a file's chunk headers alone."""
    if size < 12 or f.read(4) != b"RIFF":
        raise ValueError(f"not a RIFF file: {path}")
    f.seek(8)
    if f.read(4) != b"WAVE":
        raise ValueError(f"not a WAVE file: {path}")
    at, head, body = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            data = f.read(min(length, 40))
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data)
            head = rate, channels, bits, struct.unpack_from("<H", data, 24)[0] if code == 0xFFFE and len(data) >= 26 else code
        elif name == b"data":
            body = at + 8, min(length, size - at - 8)
        at += 8 + length + (length & 1)
    if body is None:
        raise ValueError(f"no data chunk: {path}")
    if head is None or head[1] == 0:
        raise ValueError(f"no channels: {path}")
    decode(b"", head[3], head[2])  # raises for what cannot be read
    return *head, body[0], body[1] // (head[1] * head[2] // 8)


class WavReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        store, path = _opened(self.path)
        found = store.get_file_info(path)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for info in sorted(files, key=lambda i: i.path):
            if not info.is_file or not info.path.lower().endswith(".wav") or _DERIVED.search(info.path) or "/_" in info.path[len(path) :]:
                continue
            with store.open_input_file(info.path) as f:
                rate, channels, bits, code, begin, length = layout(f, info.size, info.path)
            step = max(1, self.range_bytes // (channels * bits // 8) // BLOCK) * BLOCK
            out += [Range(info.path, rate, channels, bits, code, begin, length, a, min(a + step, length)) for a in range(0, max(1, length), step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, frame = partition, partition.channels * partition.bits // 8
        store, _ = _opened(self.path)
        rec, form = _NAME.search(p.path)[1], "float" if p.code == 3 else "int"
        with store.open_input_file(p.path) as f:
            for n0 in range(p.first, max(p.stop, p.first + 1), BLOCK):
                count = min(BLOCK, p.stop - n0)
                f.seek(p.begin + n0 * frame)
                x = decode(f.read(count * frame), p.code, p.bits).reshape(-1, p.channels).T.astype(np.float32)
                if x.shape[1] != count:
                    raise ValueError(f"cut off: {p.path}")
                rows = [{"rec": rec, "path": p.path, "rate": p.rate, "bits": p.bits, "format": form, "length": p.length, "ch": ch, "n0": n0, "block": v} for ch, v in enumerate(x)]
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class WavWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, form: str, suffix: str, overwrite: bool):
        self.path, self.bits, self.form, self.suffix, self.overwrite = path.rstrip("/"), bits, form, suffix, overwrite
        self.job = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, job = _opened(self.job)
        store.create_dir(job, recursive=True)
        made, out, rec, place, length, held, width = Written(), None, None, 0, 0, [], 0

        def put() -> None:
            nonlocal out, place, held, width
            if not held:
                return
            if out is None:
                width = len(held)
                out = store.open_output_stream(made.files[-1][0])
                out.write(header(length, width, rate, self.bits, self.form))
            if len(held) != width or [ch for ch, _ in held] != list(range(width)) or len({len(v) for _, v in held}) != 1:
                raise ValueError(f"recording {rec} lacks a channel's block at {place}")
            out.write(encode(np.array([v for _, v in held], dtype=np.float64), self.bits, self.form))
            place += len(held[0][1])
            held = []

        def end() -> None:
            nonlocal out, place
            put()
            if out is not None:
                out.close()
                if place != length:
                    raise ValueError(f"recording {rec} has {place} of {length} samples")
            out, place = None, 0

        try:
            for batch in iterator:
                for row in range(batch.num_rows):
                    at = {name: batch.column(name)[row] for name in ("rec", "rate", "length", "ch", "n0", "block")}
                    name, n0 = at["rec"].as_py(), at["n0"].as_py()
                    if name != rec:
                        end()
                        rec, rate, length = name, at["rate"].as_py(), at["length"].as_py()
                        made.files.append((f"{job}/{uuid.uuid4().hex}.wav", f"{rec}{self.suffix}.wav"))
                    elif held and n0 != place:
                        put()
                    if n0 != place:
                        raise ValueError(f"recording {rec} has no block at {place}")
                    held.append((at["ch"].as_py(), at["block"].values.to_numpy(zero_copy_only=False)))
            end()
        except BaseException:
            if out is not None:
                out.close()
            for temporary, _ in made.files:
                if store.get_file_info(temporary).is_file:
                    store.delete_file(temporary)
            raise
        return made

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        taken = [n for n in names if store.get_file_info(f"{path}/{n}").is_file]
        if len(set(names)) < len(names) or (taken and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"files are there already, or twice: {sorted(taken)[:5] or 'a recording in several tasks'}")
        for temporary, name in files:
            store.move(temporary, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, job = _opened(self.job)
        if store.get_file_info(job).type != fs.FileType.NotFound:
            store.delete_dir(job)


class WavSource(DataSource):
    """Options: path; rangeBytes (reading, 16 MiB); bits (24), form (int or float) and suffix of names (writing)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("rangeBytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        form = self.options.get("form", "int")
        return WavWriter(self.options["path"], int(self.options.get("bits", 24)), form, self.options.get("suffix", ""), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def read(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> DataFrame:
    """Blocks (rec, path, rate, bits, format, length, ch, n0, block) of the WAV files under ``path``, without derived ones."""
    register(spark)
    return spark.read.format("wav").option("rangeBytes", range_bytes).load(path)


def write(blocks: DataFrame, path: str, bits: int = 24, form: str = "int", suffix: str = "", overwrite: bool = False) -> None:
    """A file rec + ``suffix`` + .wav in ``path`` for each recording of ``blocks`` (rec, rate, length, ch, n0, block).

    A recording's blocks are sorted to one task, which holds one block of each channel. Missing blocks, and files that are
    there already unless ``overwrite``, stop the job, and nothing is left of it.
    """
    register(blocks.sparkSession)
    rows = blocks.select("rec", "rate", "length", "ch", "n0", "block").repartition("rec").sortWithinPartitions("rec", "n0", "ch")
    rows.write.format("wav").option("bits", bits).option("form", form).option("suffix", suffix).mode("overwrite" if overwrite else "append").save(path)
