"""WAV files as sample tables, and back.

Reading goes by Spark's binary file source, so to any store that Spark reaches; a file is decoded in one task and leaves it
in blocks. Writing gives each recording one row of file bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 16
BLOCK_SCHEMA = "rec string, path string, rate int, bits int, format string, length bigint, ch int, n0 bigint, block array<float>"


def parse(data: bytes) -> tuple[dict, np.ndarray]:
    """(rate, channels, bits, format; samples by channel) of a RIFF/WAVE file; raises ValueError for what is none."""
    if data[:4] != b"RIFF":
        raise ValueError("not a RIFF file")
    if data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    head: tuple | None = None
    body: bytes | None = None
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunk)
            if code == 0xFFFE and len(chunk) >= 26:
                code = struct.unpack_from("<H", chunk, 24)[0]
            head = code, channels, rate, bits
        elif name == b"data":
            body = chunk
        at += 8 + size + (size & 1)
    if body is None:
        raise ValueError("no data chunk")
    if head is None or head[1] == 0:
        raise ValueError("no channels")
    code, channels, rate, bits = head
    frame = channels * bits // 8
    body = body[: len(body) // frame * frame]
    return {"rate": rate, "channels": channels, "bits": bits, "format": "float" if code == 3 else "int"}, decode(body, code, bits).reshape(-1, channels).T


def decode(body: bytes, code: int, bits: int) -> np.ndarray:
    if code == 3 and bits in (32, 64):
        return np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    if code == 1 and bits == 8:
        return (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    if code == 1 and bits in (16, 32):
        return np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    if code == 1 and bits == 24:
        wide = np.zeros((len(body) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        return (wide.view("<i4").reshape(-1) >> 8) / float(1 << 23)
    raise ValueError(f"cannot read format {code} at {bits} bits")


def header(frames: int, channels: int, rate: int, bits: int, form: str) -> bytes:
    """The 44 bytes ahead of the samples of a WAV file; raises ValueError for what such a file cannot hold."""
    if (form, bits) not in {("float", 32), ("float", 64), ("int", 8), ("int", 16), ("int", 24), ("int", 32)}:
        raise ValueError(f"cannot write {form} at {bits} bits")
    frame = channels * bits // 8
    if 36 + frames * frame >= 1 << 32:
        raise ValueError("a WAV file holds under 4 GiB")
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + frames * frame, b"WAVE", b"fmt ", 16, 3 if form == "float" else 1, channels, rate, rate * frame, frame, bits, b"data", frames * frame)


def encode(channels: np.ndarray, bits: int, form: str) -> bytes:
    """Samples (channels, frames) as a WAV file has them; whole numbers are rounded (halves up) and clipped."""
    if form == "float":
        return channels.T.astype(f"<f{bits // 8}").tobytes()
    full = float(1 << (bits - 1))
    q = np.clip(np.floor(channels.T * full + 0.5), -full, full - 1).astype("<i8")
    return (q + 128).astype(np.uint8).tobytes() if bits == 8 else np.ascontiguousarray(q).view(np.uint8).reshape(*q.shape, 8)[..., : bits // 8].tobytes()


def render(channels: np.ndarray, rate: int, bits: int = 24, form: str = "int") -> bytes:
    """A WAV file with a 44-byte header."""
    return header(channels.shape[1], len(channels), rate, bits, form) + encode(channels, bits, form)


def derived(path: Column) -> Column:
    """Whether a path is an output of processing, by its name."""
    return path.rlike(r"(?i)_(processed|roomtone)\.wav$")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def output_path(path: Column, key: str = "processed") -> Column:
    return F.concat(F.regexp_replace(path, r"(?i)\.wav$", ""), F.lit(f"_{key}.wav"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of samples of the WAV files under ``path``, without derived ones: rec, path, rate, bits, format, length, ch, n0
    and block. A file that is no WAV file stops the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    files = files.where(~derived(F.col("path"))).select(base_name(F.col("path")).alias("rec"), "path", "content")

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                head, samples = parse(row.content)
                for ch, x in enumerate(samples):
                    for n0 in range(0, max(1, len(x)), BLOCK):
                        yield pd.DataFrame({
                            "rec": [row.rec], "path": [row.path], "rate": [head["rate"]], "bits": [head["bits"]], "format": [head["format"]],
                            "length": [len(x)], "ch": [ch], "n0": [n0], "block": [x[n0 : n0 + BLOCK].astype(np.float32)],
                        })

    return files.mapInPandas(blocks, BLOCK_SCHEMA)


def samples_of(blocks: DataFrame) -> DataFrame:
    """rec, ch, n, x of blocks."""
    return blocks.select("rec", "ch", "n0", F.posexplode("block").alias("i", "x")).select("rec", "ch", (F.col("n0") + F.col("i")).alias("n"), "x")


def recordings_of(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("rec", "path", "rate", "bits", "format", "length").agg((F.max("ch") + 1).alias("channels"))


def files_of(blocks: DataFrame, bits: int = 24, form: str = "int") -> DataFrame:
    """rec, content: the bytes of a WAV file for each recording, which has to fit a task's memory to be one file."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ch", "n0"])
        channels = np.array([np.concatenate(list(g)) for _, g in part.groupby("ch")["block"]])
        return pd.DataFrame({"rec": [part["rec"].iloc[0]], "content": [render(channels.astype(np.float64), int(part["rate"].iloc[0]), bits, form)]})

    return blocks.select("rec", "rate", "ch", "n0", "block").groupBy("rec").applyInPandas(build, "rec string, content binary")
