"""The WAV data source: ranges of one file over tasks, round trips of every format, and jobs that fail."""

import struct

import numpy as np
import pytest

from cadenza.sources import wav, wav_source


def tone(channels, n, seed=1):
    return np.random.default_rng(seed).uniform(-1, 1, size=(channels, n))


def samples(df):
    got = wav.samples_of(df).toPandas().sort_values(["rec", "ch", "n"])
    return {(rec, ch): g["x"].to_numpy() for (rec, ch), g in got.groupby(["rec", "ch"])}


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    x = tone(2, 3 * wav.BLOCK + 77)
    (tmp_path / "long take.WAV").write_bytes(wav.render(x, 48000, 16))
    (tmp_path / "long take_processed.wav").write_bytes(b"RIFF")
    (tmp_path / "short.wav").write_bytes(wav.render(x[:1, :0], 8000, 32, "float"))
    blocks = wav_source.read(spark, str(tmp_path), 1 << 18)
    assert blocks.rdd.getNumPartitions() == 5
    assert {(r.rec, r.rate, r.length, r.channels) for r in wav.recordings_of(blocks).collect()} == {("long take", 48000, 3 * wav.BLOCK + 77, 2), ("short", 8000, 0, 1)}
    got, plain = samples(blocks), samples(wav.read_blocks(spark, str(tmp_path / "long take.WAV")))
    for ch in (0, 1):
        assert (got["long take", ch] == plain["long take", ch]).all() and len(got["long take", ch]) == x.shape[1]


@pytest.mark.parametrize(("bits", "form"), [(8, "int"), (16, "int"), (24, "int"), (32, "int"), (32, "float"), (64, "float")])
def test_round_trip(spark, tmp_path, bits, form):
    (tmp_path / "in").mkdir()
    for rec, channels, n in (("a", 2, wav.BLOCK + 5), ("b", 1, 9)):
        (tmp_path / "in" / f"{rec}.wav").write_bytes(wav.render(tone(channels, n), 44100, bits, form))
    blocks = wav_source.read(spark, str(tmp_path / "in"), 1 << 16)
    wav_source.write(blocks, str(tmp_path / "out"), bits, form, "_x")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_x.wav", "b_x.wav"]
    back = samples(wav_source.read(spark, str(tmp_path / "out")))
    for (rec, ch), x in samples(blocks).items():
        assert np.abs(back[f"{rec}_x", ch] - x).max() <= (0 if bits != 32 or form == "float" else 2**-23)
    if bits in (8, 16, 24):
        assert (tmp_path / "out" / "b_x.wav").read_bytes() == (tmp_path / "in" / "b.wav").read_bytes()


def test_extensible_header_and_other_chunks(spark, tmp_path):
    x = tone(1, 100)
    plain = wav.render(x, 8000, 16)
    fmt = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 4) + struct.pack("<H", 1) + bytes(14)
    data = plain[44:]
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    (tmp_path / "e.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert (samples(wav_source.read(spark, str(tmp_path)))["e", 0] == (wav.parse(plain)[1][0]).astype(np.float32)).all()


@pytest.mark.parametrize(("data", "says"), [(b"junk" * 20, "RIFF"), (b"RIFF" + bytes(40), "WAVE"), (wav.render(np.zeros((1, 4)), 8000, 16)[:36], "data"), (wav.render(np.zeros((1, 4)), 8000, 16)[:20] + b"\7" + bytes(40), "no data|cannot read")])
def test_what_is_no_wav_file_stops_the_job(spark, tmp_path, data, says):
    (tmp_path / "bad.wav").write_bytes(data)
    with pytest.raises(Exception, match=says):
        wav_source.read(spark, str(tmp_path)).count()


def test_jobs_that_fail_leave_nothing(spark, tmp_path):
    schema = "rec string, rate int, length bigint, ch int, n0 bigint, block array<float>"
    good = [(f"r{i}", 8000, 4, ch, n0, [0.5, 0.25]) for i in range(6) for ch in (0, 1) for n0 in (0, 2)]
    out = tmp_path / "out"
    for broken in (good[:-1], [r for r in good if r[:5] != ("r3", 8000, 4, 0, 2)], good + [("x", 8000, 9, 0, 0, [0.0])]):
        with pytest.raises(Exception, match="recording"):
            wav_source.write(spark.createDataFrame(broken, schema).repartition(3), str(out))
        assert not out.exists() or not list(out.rglob("*.wav")) and not [p for p in out.iterdir()]
    frame = spark.createDataFrame(good, schema).repartition(3)
    wav_source.write(frame, str(out), 16)
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    assert len(before) == 6
    with pytest.raises(Exception, match="there already"):
        wav_source.write(frame, str(out), 24)
    assert {p.name: p.read_bytes() for p in out.iterdir()} == before
    wav_source.write(frame, str(out), 24, overwrite=True)
    assert len((out / "r0.wav").read_bytes()) == 44 + 4 * 2 * 3
