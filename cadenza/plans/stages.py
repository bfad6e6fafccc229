"""Stages: table-valued steps over signals, a registry of them, parameters and presets, and the runner.

A stage takes samples (rec, n, x) and gives samples, a report of rows (rec, key, value) and, for some, more signals. Whether
it acts on a recording is a column of that recording, never a value fetched by the driver, so a batch of recordings is one
job; a recording that a stage declines keeps its samples as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import settle
from ..functions.num import adaptive_reduction, compressor_gain, db, expander_gain, lufs, nearest_rank
from ..operators import dereverb as wpe
from ..operators import clicks, envelope, equalise, frame_stats, islands, linear, longterm, loudness, metrics, peaks, ranks, recurrences, roomtone, transforms
from ..operators.spectra import hann
from ..sources.layout import in_chunk, lengths, with_halo


@dataclass
class Result:
    samples: DataFrame
    report: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Partial:
    """What a stage has worked out when both its samples and its report are still to be taken from it: ``rows``, which may be
    written before ``finish`` takes both, so that they are computed once."""

    rows: DataFrame
    finish: Callable[[DataFrame], Result]


@dataclass(frozen=True)
class Stage:
    name: str
    defaults: dict[str, float | str | bool]
    render: Callable[[DataFrame, dict, float], Result | Partial]
    #: The only rate the stage works at, if there is one.
    rate: float | None = None


class Registry:
    """Stages by name, in the order in which they were added."""

    def __init__(self) -> None:
        self._stages: dict[str, Stage] = {}

    def add(self, stage: Stage) -> None:
        if stage.name in self._stages:
            raise ValueError(f"stage {stage.name} is there already")
        self._stages[stage.name] = stage

    def get(self, name: str) -> Stage:
        if name not in self._stages:
            raise ValueError(f"unknown stage {name}; known: {', '.join(self._stages)}")
        return self._stages[name]

    def names(self) -> list[str]:
        return list(self._stages)


STAGES = Registry()


def stage(name: str, works_at: float | None = None, **defaults):
    def keep(f: Callable[[DataFrame, dict, float], Result]):
        STAGES.add(Stage(name, defaults, f, works_at))
        return f

    return keep


def facts(rows: DataFrame, *columns: str) -> DataFrame:
    """rec, key, value (text) of the named columns of one row a recording."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select("rec", F.inline(pairs))


def where_acting(samples: DataFrame, changed: DataFrame, acts: DataFrame) -> DataFrame:
    """``changed`` for recordings whose ``acts`` (rec, acts) is true, else ``samples`` untouched."""
    yes = acts.where("acts").select("rec")
    return samples.join(yes, "rec", "left_anti").unionByName(changed.join(yes, "rec", "left_semi").select("rec", "n", "x"))


def times(seconds: float, rate: float) -> int:
    return max(1, int(np.floor(seconds * rate + 0.5)))


def programme(samples: DataFrame, rate: float) -> DataFrame:
    """rec, lufs: gated loudness of 400 ms blocks, one every 100 ms, K-weighted."""
    hop = times(0.1, rate)
    return loudness.integrated(recurrences.k_weighted(samples, rate), 4 * hop, hop).select("rec", "lufs")


def quiet_ranges(samples: DataFrame, rate: float, fraction: float = 0.25, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(silences, thresholds): runs of frames under floor + fraction * (programme - floor), and rec, floor, threshold, lufs."""
    hop, window = times(0.025, rate), times(0.1, rate)
    weighted = recurrences.k_weighted(samples, rate)
    frames = loudness.centered_windows(weighted, window, hop).withColumn("l", lufs(F.col("z")))
    low = ranks.at_ranks(frames.select("rec", F.col("l").alias("v")), {"floor": lambda n: nearest_rank(n, 10)}).select("rec", "floor")
    levels = low.join(programme(samples, rate), "rec").withColumn("threshold", F.col("floor") + fraction * (F.col("lufs") - F.col("floor")))
    judged = frames.join(levels.select("rec", "threshold"), "rec")
    runs = max(1, int(np.ceil(least * rate / hop)))
    return islands.silences(judged, F.col("l").isNull() | (F.col("l") < F.col("threshold")), hop, runs, lengths(samples)), levels


def detector(samples: DataFrame, rate: float, seconds: float = 0.015) -> DataFrame:
    """rec, n, x: trailing RMS level in dB, at least -240."""
    width = times(seconds, rate)
    rows = with_halo(samples, width - 1, 0).withColumn("p", F.avg(F.col("x") * F.col("x")).over(in_chunk(-(width - 1), 0))).where("core")
    return rows.select("rec", "n", F.greatest(F.lit(-240.0), F.coalesce(db(F.sqrt("p")), F.lit(-240.0))).alias("x"))


def dynamics(samples: DataFrame, rate: float, acts: DataFrame, curve: Callable[[Column, Column], Column], down_ms: float, up_ms: float) -> tuple[DataFrame, DataFrame]:
    """(changed samples, rec with the largest reduction and the share of samples moved) for a static curve of level and the
    recording's threshold."""
    level = detector(samples, rate).join(acts.select("rec", "threshold"), "rec")
    targets = level.select("rec", "n", curve(F.col("x"), F.col("threshold")).alias("x"))
    gains = recurrences.smoothed(targets, recurrences.coefficient(down_ms, rate), recurrences.coefficient(up_ms, rate))
    stats = gains.groupBy("rec").agg((-F.min("gain_db")).alias("max_reduction_db"), F.avg((F.abs("gain_db") > 0.1).cast("double")).alias("active"))
    return envelope.apply_gain(samples, gains), stats


@stage("declick", threshold=6.0, block=0.01, order=32, max_burst=0.002, max_share=0.02)
def declick(samples: DataFrame, p: dict, rate: float) -> Result:
    """Interpolates short bursts over ``threshold`` sigma that stand alone; too many make the stage keep its hands off."""
    block, most = max(4 * p["order"], times(p["block"], rate)), times(p["max_burst"], rate)
    short = linear.detected(samples, int(p["order"]), block, p["threshold"]).where(F.col("end") - F.col("start") <= most)
    found = clicks.density_guard(short, block, 0.05)
    alone = clicks.pulse_veto(found, times(0.0025, rate), times(0.02, rate), 0.3)
    merged = islands.merge_intervals(alone.select("rec", F.col("start").alias("first"), (F.col("end") - 1).alias("last")), 5)
    bursts = merged.select("rec", F.greatest(F.lit(0), F.col("first") - 2).alias("start"), (F.col("last") + 3).alias("end")).where(F.col("end") - F.col("start") <= most + 4)
    counts = lengths(samples).join(bursts.groupBy("rec").agg(F.count(F.lit(1)).alias("bursts"), F.sum(F.col("end") - F.col("start")).alias("covered")), "rec", "left").fillna(0)
    acts = counts.withColumn("acts", (F.col("bursts") > 0) & (F.col("covered") <= p["max_share"] * F.col("length")))
    changed = linear.repaired(samples, bursts, int(p["order"]), block)
    return Result(where_acting(samples, changed, acts), facts(acts, "bursts", "covered", "acts"))


@stage("denoise", reduction=12.0, clean_snr=35.0, max_loss=3.0)
def denoise(samples: DataFrame, p: dict, rate: float) -> Partial:
    """Wiener gains against each recording's noise by bin; declines clean material, and takes back what costs programme.

    The noise is the mean of the frames inside pauses, or, where those are fewer than four, the quietest fifth of each bin's
    frames. The reduction falls with the signal-to-noise ratio; a recording without one gets what is asked for.
    """
    pauses, levels = quiet_ranges(samples, rate)
    floor = loudness.range_loudness(samples, pauses.select("rec", "i", "start", "end")).groupBy("rec").agg(F.avg("z").alias("z"))
    snr = levels.join(floor, "rec", "left").withColumn("snr", F.col("lufs") - (10.0 * F.log10(F.greatest("z", F.lit(1e-20))) - 0.691))
    applied = adaptive_reduction(p["clean_snr"], F.col("snr"), p["reduction"])
    acts = snr.withColumn("applied", F.coalesce(applied, F.lit(float(p["reduction"])))).withColumn("acts", F.col("applied") > 0)
    noisy = samples.join(acts.where("acts").select("rec"), "rec", "left_semi")
    size, hop = 1024, 256
    window = np.sqrt(hann(size))
    heard = longterm.range_spectrum(noisy, pauses, window, hop, anchored=False)
    unheard = longterm.quietest_spectrum(noisy.join(heard.select("rec").distinct(), "rec", "left_anti"), lengths(noisy), window, hop)
    profile = heard.withColumn("pauses", F.lit(True)).unionByName(unheard.withColumn("pauses", F.lit(False)))
    profile = profile.groupBy("rec", "pauses").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("bins")).select("rec", "pauses", F.col("bins.p").alias("noise"))
    settings = profile.select("rec", "noise").join(acts.select("rec", "applied"), "rec")

    def finish(rows: DataFrame) -> Result:
        changed = frame_stats.signal(rows)
        loss = programme(changed, rate).withColumnRenamed("lufs", "after").join(levels.select("rec", "lufs"), "rec").select("rec", (F.col("lufs") - F.col("after")).alias("loss"))
        kept = acts.join(loss, "rec", "left").join(profile.select("rec", "pauses"), "rec", "left").join(frame_stats.denoise_report(rows), "rec", "left")
        kept = kept.withColumn("acts", F.col("acts") & F.col("pauses").isNotNull() & (F.coalesce("loss", F.lit(0.0)) <= p["max_loss"]))
        return Result(where_acting(samples, changed, kept), facts(kept, "snr", "applied", "pauses", "loss", "noise_gain_db", "speech_gain_db", "acts"))

    return Partial(frame_stats.denoised(noisy, settings, size, hop, 402, chunk=1 << 17), finish)


@stage("dereverb", min_decay_ms=90.0, taps=20, delay=3, iterations=3, frame_size=4096, hop_size=1024, regularisation=1e-4)
def dereverb(samples: DataFrame, p: dict, rate: float) -> Result:
    """Predicts late reverberation away where the decay is longer than ``min_decay_ms``; tells the decay before and after."""
    measured = lambda x: metrics.decay(x, times(0.005, rate), 20.0, 25.0, 200).select("rec", (F.col("frames") * 5.0).alias("ms"))
    acts = lengths(samples).join(measured(samples).withColumnRenamed("ms", "decay_ms"), "rec", "left")
    acts = acts.withColumn("acts", F.coalesce(F.col("decay_ms") >= p["min_decay_ms"], F.lit(False)))
    wet = samples.join(acts.where("acts").select("rec"), "rec", "left_semi")
    size, hop = int(p["frame_size"]), int(p["hop_size"])
    changed = wpe.dereverberated(wet, size, hop, int(p["taps"]), int(p["delay"]), int(p["iterations"]), p["regularisation"])
    acts = acts.join(measured(changed).withColumnRenamed("ms", "after_ms"), "rec", "left").withColumn("after_ms", F.when(F.col("acts"), F.col("after_ms")).otherwise(F.col("decay_ms")))
    acts = acts.withColumn("bins", F.when(F.col("acts"), size // 2 + 1).otherwise(0))
    return Result(where_acting(samples, changed, acts), facts(acts, "decay_ms", "after_ms", "bins", "acts"))


@stage("eq", voicing="warm", rumble_hz=80.0, rumble_margin=-12.0, max_bands=5, min_deviation=2.0, max_cut=6.0, max_boost=3.0)
def eq(samples: DataFrame, p: dict, rate: float) -> Result:
    """Pulls each recording's speech spectrum towards its own broad shape, takes rumble out where there is some, and voices.

    Bands are fitted to the deviation of the speech frames' mean spectrum; a boost needs enough level over the pauses. The
    high-pass comes on where the band under ``rumble_hz`` stands over the voice's by ``rumble_margin``. A recording with fewer
    than four frames of speech is left alone.
    """
    size = min(8192, 1 << int(np.floor(np.log2(rate * 0.17))))
    pauses, _ = quiet_ranges(samples, rate)
    speech = islands.complement(pauses, lengths(samples))
    spectra = longterm.range_spectrum(samples, speech, hann(size), size // 2)
    noise = longterm.log_curves(longterm.range_spectrum(samples, pauses, hann(size), size // 2), rate, size)
    curves = longterm.with_target(longterm.log_curves(spectra, rate, size))
    curves = curves.join(noise.select("rec", "i", F.col("db").alias("noise_db")), ["rec", "i"], "left").withColumn("snr", F.col("db") - F.col("noise_db"))
    bands = equalise.fit_curves(curves, rate, most=int(p["max_bands"]), least_db=p["min_deviation"], cut=p["max_cut"], boost=p["max_boost"])
    lists = bands.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", "freq", "gain_db", "q"))).alias("bands"))
    low = longterm.band_levels(spectra, rate, size, 20, p["rumble_hz"], "sub").join(longterm.band_levels(spectra, rate, size, 120, 300, "voice"), "rec")
    rumble = low.select("rec", (F.col("sub") - F.col("voice")).alias("rumble_excess")).withColumn("rumble", F.col("rumble_excess") > p["rumble_margin"])
    told = spectra.select("rec", F.col("frames").alias("speech_frames")).distinct().join(lists, "rec", "left").join(rumble, "rec", "left")
    told = told.withColumn("rumble", F.coalesce("rumble", F.lit(False))).withColumn("bands", F.coalesce("bands", F.array().cast("array<struct<i:int,freq:double,gain_db:double,q:double>>")))
    voiced = bool(equalise.VOICINGS[p["voicing"]])
    acts = lengths(samples).join(told, "rec", "left").withColumn("acts", F.coalesce(F.col("rumble") | (F.size("bands") > 0) | F.lit(voiced), F.lit(False)) & F.col("speech_frames").isNotNull())

    def change(x: np.ndarray, own) -> np.ndarray:
        fitted = [equalise.Band(b["freq"], b["gain_db"], b["q"]) for b in own["bands"]]
        return recurrences.cascade(x, equalise.cascade_of(fitted, rate, p["rumble_hz"] if own["rumble"] else None, p["voicing"]))

    # The slowest filter that may come about: the high-pass, and a band of the highest Q at the lowest frequency.
    reach = settle(equalise.cascade_of([equalise.Band(80.0, -p["max_cut"], 4.0)], rate, p["rumble_hz"], p["voicing"]))
    changed = longterm.by_recording(samples, acts.where("acts").select("rec", "bands", "rumble"), change, reach)
    shown = acts.withColumn("band_count", F.size("bands")).withColumn("bands", F.to_json("bands"))
    return Result(where_acting(samples, changed, acts), facts(shown, "bands", "band_count", "rumble", "rumble_excess", "speech_frames", "acts"))


@stage("dyneq")
def dyneq(samples: DataFrame, p: dict, rate: float) -> Partial:
    """Holds down what stands out of its surroundings while it does; tells how far, on average and at most, and how often."""

    def finish(rows: DataFrame) -> Result:
        changed = frame_stats.signal(rows)
        told = frame_stats.dynamic_eq_report(rows).join(metrics.change_db(samples, changed), "rec", "left")
        return Result(changed, facts(told, "max_reduction_db", "mean_reduction_db", "active", "change_db"))

    return Partial(frame_stats.dynamic_eq(samples, rate), finish)


@stage("expand", threshold=-27.0, ratio=2.8, knee=8.0, range=12.0, open_ms=5.0, close_ms=150.0, clean_floor=50.0)
def expand(samples: DataFrame, p: dict, rate: float) -> Result:
    """Turns down what lies under a threshold relative to the programme; declines where there are no pauses with a level, or
    where they lie more than ``clean_floor`` dB under the programme already."""
    pauses, heard = quiet_ranges(samples, rate)
    size = F.col("end") - F.col("start")

    def pause_level(signal: DataFrame) -> DataFrame:
        inside = loudness.range_loudness(recurrences.k_weighted(signal, rate), pauses.select("rec", "i", "start", "end")).where("z > 0")
        return inside.groupBy("rec").agg((lufs(F.sum(F.col("z") * size) / F.sum(size))).alias("pause_lufs"))

    levels = lengths(samples).join(heard.select("rec", "lufs"), "rec", "left").join(pause_level(samples), "rec", "left")
    acts = levels.withColumn("threshold", F.col("lufs") + p["threshold"]).withColumn("floor_distance", F.col("lufs") - F.col("pause_lufs"))
    acts = acts.withColumn("acts", F.coalesce(F.col("floor_distance") <= p["clean_floor"], F.lit(False)))
    curve = lambda x, t: expander_gain(x - t, 0.0, p["ratio"], p["knee"], p["range"])
    changed, stats = dynamics(samples, rate, acts.where("acts"), curve, p["close_ms"], p["open_ms"])
    told = acts.join(stats, "rec", "left").join(pause_level(changed).withColumnRenamed("pause_lufs", "now"), "rec", "left")
    told = told.withColumn("floor_reduction_db", F.coalesce(F.col("pause_lufs") - F.col("now"), F.lit(0.0)))
    return Result(where_acting(samples, changed, acts), facts(told, "threshold", "floor_distance", "floor_reduction_db", "max_reduction_db", "active", "acts"))


@stage("compress", threshold=-2.0, ratio=1.7, knee=10.0, range=12.0, attack_ms=33.0, release_ms=168.0, min_lra=3.0)
def compress(samples: DataFrame, p: dict, rate: float) -> Result:
    """Evens the programme out where its loudness range is at least ``min_lra``."""
    window = times(1.0, rate)
    spread = lambda signal: loudness.loudness_range(recurrences.k_weighted(signal, rate), 3 * window, window)
    levels = lengths(samples).join(programme(samples, rate), "rec", "left").join(spread(samples), "rec", "left")
    acts = levels.withColumn("threshold", F.col("lufs") + p["threshold"]).withColumn("acts", F.coalesce(F.col("lra") >= p["min_lra"], F.lit(False)))
    curve = lambda x, t: compressor_gain(x - t, 0.0, p["ratio"], p["knee"], p["range"])
    changed, stats = dynamics(samples, rate, acts.where("acts"), curve, p["attack_ms"], p["release_ms"])
    told = acts.join(stats, "rec", "left").join(spread(changed).withColumnRenamed("lra", "after"), "rec", "left").withColumn("lra_after", F.coalesce("after", "lra"))
    return Result(where_acting(samples, changed, acts), facts(told, "lra", "lra_after", "max_reduction_db", "active", "acts"))


@stage("level", target=-18.0, max_gain=30.0, ceiling=-1.0, min_silence=1.0)
def level(samples: DataFrame, p: dict, rate: float) -> Result:
    """Brings each segment between silences to the target, limits true peaks, and gives a bed of room tone."""
    pauses, levels = quiet_ranges(samples, rate, least=p["min_silence"])
    weighted, size = recurrences.k_weighted(samples, rate), lengths(samples)
    parts = loudness.range_loudness(weighted, islands.segments(pauses, size)).join(levels.select("rec", F.col("threshold").alias("limit")), "rec", "left")
    # The threshold is each recording's own: levels are moved so that it is 0, and the target with it.
    shifted = parts.withColumn("z", F.col("z") * F.pow(F.lit(10.0), -F.coalesce("limit", F.lit(0.0)) / 10.0))
    gains = envelope.segment_gains(shifted, 0.0, 0.0, 1e9)
    own = F.greatest(F.lit(-p["max_gain"]), F.least(F.lit(p["max_gain"]), F.col("filled_db") + p["target"] - F.coalesce("limit", F.lit(0.0))))
    gains = gains.withColumn("filled_db", own)
    gained = envelope.apply_gain(samples, envelope.gain_envelope(samples, envelope.breakpoints(gains, pauses, size)))
    ceiling = 10 ** (p["ceiling"] / 20)
    peak = peaks.true_peak_envelope(gained)
    required = peak.select("rec", "n", F.least(F.lit(1.0), ceiling / F.greatest("peak", F.lit(1e-12))).alias("x"))
    forward = recurrences.limiter_gain(required, recurrences.coefficient(50.0, rate))
    attack = recurrences.coefficient(5.0, rate)
    reach = int(np.ceil(np.log(1e-12) / np.log(attack)))
    ramp = envelope.backward_ramp(forward, attack, reach, max(1 << 10, reach))
    limited = gained.join(ramp, ["rec", "n"]).select("rec", "n", (F.col("x") * F.col("gain")).alias("x"))
    clips = roomtone.best_windows(samples, pauses.select("rec", "i", (F.col("start") + times(0.15, rate)).alias("start"), (F.col("end") - times(0.15, rate)).alias("end")).where(F.col("end") - F.col("start") >= times(0.3, rate)), times(1.0, rate), times(0.02, rate), times(0.01, rate))
    tone = roomtone.bed(samples, roomtone.keep_clean(clips, 6.0), times(10.0, rate), times(0.05, rate), times(0.02, rate))
    stats = levels.join(forward.groupBy("rec").agg(F.min("gain").alias("limiter_gain")), "rec", "left")
    counts = gains.groupBy("rec").agg(F.count(F.lit(1)).alias("segments"), F.count_if("is_speech").alias("speech"))
    return Result(limited, facts(stats.join(counts, "rec", "left"), "lufs", "threshold", "floor", "segments", "speech", "limiter_gain"), {"roomtone": tone})


PRESETS: dict[str, dict] = {
    "Default": {"bypass": (), "params": {}},
    "ACX": {"bypass": (), "params": {
        "level": {"target": -20.0, "ceiling": -3.5}, "eq": {"voicing": "neutral"}, "denoise": {"reduction": 16.0, "clean_snr": 45.0},
        "expand": {"range": 16.0, "clean_floor": 65.0}, "compress": {"ratio": 2.2, "min_lra": 2.0},
    }},
}


def preset(name: str) -> dict:
    """A preset by name, whatever its case."""
    for known, settings in PRESETS.items():
        if known.lower() == name.lower():
            return settings
    raise ValueError(f"unknown preset {name}; known: {', '.join(PRESETS)}")


def working_rate(stages: list[Stage], source: float) -> float:
    """The rate at which a chain of these stages runs: theirs, or the source's where none asks for one."""
    asked = {s.rate for s in stages if s.rate is not None}
    if len(asked) > 1:
        raise ValueError(f"stages disagree on the sample rate: {', '.join(f'{s.name} {s.rate:g}' for s in stages if s.rate is not None)}")
    return asked.pop() if asked else source


def at_rate(samples: DataFrame, source: float, target: float, size: DataFrame | None = None) -> DataFrame:
    """``samples`` at another rate, the same DataFrame where the rates are equal; cut to ``size`` (rec, length) if given."""
    made = transforms.resampled(samples, source, target)
    return made if size is None or made is samples else made.join(size, "rec").where("n < length").select("rec", "n", "x")


def run_chain(
    samples: DataFrame, rate: float, only: list[str] | None = None, bypass: list[str] | None = None, params: dict[str, dict] | None = None,
    between: Callable[[DataFrame, str], DataFrame] | None = None, registry: Registry = STAGES,
) -> Result:
    """Samples through the stages in their order.

    ``only`` keeps some, ``bypass`` passes over some (their samples are then the same DataFrame), ``params`` goes over the
    defaults. ``between`` may materialise what a stage gives. The report has stage, ord, rec, key and value. Where a stage
    that runs asks for a rate, samples are brought to it once, and what comes out goes back to ``rate`` and its length.
    """
    for name in {*(only or ()), *(bypass or ()), *(params or {})}:
        registry.get(name)
    chosen = [n for n in registry.names() if only is None or n in only]
    working = working_rate([registry.get(n) for n in chosen if n not in (bypass or ())], rate)
    keep = between or (lambda df, _: df)
    size = lengths(samples) if working != rate else None
    if size is not None:
        samples = keep(at_rate(samples, rate, working), "resampled")
    report, extras = None, {}
    for ord_, name in enumerate(chosen):
        if name in (bypass or ()):
            continue
        found = registry.get(name)
        unknown = set((params or {}).get(name, ())) - set(found.defaults)
        if unknown:
            raise ValueError(f"stage {name} has no parameter {', '.join(sorted(unknown))}")
        result = found.render(samples, {**found.defaults, **(params or {}).get(name, {})}, working)
        if isinstance(result, Partial):
            result = result.finish(keep(result.rows, f"{name}-rows"))
        samples = keep(result.samples, name)
        told = result.report.select(F.lit(name).alias("stage"), F.lit(ord_).alias("ord"), "rec", "key", "value")
        report = told if report is None else report.unionByName(told)
        twice = extras.keys() & result.extras.keys()
        if twice:
            raise ValueError(f"two stages give {', '.join(sorted(twice))}")
        extras |= result.extras
    if report is None:
        report = samples.sparkSession.createDataFrame([], "stage string, ord int, rec string, key string, value string")
    return Result(at_rate(samples, working, rate, size), report, {name: at_rate(extra, working, rate) for name, extra in extras.items()})
