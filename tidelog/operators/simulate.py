"""Simulated flights: phases by index as expressions, and samples as a fold in order for each session."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.layout import STATUS

# Fixed values of the profile: samples of each phase, targets and rates.
PHASES = [("Startup", 25), ("Takeoff", 20), ("Climb", 70), ("Cruise", 120), ("Descent", 65), ("Landing", 35)]
TOTAL, WRAP = 335, 115
RAMPS = {  # altitude, airspeed, vertical speed, temperature, rpm: from and to; heading rate
    "Startup": ((340, 340), (0, 0), (0, 0), (35, 245), (650, 1000), 0.02),
    "Takeoff": ((340, 720), (25, 155), (400, 2200), (250, 645), (1800, 2550), 0.12),
    "Climb": ((720, 3650), (150, 205), (1900, 950), (640, 690), (2500, 2350), 0.20),
    "Descent": ((3600, 780), (215, 138), (-750, -1450), (645, 555), (2050, 1680), -0.06),
    "Landing": ((780, 345), (132, 18), (-900, -120), (520, 180), (1550, 760), -0.03),
}
WAVES = ((3650, 0.35, 35), (228, 0.55, 4.5), (0, 0.28, 65), (662, 0.42, 8), (2220, 0.40, 28))
CRUISE_HEADING = 0.08
TRACKING = ((0.12, 0.6, 0.0), (0.18, 0.45, 0.0), (0.22, 8.0, -math.inf), (0.16, 0.8, 20.0), (0.20, 4.0, 0.0))  # factor, noise, floor
SPIKE, DROP, GLITCH = (110, 150, 9), (220, 250, 4), (155, 205, 3)
START = (340.0, 0.0, 0.0, 30.0, 0.0)
START_HEADING, TURN_STEP, TURN_WAVE, TURN_SIZE = 74.0, 0.065, 0.18, 0.05
SPIKE_RISE, SPIKE_SLOPE, SPIKE_PEAK = 28.0, 4.2, 4.0
DROP_ALTITUDE, DROP_VERTICAL = 45.0, 650.0
GLITCH_EVEN, GLITCH_ODD, GLITCH_HEADING = 18.0, -14.0, 8.0
HOT_ENGINE, OIL_RPM, OIL_TEMPERATURE = 675.0, 850.0, 80.0


def profile_index(n: Column) -> Column:
    """Place in the profile of sample n: from cruise on, the profile repeats."""
    return F.when(n < TOTAL, n).otherwise(WRAP + (n - WRAP) % (TOTAL - WRAP))


def phase(index: Column) -> Column:
    out, end = F.lit(PHASES[-1][0]), TOTAL
    for (name, length), after in zip(reversed(PHASES[:-1]), reversed([p[1] for p in PHASES[1:]]), strict=True):
        end -= after
        out = F.when(index < end, name).otherwise(out)
    return out


def phase_rows(spark: SparkSession, samples: int) -> DataFrame:
    """sample, profile_index, phase, transition: without state, for any range of samples."""
    n = F.col("sample")
    rows = spark.range(samples).withColumnRenamed("id", "sample").withColumn("profile_index", profile_index(n)).withColumn("phase", phase(F.col("profile_index")))
    before = phase(profile_index(F.greatest(n - 1, F.lit(0))))
    return rows.withColumn("transition", (n > 0) & (F.col("phase") != before))


def smoothstep(x: float) -> float:
    x = min(1.0, max(0.0, x))
    return x * x * (3 - 2 * x)


def _place(i: int) -> tuple[str, float]:
    start = 0
    for name, length in PHASES:
        if i < start + length:
            return name, smoothstep((i - start) / max(length - 1, 1))
        start += length
    raise ValueError(i)


PLACES = [_place(i) for i in range(TOTAL)]


@dataclass
class Simulator:
    """next_sample in order. The random numbers are numpy's; rules, ranges and flags are what counts, not the last digits."""

    seed: int = 42

    def __post_init__(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        self.values, self.heading, self.turn, self.index, self.last = list(START), START_HEADING, 0.0, 0, "Startup"
        self.spike, self.drop, self.glitch = (int(self.rng.integers(a, b + 1)) for a, b, _ in (SPIKE, DROP, GLITCH))

    def next_sample(self, timestamp_us: int, overrun: bool = False) -> tuple:
        name, progress = PLACES[self.index]
        self.turn += TURN_STEP
        if name == "Cruise":
            targets, rate = [base + math.sin(self.turn * f) * size for base, f, size in WAVES], CRUISE_HEADING
        else:
            *ramps, rate = RAMPS[name]
            targets = [a + (b - a) * progress for a, b in ramps]
        noise = self.rng.uniform(-1.0, 1.0, 5)
        self.values = [max(floor, v + (t - v) * k + n * size) for v, t, n, (k, size, floor) in zip(self.values, targets, noise, TRACKING, strict=True)]
        self.heading = (self.heading + rate + math.sin(self.turn * TURN_WAVE) * TURN_SIZE) % 360
        status = STATUS["nominal"] | (STATUS["flight_phase_transition"] if name != self.last else 0)
        within = lambda start, length: start <= self.index < start + length
        alt, ias, vs, temp, rpm = self.values
        if within(self.spike, SPIKE[2]):
            temp += SPIKE_RISE - abs(SPIKE_PEAK - (self.index - self.spike)) * SPIKE_SLOPE
            status |= STATUS["engine_warning"]
        if within(self.drop, DROP[2]):
            alt, vs = max(0.0, alt - DROP_ALTITUDE), vs - DROP_VERTICAL
            status |= STATUS["altitude_deviation"]
        if within(self.glitch, GLITCH[2]):
            ias += GLITCH_EVEN if self.index % 2 == 0 else GLITCH_ODD
            self.heading = (self.heading + GLITCH_HEADING) % 360
            status |= STATUS["sensor_glitch"] | STATUS["pitot_disagree"]
        if temp > HOT_ENGINE:
            status |= STATUS["engine_warning"]
        if name == "Startup" and rpm > OIL_RPM and temp < OIL_TEMPERATURE:
            status |= STATUS["low_oil_pressure"]
        if overrun:
            status |= STATUS["recorder_buffer_overrun"]
        self.values = [alt, ias, vs, temp, rpm]
        self.last, self.index = name, self.index + 1
        if self.index >= TOTAL:
            self.index = WRAP
        return timestamp_us, alt, ias, self.heading, vs, temp, rpm, status


SAMPLES = "session bigint, sample bigint, timestamp_us bigint, altitude_m double, airspeed_kts double, heading_deg double, vertical_speed_fpm double, engine_temperature_c double, engine_rpm double, system_status bigint"


def sessions(spark: SparkSession, seeds: list[int] | DataFrame, samples: int, hertz: float = 20.0, start_us: int = 0) -> DataFrame:
    """Samples of a session for each seed (a list, or a column session), folded side by side."""
    period = max(1, int(1_000_000 / hertz))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["session"].iloc[0])
        sim = Simulator(seed)
        return pd.DataFrame([(seed, i, *sim.next_sample(start_us + i * period)) for i in range(samples)], columns=[c.split()[0] for c in SAMPLES.split(", ")])

    seeds = seeds if isinstance(seeds, DataFrame) else spark.createDataFrame([(s,) for s in seeds], "session bigint")
    return seeds.groupBy("session").applyInPandas(fold, SAMPLES)
