"""Preprocessing of training samples: stages with declared columns, composed into one Arrow pass."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import signal

#: Bytes of noises that tasks may hold; larger pools must be joined to the rows instead.
POOL_BYTES = 64 << 20


@dataclass(frozen=True)
class Stage:
    """``run`` takes the columns ``needs`` of a row (arrays as numpy arrays) and gives those of ``gives``, a DDL string.

    A stage may give columns that are there already; the next stages see the new ones. ``run`` must depend on its
    arguments alone: what looks random is drawn by ``draw`` from a seed and the row's key.
    """

    name: str
    needs: tuple[str, ...]
    gives: str
    run: Callable[..., tuple]


def draw(seed: str, *key: object) -> int:
    """The number that ``draws.draw`` gives for the same seed and key in the JVM."""
    return int(hashlib.md5("|".join([seed, *map(str, key)]).encode()).hexdigest()[:15], 16)


def chained(df: DataFrame, stages: Sequence[Stage], *keep: str) -> DataFrame:
    """The columns ``keep`` of ``df`` or of any stage after all ``stages``, which run on each row one after another.

    One Arrow pass, so that samples don't go back to the JVM between stages; a batch of rows is held at most. A stage
    that needs a column that neither ``df`` nor an earlier stage has is an error when the plan is built.
    """
    fields = {f.name: f for f in df.schema}
    used: list[str] = []
    made: set[str] = set()
    for s in stages:
        if missing := [n for n in s.needs if n not in fields]:
            raise ValueError(f"stage {s.name} needs {', '.join(missing)}")
        used += [n for n in s.needs if n not in made]
        own = T.StructType.fromDDL(s.gives)
        made |= set(own.names)
        fields |= {f.name: f for f in own}
    used = list(dict.fromkeys([*used, *[k for k in keep if k not in made]]))
    plan = [(s.run, s.needs, T.StructType.fromDDL(s.gives).names) for s in stages]
    schema = T.StructType([fields[k] for k in keep])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                row = {n: plain(b[n][i]) for n in used}
                for f, needs, gives in plan:
                    row.update(zip(gives, f(*[row[n] for n in needs]), strict=True))
                rows.append([row[k] for k in keep])
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in keep]
            yield pa.RecordBatch.from_arrays([pa.array([listed(v) for v in c], f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(*used).mapInArrow(run, schema)


def plain(value: pa.Scalar) -> object:
    if isinstance(value, pa.ListScalar) and value.is_valid and pa.types.is_floating(value.type.value_type):
        return value.values.to_numpy(zero_copy_only=False)
    return value.as_py()


def listed(value: object) -> object:
    return value.tolist() if isinstance(value, np.ndarray) else value


def reader(rate: int, content: str = "content", wave: str = "wave") -> Stage:
    """The first channel of WAV bytes, which must have ``rate``."""

    def run(data: bytes) -> tuple:
        own, _, x = signal.parse_wav(data)
        if own != rate:
            raise ValueError(f"the sample rate is {own}, not {rate}")
        return (x[0] / 32768.0,)

    return Stage("reader", (content,), f"`{wave}` array<double>", run)


def speed(seed: str, key: str, tenths: Sequence[int] = (10, 9, 11), wave: str = "wave") -> Stage:
    """Play at one of the speeds, drawn by key; ``speed_index`` says which."""

    def run(k: object, x: np.ndarray) -> tuple:
        i = draw(seed, k) % len(tenths)
        return i, signal.resample(x, tenths[i], 10)

    return Stage("speed", (key, wave), f"speed_index int, `{wave}` array<double>", run)


def speed_class(classes: int, label: str = "label") -> Stage:
    """Each speed of a speaker is a class of its own."""
    return Stage("speed_class", (label, "speed_index"), f"`{label}` int", lambda n, i: (n + classes * i,))


def crop(seed: str, key: str, length: int, wave: str = "wave") -> Stage:
    """``length`` samples from a place drawn by key; shorter waves get zeros at their end."""

    def run(k: object, x: np.ndarray) -> tuple:
        start = draw(seed, k) % (max(len(x) - length, 0) + 1)
        return (np.pad(x[start : start + length], (0, max(0, length - len(x)))),)

    return Stage("crop", (key, wave), f"`{wave}` array<double>", run)


def noise(seed: str, key: str, pool: Sequence[np.ndarray], snr: tuple[float, float], probability: float = 1.0, wave: str = "wave") -> Stage:
    """One noise of ``pool``, which every task holds, at a signal-to-noise ratio in dB from a range; both drawn by key."""
    top = 2**60
    if sum(8 * len(n) for n in pool) > POOL_BYTES:
        raise ValueError("the noises are too large for a stage: join each row's noise instead")

    def run(k: object, x: np.ndarray) -> tuple:
        if not len(x) or not pool or draw(f"{seed}-whether", k) >= int(probability * top):
            return (x,)
        n = np.asarray(pool[draw(f"{seed}-which", k) % len(pool)], float)
        start = draw(f"{seed}-start", k) % (max(len(n) - len(x), 0) + 1)
        n = np.resize(n[start : start + len(x)], len(x))
        db = snr[0] + (snr[1] - snr[0]) * draw(f"{seed}-snr", k) / top
        power = lambda v: float(np.mean(v * v)) + 1e-12
        return (x + n * np.sqrt(power(x) / (power(n) * 10 ** (db / 10))),)

    return Stage("noise", (key, wave), f"`{wave}` array<double>", run)


def features(mels: int, rate: int, mean_norm: bool = True, wave: str = "wave") -> Stage:
    return Stage("features", (wave,), "features array<array<double>>", lambda x: (signal.fbank_matrix(x, mels, rate, mean_norm).tolist(),))
