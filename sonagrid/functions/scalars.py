"""Small column functions: names, boxes, margins, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let


def last_parts(path: Column, n: int) -> Column:
    """The last ``n`` components of a path, joined by slashes; all if there are fewer."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), F.lit(n)), "/")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def recording_of(segment: Column) -> Column:
    """What is left of rec_start_stop without its last two parts."""
    return F.regexp_extract(segment, "^(.*)_[^_]*_[^_]*$", 1)


def segment_id(rec: Column, st: Column, ed: Column, digits: int = 2) -> Column:
    return F.concat_ws("_", rec.cast("string"), F.format_string(f"%.{digits}f", st), F.format_string(f"%.{digits}f", ed))


def iou(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Shared area over joint area of boxes [x1, y1, x2, y2]."""
    get = F.get
    w = F.greatest(F.lit(0.0), F.least(get(a, F.lit(2)), get(b, F.lit(2))) - F.greatest(get(a, F.lit(0)), get(b, F.lit(0))))
    h = F.greatest(F.lit(0.0), F.least(get(a, F.lit(3)), get(b, F.lit(3))) - F.greatest(get(a, F.lit(1)), get(b, F.lit(1))))
    area = lambda x: (get(x, F.lit(2)) - get(x, F.lit(0))) * (get(x, F.lit(3)) - get(x, F.lit(1)))
    both = area(a) + area(b) - w * h + eps
    return F.when(both == 0, 0.0).otherwise(w * h / both)


def without_markers(text: Column, markers: list[str]) -> Column:
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(""))
    return text


def is_punctuation(char: Column, marks: str = "。，？！.,?![]") -> Column:
    return F.instr(F.lit(marks), char) > 0


def int_list(text: Column, n: Column | None = None) -> Column:
    """'[0, 1, 1]' as numbers, at most ``n``."""
    x = F.from_json(text, "array<int>")
    return F.slice(x, F.lit(1), n) if n is not None else x


def angular_margin(cosine: Column, margin: float) -> Column:
    """cos(angle + margin), and past the turning point a line that goes on falling."""
    sine = F.sqrt(F.greatest(F.lit(0.0), 1 - cosine * cosine))
    phi = cosine * math.cos(margin) - sine * math.sin(margin)
    return F.when(cosine > math.cos(math.pi - margin), phi).otherwise(cosine - (1 + math.cos(math.pi - margin)))


def additive_margin(cosine: Column, margin: float) -> Column:
    return cosine - margin


def warmup_cosine(step: Column, warmup: int, total: int, top: float, low: float) -> Column:
    """Rises in a line for ``warmup`` steps, then falls along half a cosine."""
    fall = low + 0.5 * (top - low) * (1 + F.cos(math.pi * (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, top * step / max(1, warmup)).otherwise(fall)


def step_rate(step: Column, size: int, start: float, factor: float) -> Column:
    return start * F.pow(F.lit(factor), F.floor(step / size))


def margin_schedule(step: Column, first: int, last: int, low: float, high: float) -> Column:
    """``low`` before ``first``, ``high`` from ``last``, an exponential rise between."""
    rise = high + (low - high) * F.exp(F.log(F.lit(1e-3)) * (step - first) / max(1, last - first))
    return F.when(step < first, low).when(step >= last, high).otherwise(rise)


def ema(values: Column, momentum: float) -> Column:
    """Exponential moving average after the last of ``values``, begun with the first."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.lit(0), F.size(values) - 1)), F.get(values, F.lit(0)).cast("double"), lambda s, v: s * momentum + v * (1 - momentum))


def python_round(x: Column, digits: int = 2) -> Column:
    """``x`` to ``digits`` places as Python does it: the binary value decides, exact halves go to the even neighbour.

    The product's own rounding error, from both factors' halves, says on which side of a half it lies.
    """
    return scaled_round(x, F.lit(float(10**digits))) / float(10**digits)


def sql_round(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places as databases in C++ do it: the product with 10^digits, as a double, goes to the nearest whole number.

    Spark's own round goes by the shortest decimals of ``x``, which are another value next to a half.
    """
    return F.round(x * float(10**digits)) / float(10**digits)


def scaled_round(x: Column, m: Column) -> Column:
    """``x`` times ``m``, a whole number below 2^53, rounded to a whole number: exact halves go to the even neighbour."""
    split = float(2**27 + 1)
    a = F.abs(x)
    p = a * m
    ah, mh = a * split - (a * split - a), m * split - (m * split - m)
    al, ml = a - ah, m - mh
    lost = ((ah * mh - p) + ah * ml + al * mh) + al * ml
    k = F.floor(p).cast("double")
    past = p - k - 0.5
    up = (past > 0) | ((past == 0) & ((lost > 0) | ((lost == 0) & (k % 2 == 1))))
    size = k + F.when(up, 1.0).otherwise(0.0)
    return F.when(p >= float(2**52), x * m).when(x < 0, -size).otherwise(size)


def python_text(x: Column, digits: int = 2) -> Column:
    """A number rounded to ``digits`` places, of less than 1e13, as Python writes it: without zeros at the end, but one."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d+?)0+$", "$1")


def python_segment_id(rec: Column, st: Column, ed: Column, digits: int = 2) -> Column:
    """rec_start_stop with times as Python rounds and writes them."""
    return F.concat_ws("_", rec.cast("string"), *[python_text(python_round(t, digits), digits) for t in (st, ed)])


def nth_field(line: Column, n: int) -> Column:
    """The ``n``-th field between blanks, from 1; null if there are fewer."""
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(n - 1))


def crop_box(box: Column, scale: float = 0.4) -> Column:
    """What is cut for a face in box [x1, y1, x2, y2]: pad, then top, bottom, left, right in the padded frame.

    Half the longer side, s, reaches up once, down 1 + 2 * scale times, and 1 + scale times to either side.
    """
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    s = F.greatest(y2 - y1, x2 - x1) / 2
    pad = (s * (1 + 2 * scale)).cast("int")
    y, x = (y1 + y2) / 2 + pad, (x1 + x2) / 2 + pad
    edges = {"top": y - s, "bottom": y + s * (1 + 2 * scale), "left": x - s * (1 + scale), "right": x + s * (1 + scale)}
    return F.struct(pad.alias("pad"), *[e.cast("int").alias(name) for name, e in edges.items()])


def log_number(value: Column, digits: int = 2) -> Column:
    """A number as Python's logs show it: with ``digits`` places between 1 and 100, else with an exponent.

    Exponents are those of numbers from 1e-12 to 1e15, and of 0.
    """
    ten = lambda n: F.pow(F.lit(10.0), n)
    size = F.abs(value)

    def written(power: Column) -> Column:
        n = F.when(power <= digits, scaled_round(size, F.rint(ten(digits - power)))).otherwise(F.rint(size / ten(power - digits)))
        return let(n, lambda n: spelled(n, power))

    def spelled(n: Column, power: Column) -> Column:
        over = n >= float(10 ** (digits + 1))
        mantissa = F.when(over, n / 10).otherwise(n) / float(10**digits)
        exponent = F.when(size == 0, 0).otherwise(power + over.cast("int")).cast("int")
        signs = F.when(value < 0, "-").otherwise(""), F.when(exponent < 0, "-").otherwise("+")
        return F.concat(signs[0], F.format_string(f"%.{digits}f", F.coalesce(mantissa, F.lit(0.0))), F.format_string("e%s%02d", signs[1], F.abs(exponent)))

    exact = lambda near: near + F.when(size >= ten(near + 1), 1).when(size < ten(near), -1).otherwise(0)
    far = let(F.floor(F.log10(size)), lambda near: let(exact(near), written))
    return F.when((value > 1) & (value < 100), F.format_string(f"%.{digits}f", python_round(value, digits))).otherwise(far)


def seconds(ms: Column) -> Column:
    return ms / 1000.0


def gap_overlap(ref_st: Column, ref_ed: Column, sys_st: Column, sys_ed: Column, gap: float = 0.0) -> Column:
    """The time that two intervals share if ``gap`` more is granted, in proportion to the reference's time; 0 if none."""
    shared = F.least(ref_ed, sys_ed) - F.greatest(ref_st, sys_st) + gap
    return F.when(shared > 0, shared / (1 + gap / F.greatest(ref_ed - ref_st, F.lit(1e-8)))).otherwise(0.0)


def frame_box(box: Column, width: Column, height: Column) -> Column:
    """A box in parts of the frame as whole pixels, held within the frame."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    at = lambda part, size: F.greatest(F.lit(0), F.least(size, F.floor(part * size))).cast("int")
    return F.array(at(x1, width), at(y1, height), at(x2, width), at(y2, height))


def paired_lengths(audio: Column, video: Column) -> Column:
    """How many of so many audio frames (100 a second) and faces (25 a second) go into active-speaker detection.

    As many as the shorter of both lasts, whole faces' worth of audio at most; halves go to the even number.
    """
    length = F.least((audio - audio % 4) / 100.0, video / 25.0)
    return F.struct(F.rint(length * 100).cast("int").alias("audio"), F.rint(length * 25).cast("int").alias("video"))
