"""Fill-in-middle: texts cut into prefix, middle and suffix at seeded unit boundaries, moved, and put together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pick, prepare, released

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: A byte that no UTF-8 text holds; it marks where one unit ends and the next begins.
CUT = b"\xff"
#: The end of a word followed by white space: units begin there, and nowhere else but at the text's start.
BOUNDARY = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])"
BYTES = pa.large_binary()
NOTHING = pa.scalar(b"", BYTES)


def modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units_of(text: pa.Array) -> pa.Array:
    """The units of each text as a list: white space and the word after it, or white space at the end.

    An empty text gives one empty unit. Joined again they are the text.
    """
    marked = pc.replace_substring_regex(text, pattern=BOUNDARY, replacement=rb"\1" + CUT + rb"\2")
    return pc.split_pattern(marked, pattern=CUT)


def rejoined(units: pa.Array, counts: pa.Array) -> pa.Array:
    """Flat ``units`` as lists of ``counts`` units, each list joined."""
    ends = pc.cumulative_sum(counts.cast(pa.int64()))
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, units), NOTHING)


def pieces_of(units: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each list of units, cut before its units ``first`` and ``second``."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    lengths = pc.list_value_length(units).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    ordinal = pc.subtract(pa.array(range(len(flat)), pa.int64()), starts.take(parent))
    after = [pc.greater_equal(ordinal, at.take(parent)).cast(pa.int8()) for at in (first, second)]
    role = pc.add(*after)
    counts = (first, pc.subtract(second, first), pc.subtract(lengths, second))
    return [rejoined(flat.filter(pc.equal(role, r)), n) for r, n in enumerate(counts)]


def either(conditions: list[pa.Array], *values: pa.Array) -> pa.Array:
    return pc.case_when(pa.StructArray.from_arrays(conditions, [f"w{i}" for i in range(len(conditions))]), *values)


def moved(batch: pa.RecordBatch, markers: tuple[str, str, str], percent: int, spm_percent: int) -> pa.RecordBatch:
    text = pc.fill_null(batch["text"], "").cast(BYTES)
    empty = pc.equal(pc.binary_length(text), 0)
    units = units_of(text)
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), empty.cast(pa.int64()))
    places = [modulo(batch[h], pc.add(n, 1)) for h in ("h1", "h2")]
    prefix, middle, suffix = pieces_of(units, pc.min_element_wise(*places), pc.max_element_wise(*places))
    plain = pc.greater_equal(modulo(batch["h3"], 100), percent)
    for held in (empty, *[pc.match_substring(text, m.encode()) for m in markers]):
        plain = pc.or_(plain, held)
    spm = pc.less(modulo(batch["h4"], 100), spm_percent)
    p, s, m = (pa.scalar(x.encode(), BYTES) for x in markers)
    output = either(
        [plain, spm],
        text,
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, NOTHING),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, NOTHING),
    )
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    form = either([plain, spm], *(pa.scalar(x) for x in ("plain", "spm", "psm")))
    columns = {"doc_id": batch["doc_id"], "n": n, "form": form, "prefix_chars": chars[0], "middle_chars": chars[1], "output": output.cast(pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def transform(docs: DataFrame, markers: tuple[str, str, str] = MARKERS, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: its text with prefix, middle and suffix moved.

    Units are white space with the word after it; both cuts, whether a text is moved at all (``percent`` of them) and
    which part comes first (suffix in ``spm_percent``) follow from the SHA-256 of seed and doc_id, so reruns agree. A
    text that is null (as empty), empty or holds a marker stays plain, with null lengths. Rows are independent of each
    other: nothing is shuffled, a batch of texts is held at most, repeated rows give repeated rows, rows with the same
    doc_id the same draws, a null doc_id draws from the seed alone. Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    flat = pick(docs, "doc_id", "text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    drawn = flat.select("doc_id", "text", digest.alias("digest")).select("doc_id", "text", *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield moved(b, markers, percent, spm_percent)

    kind = flat.schema["doc_id"].dataType.simpleString()
    return drawn.mapInArrow(released(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def put_back(output: pa.Array, form: pa.Array, markers: tuple[str, str, str]) -> pa.Array:
    """The texts that ``moved`` turned into ``output``."""
    whole = pc.equal(form, "plain")
    split = pc.split_pattern_regex(output.filter(pc.invert(whole)).cast(BYTES), pattern="|".join(map(re.escape, markers)).encode())
    if not pc.all(pc.equal(pc.list_value_length(split), 4), min_count=0).as_py():
        raise ValueError("an output without three markers that isn't plain")
    flat = pc.list_flatten(split)
    first, second, middle = (flat.take(pa.array(range(i, len(flat), 4), pa.int64())) for i in (1, 2, 3))
    psm = pc.equal(form.filter(pc.invert(whole)), "psm")
    text = pc.binary_join_element_wise(pc.if_else(psm, first, second), middle, pc.if_else(psm, second, first), NOTHING)
    return pc.replace_with_mask(output.cast(BYTES), pc.invert(whole), text).cast(pa.string())


def restore(moved_rows: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``moved_rows`` and a column ``restored``: the original text, rebuilt from the columns output and form alone.

    All columns stay, also those whose names repeat. An output that isn't of its form is an error.
    """
    prepare(moved_rows.sparkSession)
    flat, names = numbered(moved_rows)
    output, form = f"c{names.index('output')}", f"c{names.index('form')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("restored", put_back(b[output], b[form], markers))

    return flat.mapInArrow(released(run), T.StructType([*flat.schema, T.StructField("restored", T.StringType())])).toDF(*names, "restored")
