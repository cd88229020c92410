"""Fill-in-middle: texts are cut into prefix, middle and suffix at unit borders and the pieces rearranged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices

#: Marks before prefix, suffix and middle. No mark begins as another ends, so pieces without marks read back in one way.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """n unsigned 32-bit numbers of an id: the first 8-digit groups of sha256 of `seed:id`. A null id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def borders(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units end, as code point offsets, 0 and the length included; n units have n + 1 borders.

    A line ends after \\n. A word ends after the white space that follows it: neighbours of the
    classes space and other are borders. `char`: each code point is a unit.
    """
    if unit == "line":
        ends = points == 10
        change = ends[:-1]
    elif unit == "word":
        space = np.isin(points, _SPACE)
        change = space[:-1] & ~space[1:]
    elif unit == "char":
        change = np.ones(max(0, len(points) - 1), bool)
    else:
        raise ValueError(f"unknown unit {unit}")
    inner = np.flatnonzero(change) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def arrange(text: str, drawn: list[int], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = borders(points, unit)
    n = len(at) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or drawn[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = int(at[first]), int(at[second])
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le") for x, y in ((0, a), (a, b), (b, len(points))))
    if drawn[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", carry: list[str] | None = None) -> DataFrame:
    """Rearranged texts: id_col, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output and the columns in `carry`.

    `rate` of 100 texts are rearranged, `spm` of 100 of those with the suffix first; all choices follow
    from `seed` and the id alone, so a lost task gives the same rows again. Texts that hold a mark stay
    plain, as do empty ones; their two lengths are null.

    Null text: empty. Null id: drawn as the empty string. Repeated ids and rows: each row by itself. An
    empty table gives an empty one. Columns that are not carried are ignored, whatever their names. A
    text is held whole with 4 bytes for each code point; texts are taken in slices of some 4 MB.
    """
    carry = carry or []
    source = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.array(*draws(F.col(f"`{id_col}`"), seed)).alias("drawn"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    )
    carried = [f"c{i}" for i in range(len(carry))]
    schema = T.StructType([source.schema["id"], *[T.StructField(c, T.LongType() if c != "form" else T.StringType()) for c in ("n", "form", "prefix_chars", "middle_chars")], T.StructField("output", T.StringType()), *[source.schema[c] for c in carried]])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                made = [arrange(t, d, unit, rate, spm) for t, d in zip(batch.column("text").to_pylist(), batch.column("drawn").to_pylist())]
                n, form, prefix, middle, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string()), *[batch.column(c) for c in carried]],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged, from output and form alone."""
    part = lambda begin, end: F.substring(output, begin, end - begin)
    size, skip = F.length(output) + 1, F.lit(len(PREFIX))
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(part(skip + 1, s), part(m + skip, size), part(s + skip, m))
    spm = F.concat(part(p + skip, m), part(m + skip, size), part(skip + 1, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
