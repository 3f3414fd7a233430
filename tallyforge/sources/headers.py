"""Image facts read from the headers of embedded files, without decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of a file, as hex.
PNG_MAGIC = "89504E470D0A1A0A"
GIF_MAGIC = "47494638"
JPEG_MAGIC = "FFD8FF"

# PNG colour types.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}

# Modes by number of components of a JPEG frame.
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}

# Fixed values of JPEG markers (second byte): markers without a length, end of the header, frame
# starts, and the segment that may hold EXIF data, which begins with these six bytes.
BARE_MARKERS = [0x01, *range(0xD0, 0xD9)]
END_MARKERS = [0xD9, 0xDA]
FRAME_MARKERS = [*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)]
EXIF_MARKER = 0xE1
EXIF_HEAD = "457869660000"

# Byte order mark, tag and transposing values of the EXIF orientation.
LITTLE_ENDIAN = "4949"
ORIENTATION_TAG = 274
TRANSPOSED = [5, 6, 7, 8]

# A header of more segments than this tells no size here; ``measured`` can fill it in.
MAX_SEGMENTS = 512


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("int")


def _hex_at(data: Column, at: Column, n: int) -> Column:
    """``n`` bytes from position ``at`` (from 0) as hex, shorter at the end of the data."""
    return F.hex(F.substr(data, (at + 1).cast("int"), F.lit(n)))


def _whole(data: Column, at: Column, n: int) -> Column:
    return F.conv(_hex_at(data, at, n), 16, 10).cast("bigint")


def jpeg_segments(data: Column) -> Column:
    """(at, frame, exif): positions of the first frame header and of the first EXIF segment, or null.

    A fold over segments: each step reads the four bytes at its position and moves on by the length
    they state; compressed data is never reached. It ends at the frame, at the scan, or where no
    marker stands.
    """
    nothing = F.lit(None).cast("bigint")
    start = F.struct(F.lit(2).cast("bigint").alias("at"), nothing.alias("frame"), nothing.alias("exif"))

    def step(state: Column, _: Column) -> Column:
        at, frame, exif = state["at"], state["frame"], state["exif"]
        marker, after = _whole(data, at + 1, 1), _whole(data, at + 2, 2)
        halt = F.lit(-1).cast("bigint")
        follows = (
            F.when((_hex_at(data, at, 1) != "FF") | marker.isNull() | marker.isin(END_MARKERS), halt)
            .when(marker == 0xFF, at + 1)  # a fill byte
            .when(marker.isin(BARE_MARKERS), at + 2)
            .when((after < 2) | (at + 2 + after > F.octet_length(data)) | marker.isin(FRAME_MARKERS), halt)
            .otherwise(at + 2 + after)
        )
        is_frame = (_hex_at(data, at, 1) == "FF") & marker.isin(FRAME_MARKERS)
        is_exif = (_hex_at(data, at, 2) == f"FF{EXIF_MARKER:X}") & (_hex_at(data, at + 4, 6) == EXIF_HEAD)
        moved = F.struct(
            F.coalesce(follows, halt).alias("at"),
            F.when(is_frame, at).otherwise(frame).alias("frame"),
            F.when(exif.isNull() & is_exif, at).otherwise(exif).alias("exif"),
        )
        return F.when(at < 0, state).otherwise(moved)

    steps = F.sequence(F.lit(1), F.greatest(F.least(F.octet_length(data), F.lit(MAX_SEGMENTS)), F.lit(1)))
    return F.aggregate(steps, start, step)


def jpeg_transposed(data: Column, exif: Column) -> Column:
    """Whether the orientation in the EXIF segment at ``exif`` turns the picture by a quarter.

    The first directory alone counts; its entries are twelve bytes each, in the byte order that the
    segment states. A directory that runs out of the segment has no orientation.
    """
    base = exif + 10
    stop = exif + 2 + _whole(data, exif + 2, 2)
    little = _hex_at(data, base, 2) == LITTLE_ENDIAN

    def number(at: Column, n: int) -> Column:
        text = _hex_at(data, at, n)
        turned = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))])
        return F.conv(F.when(little, turned).otherwise(text), 16, 10).cast("bigint")

    directory = base + number(base + 4, 4)
    room = F.greatest(F.floor((stop - directory - 2) / 12), F.lit(0))
    entries = F.least(number(directory, 2), room).cast("int")
    places = F.when(entries > 0, F.sequence(F.lit(0), entries - 1))
    tagged = F.filter(places, lambda i: number(directory + 2 + i * 12, 2) == ORIENTATION_TAG)
    value = number(directory + 2 + F.get(tagged, F.lit(0)) * 12 + 8, 2)
    return F.coalesce(value.isin(TRANSPOSED), F.lit(False))


def image_header(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Add format, width, height and mode, as displayed: an EXIF orientation that turns a JPEG by a
    quarter swaps its sides. PNG and GIF tell them in their first bytes, JPEG in its frame header."""
    data = F.col(payload)
    head = F.hex(F.substring(data, 1, 32))
    png, gif = F.col("__h").startswith(PNG_MAGIC), F.col("__h").startswith(GIF_MAGIC)
    jpeg = F.col("__h").startswith(JPEG_MAGIC)

    def byte(i: int, n: int = 1) -> Column:
        return F.substring("__h", 2 * i + 1, 2 * n)

    frame = F.col("__j.frame")
    parts = _whole(data, frame + 9, 1)
    mode = F.coalesce(
        *[F.when(png & (_number(byte(25)) == code), F.lit(m)) for code, m in PNG_MODES.items()],
        F.when(gif, F.lit("P")),
        *[F.when(jpeg & (parts == n), F.lit(m)) for n, m in JPEG_MODES.items()],
    )
    # A height of zero is stated later in the file, by a marker after the first scan.
    tall, wide = (F.nullif(_whole(data, frame + at, 2), F.lit(0)).cast("int") for at in (5, 7))
    width = F.when(png, _number(byte(16, 4))).when(gif, _number(F.concat(byte(7), byte(6))))
    height = F.when(png, _number(byte(20, 4))).when(gif, _number(F.concat(byte(9), byte(8))))
    width = width.when(jpeg, F.when(F.col("__t"), tall).otherwise(wide))
    height = height.when(jpeg, F.when(F.col("__t"), wide).otherwise(tall))
    kind = F.when(png, "PNG").when(gif, "GIF").when(jpeg, "JPEG").otherwise("unknown")
    return (
        rows.withColumn("__h", head)
        .withColumn("__j", F.when(jpeg, jpeg_segments(data)))
        .withColumn("__t", F.when(F.col("__j.exif").isNotNull(), jpeg_transposed(data, F.col("__j.exif"))))
        .withColumns({"format": kind, "width": width, "height": height, "mode": mode})
        .drop("__h", "__j", "__t")
    )


def measured(
    headers: DataFrame, measure: Callable[[bytes], tuple[int, int, str] | None], payload: str = "payload"
) -> DataFrame:
    """Fill width, height and mode of rows whose first bytes do not tell them.

    ``measure`` is the caller's decoder: bytes to (width, height, mode) as displayed, or None.
    Only the rows that need it, their payload and row key ``idx`` reach Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [measure(bytes(v)) if v is not None else None for v in batch[payload]]
            columns = list(zip(*[f or (None, None, None) for f in found])) or [(), (), ()]
            yield pd.DataFrame(dict(zip(("idx", "width", "height", "mode"), (batch["idx"], *columns))))

    open_rows = headers.filter("width is null").select("idx", payload)
    facts = open_rows.mapInPandas(run, "idx bigint, width int, height int, mode string")
    known = headers.filter("width is not null").drop(payload)
    rest = headers.filter("width is null").drop(payload, "width", "height", "mode").join(facts, "idx")
    return known.unionByName(rest)


def image_profile(headers: DataFrame) -> DataFrame:
    """(kind, value, n): how many rows have each size, mode and format; facts that a header
    does not tell count as ``unknown``."""
    size = F.format_string("%dx%d", F.col("width"), F.col("height"))
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    facts = F.array(
        F.struct(F.lit("dimensions").alias("kind"), F.when(known, size).otherwise("unknown").alias("value")),
        F.struct(F.lit("mode").alias("kind"), F.coalesce("mode", F.lit("unknown")).alias("value")),
        F.struct(F.lit("format").alias("kind"), F.col("format").alias("value")),
    )
    return (
        headers.select(F.explode(facts).alias("f"))
        .groupBy("f.kind", "f.value")
        .agg(F.count("*").alias("n"))
    )
