"""Small inputs for the tests."""

import struct
import zlib

CLASSES = ["high", "low", "moderate", "non-burnable", "very_high", "very_low", "water"]


def predictions(spark, labels, probs, split="test"):
    rows = [
        ("run", split, i, int(y), [float(v) for v in p]) for i, (y, p) in enumerate(zip(labels, probs))
    ]
    return spark.createDataFrame(
        rows, "run string, split string, idx bigint, label int, probs array<double>"
    )


def one_hot(classes, k):
    return [[1.0 if i == c else 0.0 for i in range(k)] for c in classes]


def cells_of(spark, labels, probs, k):
    from tallyforge.operators import metrics

    return metrics.cells(metrics.score_frame(predictions(spark, labels, probs), k))


def png(pixels, width, height, level):
    """An RGB picture whose rows are ``pixels`` (bytes), compressed at ``level``."""

    def chunk(kind, body):
        data = kind + body
        return struct.pack(">I", len(body)) + data + struct.pack(">I", zlib.crc32(data))

    raw = b"".join(b"\0" + pixels[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw, level))
        + chunk(b"IEND", b"")
    )
