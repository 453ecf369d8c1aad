"""Vectors: cosine, validation, and a deterministic embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest product of norms that counts as zero (the spacing of 32-bit floats at 1).
EPSILON = 1.1920928955078125e-07


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 where either is (nearly) zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size <= EPSILON, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cosine() of each row of a with each row of b."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        size = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
        found = np.clip(a @ b.T / size, -1.0, 1.0)
    found[np.isnan(found)] = 1.0  # as least() has it
    found[size <= EPSILON] = 0.0
    return found


def cosine_to(a: Column, query: list[float]) -> Column:
    """cosine() with a constant vector, whose norm is taken here."""
    norm = sum(x * x for x in query) ** 0.5
    q = F.array(*(F.lit(float(x)) for x in query))
    size = F.sqrt(dot(a, a)) * F.lit(norm)
    return F.when(size <= EPSILON, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, q) / size)))


def valid(c: Column, dims: int) -> Column:
    """Whether a vector has that many components, all finite."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == dims) & finite, F.lit(False))


def l2_to_cosine(d: Column) -> Column:
    """Of unit vectors at a distance."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d * d / 2))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: FNV-1a's 64-bit offset and prime, modulo 2^32.
OFFSET, PRIME, MOD = 0x84222325, 0x1B3, 1 << 32


def mock_embedding(text: Column, dims: int = 64) -> Column:
    """mock_expression() for whole batches at once, in Arrow: a step is done for all texts that have a
    byte there and for all dimensions together."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        data = [None if t is None else t.encode() for t in texts]
        out: list = [None] * len(data)
        order = sorted((i for i, t in enumerate(data) if t is not None), key=lambda i: -len(data[i]))
        for at in range(0, len(order), 1024):
            rows = order[at : at + 1024]
            h = np.tile((np.uint32(OFFSET) ^ np.arange(dims, dtype=np.uint32)) * np.uint32(PRIME), (len(rows), 1))
            sizes = np.array([len(data[i]) for i in rows])
            codes = np.zeros((len(rows), int(sizes.max())), dtype=np.uint8)
            for k, i in enumerate(rows):
                codes[k, : sizes[k]] = np.frombuffer(data[i], np.uint8)
            active = np.searchsorted(-sizes, -np.arange(codes.shape[1]), side="left")  # rows longer than j
            for j, n in enumerate(active.tolist()):
                part = h[:n]
                part ^= codes[:n, j, None]
                part *= np.uint32(PRIME)
            values = np.clip(h.astype(np.float64) / (1 << 31) - 1, -1.0, 1.0)
            for k, i in enumerate(rows):
                out[i] = values[k]
        return pd.Series(out)

    return embed(text)


def mock_expression(text: Column, dims: int = 64) -> Column:
    """For each dimension the low 32 bits of FNV-1a over the text's UTF-8 bytes, from an offset that
    differs by dimension, scaled to [-1, 1]. Exclusive or and product are closed modulo 2^32, so
    longs suffice."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(hexed, "(..)", "$1 "), " "), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        return (h.bitwiseXOR(b) * F.lit(PRIME)) % F.lit(MOD)

    def one(i: Column) -> Column:
        start = (F.lit(OFFSET).bitwiseXOR(i.cast("long")) * F.lit(PRIME)) % F.lit(MOD)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(codes, start, step) / F.lit(float(1 << 31)) - 1.0))

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), one)


def from_blob(blob: Column) -> Column:
    """Vectors from little-endian 32-bit floats, for importing them; other lengths than whole floats fail."""

    @F.pandas_udf("array<double>")
    def decode(blobs: pd.Series) -> pd.Series:
        def one(data: bytes | None):
            if data is None:
                return None
            if len(data) % 4:
                raise ValueError(f"a vector of {len(data)} bytes isn't whole floats")
            return np.frombuffer(data, "<f4").astype(np.float64)

        return blobs.map(one)

    return decode(blob)


def to_blob(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return encode(vector)


def uuid_rowid(uuid: Column) -> Column:
    """The first 8 bytes of a uuid (with or without dashes) as a little-endian signed long, by which
    imported vector tables name their rows; null for what is no uuid."""
    digits = F.lower(F.replace(uuid, F.lit("-"), F.lit("")))
    turned = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.conv(turned, 16, -10).cast("long"))
