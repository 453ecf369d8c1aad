"""Quality by compression: which of two zstandard dictionaries, built from good and from bad
labelled text, makes a text smaller.

The whole text is compressed in pieces of PIECE bytes (in one run the text's own past would soon
outweigh the dictionary). The score is a logistic function, calibrated on labelled rows that the
dictionaries haven't seen, of the normalised difference (bad - good) / max(bad, good) of the
summed sizes and of the compression ratio. Learned from at most SAMPLE labelled texts of each
class (by hash of their ids), from all pieces of each.

Defined results: null and empty texts count as one empty piece, difference 0. With no rows of a
class the score is constant: the other class.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .labelled import Constant, Logistic, class_weights, held_out, training_rows

SAMPLE, PIECE, DICTIONARY, LEVEL = 3000, 1024, 64 << 10, 3
LEAST = 8  # bytes of a sample for a dictionary
THRESHOLD = 0.3


def _parts(texts: list[str]) -> list[bytes]:
    """All bytes of the texts in pieces as they are compressed; a short one goes on in the next."""
    out, held = [], b""
    for text in texts:
        data = text.encode()
        for at in range(0, len(data), PIECE):
            held += data[at : at + PIECE]
            if len(held) >= LEAST:
                out.append(held)
                held = b""
    return [*out[:-1], out[-1] + held] if out else [held]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where there are too few samples to train one, the end of the text, as much
    as a dictionary holds."""
    parts = _parts(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


@lru_cache(maxsize=16)
def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(data) if data else None
    if made:
        made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)


def features(texts, good: bytes, bad: bytes) -> np.ndarray:
    """(normalised difference, log ratio) of each text."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        g = b = 0
        for at in range(0, max(1, len(data)), PIECE):
            piece = data[at : at + PIECE]
            g += len(by_good(piece))
            b += len(by_bad(piece))
        out[i] = (b - g) / max(b, g), np.log((len(data) + 16) / (g + 16))
    return out


class Model:
    def __init__(self, texts: list[list[str]], totals: list[int]):
        self.good = self.bad = b""
        if not texts[0] or not texts[1]:
            self.calibrated = Constant(1.0 if texts[1] or not texts[0] else 0.0)
            return
        built, rest = zip(*(([t for i, t in enumerate(c) if i % 3 or len(c) < 3], [t for i, t in enumerate(c) if i % 3 == 0]) for c in texts))
        self.bad, self.good = dictionary(built[0]), dictionary(built[1])
        x = features([*rest[0], *rest[1]], self.good, self.bad)
        y = np.array([0] * len(rest[0]) + [1] * len(rest[1]))
        self.calibrated = Logistic(self._terms(x), y, class_weights(y, totals))

    @staticmethod
    def _terms(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, x[:, 0] * x[:, 1], x[:, 1] ** 2])

    def score(self, texts) -> np.ndarray:
        return self.calibrated(self._terms(features(texts, self.good, self.bad)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    return Model(*training_rows(docs, labels, "quality", sample))


def score_udf(model):
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.tolist()))

    return score


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    score = score_udf(train(docs, labels, sample))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score(F.col(f"`{text_col}`")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
