"""Text encoders: a factory makes one per Python worker, batches of text go through it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
DIMS = 64
# texts that go through an encoder at a time
BATCH = 500


def hashing_encoder(dims: int = DIMS) -> Encoder:
    """Signed word counts hashed into ``dims`` cells, scaled to unit length.

    Lexical, not semantic: texts are near when they share words. It needs no model file
    and gives the same vector on every machine. A text without words is the zero vector.
    """

    @lru_cache(maxsize=1 << 16)
    def cell(word: str) -> int:
        """Twice the word's cell, and one more where its sign is negative."""
        digest = hashlib.md5(word.encode("utf-8")).hexdigest()
        return int(digest[:8], 16) % dims * 2 + (digest[8] >= "8")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            cells = list(map(cell, filter(None, re.split(r"\s+", text.lower()))))
            counts = np.bincount(np.array(cells, np.int64), minlength=2 * dims)
            row[:] = counts[0::2] - counts[1::2]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype("float32")

    return encode


def sentence_encoder(model: str = "all-MiniLM-L6-v2") -> Encoder:
    """The sentence-transformers model of that name, where the package is installed."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as missing:
        raise ImportError("sentence_encoder needs the sentence-transformers package") from missing
    return SentenceTransformer(model).encode


def encode(text: Column | str, make: Callable[[], Encoder] = hashing_encoder) -> Column:
    """Vector column of a text column.

    ``make`` runs once per task, not per batch; the encoder sees ``BATCH`` texts at a time, whatever
    the size of Arrow's batches.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for batch in batches:
            texts = batch.fillna("").astype(str).tolist()
            found = [np.asarray(encoder(texts[at:at + BATCH]), dtype="float32") for at in range(0, len(texts), BATCH)]
            yield pd.Series([vector for part in found for vector in part], dtype=object)

    return vectors(text)
