"""Vectors as array<double> columns, and embeddings of texts.

Products with a few centroids are one matrix product a batch (Arrow), all else built-in expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import EMBEDDING_DIM, EMBEDDING_MODEL

_WORD = re.compile(r"\w+")
#: Tokens whose hashes a worker keeps; when there are more, all are let go and gathered anew.
KEPT = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its norm; an error for a zero or undefined norm."""
    n = norm(v)
    ok = F.when((n > 0) & ~F.isnan(n), n).otherwise(F.raise_error(F.lit("zero-norm or NaN vector")).cast("double"))
    return F.transform(v, lambda x: x / ok)


def matrix(col: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays without nulls."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _product(v: Column, centroids: list[list[float]], kind: str, finish) -> Column:
    c = np.array(centroids, np.float64)

    @F.arrow_udf(kind)
    def product(col: pa.Array) -> pa.Array:
        known = col.is_valid()
        x = matrix(col.filter(known)) if len(col) else np.zeros((0, c.shape[1]))
        out = finish(x @ c.T if len(x) else np.zeros((0, len(c))))
        if len(out) == len(col):
            return out
        at = np.cumsum(known.to_numpy(zero_copy_only=False)) - 1
        return out.take(pa.array(at, mask=~known.to_numpy(zero_copy_only=False)))

    return product(v)


def similarities(v: Column, centroids: list[list[float]]) -> Column:
    """The products with all centroids, in their order."""

    def rows(s: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))

    return _product(v, centroids, "array<double>", rows)


def nearest(v: Column, centroids: list[list[float]]) -> Column:
    """The index of the most similar centroid; of equal ones the first."""
    return _product(v, centroids, "int", lambda s: pa.array(s.argmax(1).astype(np.int32)))


class _Hashes(dict):
    """Bucket and sign of tokens: the MD5's first eight bytes (little-endian) modulo dim, and the parity of its ninth."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= KEPT:
            self.clear()
        h = hashlib.md5(token.encode()).digest()
        self[token] = out = (int.from_bytes(h[:8], "little") % self.dim, -1 if h[8] % 2 else 1)
        return out


def _weights(text: str | None, hashes: _Hashes) -> dict[int, int]:
    out: dict[int, int] = {}
    for t in _WORD.findall((text or "").lower()) or ["<empty>"]:
        i, sign = hashes[t]
        out[i] = out.get(i, 0) + sign
    return out


def token_weights(df: DataFrame, key: str, text: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """(key, idx int, w long) of each row: signed token counts by hash bucket; a text without tokens has one `<empty>`.

    A worker hashes each distinct token once; no row leaves its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(dim)
        for b in batches:
            found = [_weights(t, hashes) for t in b.column(1).to_pylist()]
            row = np.repeat(np.arange(len(b)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([i for f in found for i in f], pa.int32()), pa.array([w for f in found for w in f.values()], pa.int64())], [key, "idx", "w"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, idx int, w long")


def hash_embed(df: DataFrame, key: str, text: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """(key, v array<double>): unit vectors of the token weights; where all of them cancel, the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(dim)
        for b in batches:
            x = np.zeros((len(b), dim))
            for i, t in enumerate(b.column(1).to_pylist()):
                w = _weights(t, hashes)
                x[i, list(w)] = list(w.values())
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x[size[:, 0] == 0, 0] = 1
            yield _vectors(b.column(0), x / np.where(size > 0, size, 1), key)

    return _embedded(df, key, text, run)


def sentence_embed(model_name: str = EMBEDDING_MODEL, batch: int = 32):
    """An embedder by a sentence-transformers model on the CPU, loaded when the first batch of a partition comes: unit vectors."""

    def embed(df: DataFrame, key: str, text: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for b in batches:
                if model is None:
                    from sentence_transformers import SentenceTransformer

                    model = SentenceTransformer(model_name, device="cpu")
                got = model.encode(b.column(1).fill_null("").to_pylist(), batch_size=batch, normalize_embeddings=True, convert_to_numpy=True, show_progress_bar=False)
                yield _vectors(b.column(0), np.asarray(got, np.float64), key)

        return _embedded(df, key, text, run)

    return embed


def _vectors(keys: pa.Array, x: np.ndarray, key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], [key, "v"])


def _embedded(df: DataFrame, key: str, text: str, run) -> DataFrame:
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, v array<double>")
