"""Vector expressions over arrays of numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.batches import TOKEN, slices


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector, an error if the lengths differ."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def maxsim(query: Column, document: Column) -> Column:
    """Late interaction: for each vector of query its best dot product in document, summed."""
    return F.aggregate(F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(document, lambda d: dot(q, d))), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of weights; 0 with an empty one."""
    square = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    shared = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(a[k] * F.try_element_at(b, k), F.lit(0.0)))
    return F.coalesce(F.try_divide(shared, square(a) * square(b)), F.lit(0.0))


#: Features whose hashes a worker remembers.
HELD_HASHES = 1 << 18


class Hashes(dict):
    """Twice the bucket of a feature's BLAKE2b, one more if its sign is negative; looked up if known."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, feature: str) -> int:
        n = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        out = self[feature] = n % self.dimensions * 2 + (n >> 8 & 1)
        return out

    def vectors(self, texts: list[str]) -> np.ndarray:
        """A unit vector of the tokens and bigrams of each lower-cased text; zero for one without tokens."""
        if len(self) > HELD_HASHES:
            self.clear()
        found, sizes = [], []
        for text in texts:
            t = TOKEN.findall(text)
            found += map(self.__getitem__, t)
            found += map(self.__getitem__, map("_".join, zip(t, t[1:])))
            sizes.append(max(2 * len(t) - 1, 0))
        width = 2 * self.dimensions
        n = np.bincount(np.repeat(np.arange(len(texts)), sizes) * width + np.array(found, np.int64), minlength=len(texts) * width).reshape(len(texts), self.dimensions, 2)
        v = (n[:, :, 0] - n[:, :, 1]).astype(float)
        length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        return np.divide(v, length, out=v, where=length > 0)


def hashing_embed(c: Column | str, dimensions: int = 256) -> Column:
    """Signed feature hashing of tokens and bigrams (BLAKE2b, which the JVM lacks) to a unit vector; zero for a text without tokens."""
    if dimensions <= 0:
        raise ValueError("at least one dimension is needed")

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes(dimensions)
        for p in parts:
            v = [hashes.vectors(texts).ravel() for _, texts in slices(p)]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * dimensions), pa.array(np.concatenate(v) if v else np.zeros(0)))

    return run(F.lower(F.col(c) if isinstance(c, str) else c))
