"""Dense-vector algebra on ``array<float|double>`` columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double"))


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def block_sums(vec, blocks: int) -> Column:
    """Project a vector onto ``blocks`` interleaved block sums:
    component ``k`` is the sum of elements whose 0-based index i has
    ``i % blocks == k``. Uses every element (no prefix)."""
    v = _col(vec)

    def pick(k):
        return lambda x, i: F.when(i % blocks == k, x.cast("double")).otherwise(F.lit(0.0))

    return F.array(*[F.aggregate(F.transform(v, pick(k)), F.lit(0.0), lambda acc, y: acc + y) for k in range(blocks)])


def poly_features(vec, degree: int) -> Column:
    """Element-wise polynomial feature map ``[x, x^2, ..., x^degree]``
    (doubles), e.g. to give a linear router curvature."""
    x = as_double_array(vec)

    def power(p):
        return lambda v: F.pow(v, F.lit(float(p)))

    return F.concat(x, *[F.transform(x, power(p)) for p in range(2, degree + 1)])


def context_rows(vectors, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A pandas or Arrow column of vectors as an (n, d) matrix and a mask of
    usable rows: a NULL vector or one with a NULL, NaN or infinite element is
    not usable (a row of zeros); another length fails."""
    values = vectors.to_numpy(zero_copy_only=False) if hasattr(vectors, "to_pylist") else vectors.to_numpy()
    x, ok = np.zeros((len(values), d)), np.zeros(len(values), bool)
    for i, v in enumerate(values):
        if v is None or (isinstance(v, float) and v != v):
            continue
        if len(v) != d:
            raise ValueError(f"a context has {len(v)} numbers instead of {d}")
        x[i] = np.asarray(v, dtype=np.float64)
        ok[i] = np.isfinite(x[i]).all()
    x[~ok] = 0.0
    return x, ok
