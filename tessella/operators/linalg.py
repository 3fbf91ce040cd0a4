"""Sparse matrices as (row_id, id, val) tables: Gram products, whitening, SVD, CCA, ridge regression, projection.

Products over the corpus are joins and sums. What is small in both dimensions is factorised on the driver; beyond ``DENSE``
columns a side a randomised range finder or conjugate gradients take over, whose passes are joins and whose driver state
is as wide as the rank. Fitted projections are tables (id, v) either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors, zeros
from ..session import durable

#: Columns a side that a dense factorisation on the driver takes (128 MB a matrix).
DENSE = 4096


def cross_covariance(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, val) of X'Y, not normalised. Rows meet by row_id; context rows hold a few entries each."""
    left = x.select("row_id", F.col("id").alias("i"), F.col("val").alias("a"))
    right = y.select("row_id", F.col("id").alias("j"), F.col("val").alias("b"))
    return left.join(right, "row_id").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("val"))


def centre_correction(product: DataFrame, x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """X'Y of mean-centred columns: each entry less n times the product of the two means. Dense by nature."""
    mx = x.groupBy(F.col("id").alias("i")).agg((F.sum("val") / n).alias("mx"))
    my = y.groupBy(F.col("id").alias("j")).agg((F.sum("val") / n).alias("my"))
    grid = mx.join(F.broadcast(my))
    return grid.join(product, ["i", "j"], "left").select("i", "j", (F.coalesce("val", F.lit(0.0)) - n * F.col("mx") * F.col("my")).alias("val"))


def diagonal_weights(x: DataFrame, gamma: float) -> DataFrame:
    """(id, w): 1 / sqrt(sum of squares + gamma) of each column."""
    return x.groupBy("id").agg((1 / F.sqrt(F.sum(F.col("val") * F.col("val")) + gamma)).alias("w"))


def whitened(product: DataFrame, x: DataFrame, y: DataFrame, gamma_x: float, gamma_y: float) -> DataFrame:
    """Both sides of a product scaled by their diagonal weights; the inputs stay as they are."""
    wx = diagonal_weights(x, gamma_x).select(F.col("id").alias("i"), F.col("w").alias("wx"))
    wy = diagonal_weights(y, gamma_y).select(F.col("id").alias("j"), F.col("w").alias("wy"))
    return product.join(wx, "i").join(wy, "j").select("i", "j", (F.col("val") * F.col("wx") * F.col("wy")).alias("val"))


def shifted_ppmi(product: DataFrame, x: DataFrame, y: DataFrame, n: int, shift: float) -> DataFrame:
    """Positive pointwise mutual information less log ``shift``, with one added to the column counts; zeros are left out."""
    cx = x.groupBy(F.col("id").alias("i")).agg((F.sum("val") + 1).alias("cx"))
    cy = y.groupBy(F.col("id").alias("j")).agg((F.sum("val") + 1).alias("cy"))
    value = F.log(n * F.col("val") / (F.col("cx") * F.col("cy"))) - float(np.log(shift))
    return product.where("val > 0").join(cx, "i").join(cy, "j").select("i", "j", value.alias("val")).where("val > 0")


def dense(product: DataFrame, p: int, q: int) -> np.ndarray:
    """A product with at most ``DENSE`` rows and columns as an array on the driver."""
    if max(p, q) > DENSE:
        raise ValueError(f"{p} x {q} is over {DENSE} a side")
    out = np.zeros((p, q))
    rows = product.select("i", "j", "val").toPandas()
    out[rows["i"].to_numpy(np.int64), rows["j"].to_numpy(np.int64)] = rows["val"].to_numpy()
    return out


def truncated_svd(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest singular triplets; each left vector's largest entry is positive, which settles the signs."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    u, s, v = u[:, :k], s[:k], vt[:k].T
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return u * sign, s, v * sign


def inverse_root(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    w = np.where(w > 1e-12 * max(w.max(initial=0.0), 1e-300), w, np.inf)
    return (v / np.sqrt(w)) @ v.T


def cca(cxx: np.ndarray, cyy: np.ndarray, cxy: np.ndarray, k: int, gamma_x: float, gamma_y: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections of both views and the ``k`` largest canonical correlations, ridge ``gamma`` on either side."""
    rx, ry = inverse_root(cxx + gamma_x * np.eye(len(cxx))), inverse_root(cyy + gamma_y * np.eye(len(cyy)))
    u, s, v = truncated_svd(rx @ cxy @ ry, k)
    return rx @ u, ry @ v, s


def fit_cca(x: DataFrame, y: DataFrame, p: int, q: int, k: int, gamma_x: float, gamma_y: float, whitening: str = "full", n: int | None = None, centre: bool = False, most: int = DENSE, alternations: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Projections (id, v) and singular values for whitening full (CCA), diag, ppmi (``gamma_x`` is the shift) or identity.

    Up to ``most`` columns a side (``DENSE`` at most) the result is exact, beyond it randomised. With ``full``, the range
    of the diagonally whitened product is refined by regressing each view on the other's projection ``alternations`` times,
    and CCA is solved within it: exact if its width, a little over ``k``, covers the product's rank, else from below.
    """
    if whitening not in ("full", "diag", "ppmi", "identity"):
        raise ValueError(f"no whitening {whitening!r}")
    xy = cross_covariance(x, y)
    if max(p, q) > min(most, DENSE):
        return _randomised_cca(x, y, xy, k, gamma_x, gamma_y, whitening, n, centre, alternations)
    if centre:
        xy = centre_correction(xy, x, y, n)
    if whitening == "full":
        xx, yy = cross_covariance(x, x), cross_covariance(y, y)
        if centre:
            xx, yy = centre_correction(xx, x, x, n), centre_correction(yy, y, y, n)
        u, v, s = cca(dense(xx, p, p), dense(yy, q, q), dense(xy, p, q), k, gamma_x, gamma_y)
    else:
        u, s, v = truncated_svd(dense(_scaled(xy, x, y, gamma_x, gamma_y, whitening, n), p, q), k)
    left, right = as_table(x.sparkSession, u), as_table(x.sparkSession, v)
    return (_rescaled(left, x, gamma_x), _rescaled(right, y, gamma_y), s) if whitening == "diag" else (left, right, s)


def cca_tables(x: DataFrame, y: DataFrame, k: int, gamma_x: float, gamma_y: float, **options) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """CCA of matrices whose columns are counted first."""
    p, q = (1 + (m.agg(F.max("id")).first()[0] or 0) for m in (x, y))
    return fit_cca(x, y, p, q, k, gamma_x, gamma_y, **options)


def _scaled(product: DataFrame, x: DataFrame, y: DataFrame, gamma_x: float, gamma_y: float, whitening: str, n: int | None) -> DataFrame:
    if whitening == "ppmi":
        return shifted_ppmi(product, x, y, n, gamma_x)
    return whitened(product, x, y, gamma_x, gamma_y) if whitening in ("diag", "full") else product


def _rescaled(vectors: DataFrame, x: DataFrame, gamma: float) -> DataFrame:
    """Rows of a projection times their columns' diagonal weights; columns without entries have the ridge's."""
    met = vectors.join(diagonal_weights(x, gamma), "id", "left")
    w = F.coalesce("w", F.lit(1 / float(np.sqrt(gamma)) if gamma > 0 else 0.0))
    return met.select("id", F.transform("v", lambda t: t * w).alias("v"))


def _randomised_cca(x: DataFrame, y: DataFrame, xy: DataFrame, k: int, gamma_x: float, gamma_y: float, whitening: str, n: int | None, centre: bool, alternations: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    product = durable(_scaled(xy, x, y, gamma_x, gamma_y, whitening, n))
    if whitening != "full":
        left, s, right = randomised_svd(product, k)
        return (_rescaled(left, x, gamma_x), _rescaled(right, y, gamma_y), s) if whitening == "diag" else (left, right, s)
    left, s, right = randomised_svd(product, k + 10)
    width = len(s)
    left, right = durable(_rescaled(left, x, gamma_x)), durable(_rescaled(right, y, gamma_y))
    for _ in range(alternations):
        right = durable(_gradients(y, _as_cells(projected(x, left, width)), width, gamma_y, 1e-6, 50))
        left = durable(_gradients(x, _as_cells(projected(y, right, width)), width, gamma_x, 1e-6, 50))
    a, b = durable(projected(x, left, width)), durable(projected(y, right, width))
    aa, bb = _gram(a, width), _gram(b, width)
    both = a.join(b.withColumnRenamed("v", "w"), "row_id")
    wide = both.select(F.concat("v", "w").alias("v"))
    ab = _gram(wide, 2 * width)[:width, width:]
    if centre:
        ma, mb = (_column_sums(m, width) for m in (a, b))
        aa, bb, ab = aa - np.outer(ma, ma) / n, bb - np.outer(mb, mb) / n, ab - np.outer(ma, mb) / n
    # the ridge is on the original columns: B'B of the bases takes the place of the unit matrix
    rx, ry = inverse_root(aa + gamma_x * _gram(left, width)), inverse_root(bb + gamma_y * _gram(right, width))
    u, s, v = truncated_svd(rx @ ab @ ry, min(k, width))
    return _turned(left, rx @ u), _turned(right, ry @ v), s


def _as_cells(vectors: DataFrame) -> DataFrame:
    """(row_id, id, val) of (row_id, v)."""
    return vectors.select("row_id", F.posexplode("v").alias("id", "val")).withColumn("id", F.col("id").cast("long"))


def _times(product: DataFrame, basis: DataFrame, width: int, transposed: bool = False) -> DataFrame:
    """C B or C' B for a basis (id, v) of ``width`` columns: one join and one sum per pass."""
    inner, outer = ("i", "j") if transposed else ("j", "i")
    met = product.join(basis.withColumnRenamed("id", inner), inner).select(F.col(outer).alias("id"), "val", "v")
    return _summed(met, "id", width)


def _summed(met: DataFrame, key: str, width: int) -> DataFrame:
    """(key, v): sums of ``val`` times ``v``, a column each, so that vectors are never taken apart into rows."""
    sums = met.groupBy(key).agg(*[F.sum(F.col("val") * F.col("v")[c]).alias(f"s{c}") for c in range(width)])
    return sums.select(key, F.array(*[F.col(f"s{c}") for c in range(width)]).alias("v"))


def _gram(tall: DataFrame, width: int) -> np.ndarray:
    """V'V of tall vectors: every partition adds up its share, the driver gets width x width sums."""

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            v = np.array(b["v"].tolist()).reshape(-1, width)
            total += v.T @ v
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    cells = tall.select("v").mapInPandas(shares, "g array<double>").select(F.posexplode("g").alias("i", "x"))
    return np.array([r.x for r in cells.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]).reshape(width, width)


def _column_sums(tall: DataFrame, width: int) -> np.ndarray:
    out = np.zeros(width)
    for i, x in tall.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def _turned(tall: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every row of (id, v) times a small matrix."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["v"].tolist()).reshape(-1, len(matrix))
            yield pd.DataFrame({"id": b["id"], "v": (v @ matrix).tolist()})

    return tall.select("id", "v").mapInPandas(turn, "id long, v array<double>")


def _orthonormal(tall: DataFrame, width: int) -> DataFrame:
    """Orthonormal columns by the inverse root of the Gram matrix; directions without length become zero. Written out, for the next pass reads it twice."""
    tall = durable(tall)
    w, vec = np.linalg.eigh(_gram(tall, width))
    keep = w > 1e-12 * w.max()
    return durable(_turned(tall, np.where(keep, 1 / np.sqrt(np.where(keep, w, 1.0)), 0.0) * vec))


def randomised_svd(product: DataFrame, k: int, extra: int = 10, passes: int = 2, seed: int = 1) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Left vectors (id, v), singular values and right vectors of a sparse product of any size.

    A hashed Gaussian basis is drawn per column, multiplied through ``passes`` times, and the small problem left in its
    range is solved on the driver.
    """
    width = k + extra
    noise = F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda c: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("j", c, F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1))) * F.cos(2 * np.pi * F.pmod(F.xxhash64("j", c, F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)),
    )
    basis = product.select("j").distinct().select(F.col("j").alias("id"), noise.alias("v"))
    left = _orthonormal(_times(product, basis, width), width)
    for _ in range(passes):
        left = _orthonormal(_times(product, _orthonormal(_times(product, left, width, True), width), width), width)
    right = durable(_times(product, left, width, True))
    w, vec = np.linalg.eigh(_gram(right, width))
    order = np.argsort(w)[::-1][:k]
    s, vec = np.sqrt(np.maximum(w[order], 0)), vec[:, order]
    return _turned(left, vec), s, _turned(right, vec / np.where(s > 0, s, 1.0))


def ridge(x: DataFrame, y: DataFrame, p: int, q: int, gamma: float) -> DataFrame:
    """(id, v): for each column of Y its row of ((X'X + gamma I)^-1 X'Y)'.

    Up to ``DENSE`` columns of X the inverse is taken on the driver and applied to Y's columns where they are, however
    many there are. Beyond it conjugate gradients solve for blocks of Y's columns.
    """
    if p > DENSE:
        return _conjugate_ridge(x, y, p, q, gamma)
    inverse = np.linalg.inv(dense(cross_covariance(x, x), p, p) + gamma * np.eye(p))
    columns = cross_covariance(x, y).groupBy(F.col("j").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("i", "val"))).alias("m"))
    whole = columns.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    return _turned(whole, inverse)


def _conjugate_ridge(x: DataFrame, y: DataFrame, p: int, q: int, gamma: float, block: int = 64) -> DataFrame:
    """The same by conjugate gradients."""
    found = None
    for lo in range(0, q, block):
        width = min(block, q - lo)
        solved = _gradients(x, y.where((F.col("id") >= lo) & (F.col("id") < lo + width)).withColumn("id", F.col("id") - lo), width, gamma)
        long = solved.select(F.col("id").alias("i"), F.posexplode("v").alias("j", "val")).groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("i", "val"))).alias("m"))
        v = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        solved = long.select((F.col("j") + lo).cast("long").alias("id"), v.alias("v"))
        found = solved if found is None else found.unionByName(solved)
    return found


def _gradients(x: DataFrame, y: DataFrame, width: int, gamma: float, least: float = 1e-9, most: int = 500) -> DataFrame:
    """(id, v): rows of (X'X + gamma I)^-1 X'Y for ``width`` columns of Y, by conjugate gradients.

    A pass is two joins and sums; the driver holds a few numbers per column. It stops once residuals are ``least`` of
    what they were, or after ``most`` passes with what has been reached.
    """
    back = x.select(F.col("id").alias("row_id"), F.col("row_id").alias("id"), "val")
    rows = cross_covariance(x, y).groupBy(F.col("i").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("j", "val"))).alias("m"))
    r = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    state = durable(rows.select("id", F.array_repeat(F.lit(0.0), width).alias("b"), r.alias("r"), r.alias("d")))
    norm = first = _products(state, "r", "r", width)
    for _ in range(most):
        if (norm <= least * least * np.maximum(first, 1e-300)).all():
            break
        ahead = projected(back, projected(x, state.select("id", F.col("d").alias("v")), width).withColumnRenamed("row_id", "id"), width).withColumnRenamed("row_id", "id").withColumnRenamed("v", "a")
        # columns of X that Y doesn't touch at first come in as zeros
        met = durable(ahead.join(state, "id", "full").select("id", *[_or_zero(c, width).alias(c) for c in "brd"], _plus("a", "d", np.full(width, gamma), width).alias("a")))
        bent = _products(met, "d", "a", width)
        step = norm / np.where(bent > 0, bent, 1.0)
        state = durable(met.select("id", _plus("b", "d", step, width).alias("b"), _plus("r", "a", -step, width).alias("r"), "d"))
        last, norm = norm, _products(state, "r", "r", width)
        state = state.select("id", "b", "r", _plus("r", "d", norm / np.where(last > 0, last, 1.0), width).alias("d"))
    return state.select("id", F.col("b").alias("v"))


def _or_zero(name: str, width: int):
    return F.coalesce(name, zeros(width))


def _plus(a: str, b: str, times: np.ndarray, width: int):
    """a + times * b, element by element; missing arrays are zero."""
    scaled = F.zip_with(_or_zero(b, width), F.array(*[F.lit(float(t)) for t in times]), lambda x, t: x * t)
    return F.zip_with(_or_zero(a, width), scaled, lambda x, y: x + y)


def _products(rows: DataFrame, a: str, b: str, width: int) -> np.ndarray:
    return _column_sums(rows.select(F.zip_with(a, b, lambda x, y: x * y).alias("v")), width)


def as_array(table: DataFrame, rows: int) -> np.ndarray:
    """(id, v) of at most ``DENSE`` rows as an array on the driver."""
    if rows > DENSE:
        raise ValueError(f"{rows} rows are over {DENSE}")
    found = table.collect()
    out = np.zeros((rows, len(found[0]["v"]) if found else 0))
    for r in found:
        out[r["id"]] = r["v"]
    return out


def as_table(spark, matrix: np.ndarray) -> DataFrame:
    """(id, v): the rows of an array."""
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(matrix)), "v": matrix.tolist()}), "id long, v array<double>")


def projected(cells: DataFrame, projection: DataFrame, width: int | None = None) -> DataFrame:
    """(row_id, v): the sum of the projection's rows, each as often as the cell says; cheaper if their ``width`` is known."""
    if width is not None:
        return _summed(cells.join(projection, "id").select("row_id", "val", "v"), "row_id", width)
    met = cells.join(projection, "id").select("row_id", F.transform("v", lambda t: t * F.col("val")).alias("v"))
    return sum_vectors(met, ["row_id"], "v", "v")


def concatenated_projection(features: DataFrame, projection: DataFrame, dim: int, length: int) -> DataFrame:
    """Projection rows of ``features(row_id, pos, id)`` in text order, repeated features once each time, zeros to ``length`` blocks."""
    met = features.join(projection, "id")
    joined = met.groupBy("row_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda t: t["v"])).alias("v"))
    return joined.select("row_id", F.slice(F.concat("v", zeros(dim * length)), 1, dim * length).alias("v"))


def backed_off(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """Column ids of features: their own, else that of ``<unk>``, else that of ``<unk>_dist{k}``; features with none are left out."""
    own = vocab.select(F.col("type").alias("feature"), F.col("id").alias("own"))
    spare = vocab.where(F.col("type").startswith("<unk>")).select(F.col("type").alias("spare"), F.col("id").alias("far"))
    plain = vocab.where("type = '<unk>'").select(F.col("id").alias("plain"))
    met = features.join(own, "feature", "left").withColumn("spare", F.concat(F.lit("<unk>"), F.regexp_extract("feature", r"(_dist\d+)$", 1)))
    met = met.join(F.broadcast(spare), "spare", "left").join(F.broadcast(plain), F.lit(True), "left")
    return met.withColumn("id", F.coalesce("own", "plain", "far")).where("id is not null").drop("own", "plain", "far", "spare")
