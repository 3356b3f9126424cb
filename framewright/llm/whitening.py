"""Operator 13: whitened principal components of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers x = floor(64 c) + 1000000 and are written once, as blocks of rows, to the shared folder. The rows are centred
exactly before any product: n x - S is a whole number. A step of the bidiagonalisation makes two passes over the blocks:

1. X v: the product w = X v - beta u (of the step before), and its coefficients on all earlier u.
2. X'u: w less those coefficients, once more its coefficients (full reorthogonalisation, twice), its length alpha, and X'w.

A pass returns one small sum for each number asked for. Up to `FEW` blocks the driver adds the tasks' sums itself; beyond that a group-by does, so that the
driver always gets a bounded number of rows, as long as there are dimensions and steps. The long vectors u are never stored: each is X p for a short p, and a task rebuilds its part of all of them from the p. The short v
are kept orthogonal on the driver, where B (bidiagonal up to the rounding that reorthogonalisation mends) has its singular value decomposition. Steps end when the wanted
components have come to rest and `GUARD` steps from a fresh start, which would meet repeated eigenvalues, have not moved them, or when the v
fill all dimensions. Nothing but sums and the short vectors passes the driver; a lost executor costs the tasks of one pass.

Defined cases. Vectors that are null, or hold null or non-finite entries, are dropped. Shorter vectors count as filled up with zeros. Scaled entries
beyond 4e18 count as 4e18; a deviation beyond a long is null. Components without variance (a singular value below 1e-10 of the largest)
have no whitened value, as the division is undefined, and `identity_error` leaves them out. Repeated rows and ids, and null ids, are rows of their own. Without
rows, or without entries, there is no result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import materialise

SCALE, SHIFT, MOST = 64, 1_000_000, 4e18
#: Entries of a block of rows.
BLOCK = 1 << 18
#: A residual below this share of the largest singular value is at rest; a singular value below that share is none.
REST, NONE = 1e-13, 1e-10
GUARD = 8
#: Blocks up to which the sums of all tasks go to the driver.
FEW = 1000
BLOCKS = "ids array<long>, rows long, width int, most double, sums array<decimal(38,0)>, x binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are complete and finite, and those as rows of whole numbers, filled up with zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy())
    entries = column.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fit = ~column.is_null().to_numpy(zero_copy_only=False)
    fit[owner[~np.isfinite(entries)]] = False
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.zeros((len(sizes), int(sizes.max(initial=0))))
    rows[owner, place] = entries
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.clip(np.floor(SCALE * rows[fit]), -MOST, MOST)
    return fit, scaled.astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column(1).value_lengths().fill_null(0).to_numpy()
        step = max(1, BLOCK // max(1, int(lengths.max(initial=1))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            fit, x = _whole(part.column(1))
            if len(x):
                sums = [int(s) for s in (x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) * float(len(x)) > 4e18 else x.sum(axis=0))]
                ids = part.column(0).filter(pa.array(fit)).to_pylist()
                columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([len(x)], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([float(np.abs(x).max(initial=0))]), pa.array([sums], pa.list_(pa.decimal128(38, 0))), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "rows", "width", "most", "sums", "x"])


class Rows:
    """The rows as blocks, their number, width and sums."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str):
        found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        self.blocks = materialise(found.mapInArrow(_blocks, BLOCKS), "vectors")
        total = self.blocks.agg(F.sum("rows"), F.max("width"), F.max("most"), F.count(F.lit(1))).first()
        self.n, self.width, self.most, self.count = total[0] or 0, total[1] or 0, total[2] or 0.0, total[3]
        self.sums = [SHIFT * self.n] * self.width  # entries that a block lacks are zeros
        short = self.blocks.select("rows", F.posexplode("sums").alias("i", "sum")).groupBy("i").agg(F.sum("sum").alias("sum"), F.sum("rows").alias("rows"))
        for row in short.collect():
            self.sums[row["i"]] = int(row["sum"]) + SHIFT * (self.n - row["rows"])

    def spread(self) -> Callable[[bytes, int, int], np.ndarray]:
        """A function from a block to n x - S: whole numbers of 64 bits, or Python's where those are too short."""
        n, width, sums, small = self.n, self.width, self.sums, 2 * self.most * self.n < 4e18

        def run(x: bytes, rows: int, own: int) -> np.ndarray:
            full = np.full((rows, width), SHIFT, np.int64)
            full[:, :own] = np.frombuffer(x, np.int64).reshape(rows, own)
            return full * n - np.array(sums, np.int64) if small else full.astype(object) * n - np.array(sums, object)

        return run

    def total(self, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of `work` over all blocks of centred rows, by a pass."""
        spread, n = self.spread(), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            so_far = None
            for batch in batches:
                for rows, own, x in zip(*(batch.column(c).to_pylist() for c in ("rows", "width", "x")), strict=True):
                    found = work((spread(x, rows, own) / n).astype(np.float64))
                    so_far = found if so_far is None else so_far + found
            if so_far is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(so_far), dtype=np.int32)), pa.array(so_far)], ["i", "value"])

        sums = self.blocks.select("rows", "width", "x").mapInArrow(run, "i int, value double")
        if self.count > FEW:
            sums = sums.groupBy("i").agg(F.sum("value").alias("value"))
        found = sums.toArrow()
        return np.bincount(found.column("i").to_numpy(), found.column("value").to_numpy())


def bidiagonalise(rows: Rows, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows, and the components as columns."""
    width, rng = rows.width, np.random.default_rng(seed)
    v_all, p_all, back = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))  # v; p, with u = X p; X'u
    small = np.zeros((0, 0))

    def fresh() -> np.ndarray:
        v = rng.normal(size=width)
        for _ in range(3):
            v -= v_all @ (v_all.T @ v)
            v /= np.linalg.norm(v)
        return v

    v, beta, guard = fresh(), 0.0, 0
    while True:
        v_all = np.column_stack([v_all, v])
        q, column = v.copy(), np.zeros(p_all.shape[1])
        if beta:
            q, column[-1] = q - beta * p_all[:, -1], beta
        if p_all.shape[1]:
            c = rows.total(lambda x, q=q, p=p_all: (x @ p).T @ (x @ q))
            q, column = q - p_all @ c, column + c
        found = rows.total(lambda x, q=q, p=p_all: np.concatenate([(x @ p).T @ (w := x @ q), [w @ w], x.T @ w]))
        c, square, ahead = found[: p_all.shape[1]], found[p_all.shape[1]], found[p_all.shape[1] + 1 :]
        q, column, ahead = q - p_all @ c, column + c, ahead - back @ c
        alpha = float(np.sqrt(max(0.0, square - c @ c)))
        small = np.column_stack([small, column])
        scale = max(float(np.linalg.norm(small, 2)) if small.size else 0.0, alpha)
        residue = np.zeros(width)
        if alpha > NONE / 10 * scale:
            small = np.vstack([small, np.append(np.zeros(small.shape[1] - 1), alpha)])
            p_all, back = np.column_stack([p_all, q / alpha]), np.column_stack([back, ahead / alpha])
            residue = back[:, -1] - alpha * v
            for _ in range(2):
                residue -= v_all @ (v_all.T @ residue)
        beta = float(np.linalg.norm(residue))
        left, values, right = np.linalg.svd(small)
        values = np.append(values, np.zeros(small.shape[1] - len(values)))
        if v_all.shape[1] == width:
            break
        outside = back - v_all @ (v_all.T @ back)
        rest = np.linalg.norm(outside @ left[:, :wanted], axis=0)
        calm = len(values) >= wanted and (rest <= REST * scale).all()
        if calm and guard == GUARD:
            break
        guard = guard + 1 if calm else 0
        if guard == 1 or beta <= NONE / 10 * scale:
            v, beta = fresh(), 0.0
        else:
            v = residue / beta
    return values[:wanted], (v_all @ right.T)[:, :wanted]


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component, up to `most`."""
    rows = Rows(vectors, id_col, vector_col)
    if not rows.n or not rows.width:
        return vectors.sparkSession.createDataFrame([], OUT)
    wanted = min(most, rows.width)
    values, parts = bidiagonalise(rows, wanted)
    real = values > NONE * values.max(initial=0.0)
    by = parts / np.where(real, values / np.sqrt(rows.n), np.inf)

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ by
        return np.concatenate([[np.square(x).sum()], y.sum(axis=0), (y.T @ y).ravel()])

    found = rows.total(moments) / rows.n
    trace, mean, second = found[0], found[1 : wanted + 1], found[wanted + 1 :].reshape(wanted, wanted)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(wanted))[np.ix_(real, real)].max(initial=0.0))
    explained = np.square(values) / rows.n / trace if trace > 0 else np.zeros(wanted)
    spread, n, width = rows.spread(), rows.n, rows.width

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, count, own, x in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "width", "x")), strict=True):
                apart = spread(x, count, own)
                exact = apart if float(np.abs(apart).max()) ** 2 * width < 4e18 else apart.astype(object)
                away = [int(d) if d < 1 << 63 else None for d in (exact * exact).sum(axis=1).tolist()]
                white = np.where(real, (apart / n).astype(np.float64) @ by, np.nan).ravel()
                out = [np.repeat(np.arange(count), wanted), np.tile(np.arange(1, wanted + 1, dtype=np.int32), count)]
                columns = [pa.array(ids, pa.int64()).take(pa.array(out[0])), pa.array(out[1]), pa.array(np.full(len(white), n, np.int64)), pa.array(away, pa.int64()).take(pa.array(out[0])), pa.array(white, from_pandas=True), pa.array(np.tile(explained, count)), pa.array(np.full(len(white), error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.blocks.select("ids", "rows", "width", "x").mapInArrow(project, OUT)


def query(vectors: DataFrame) -> DataFrame:
    """The contract's digest."""
    return whiten(vectors)
