"""Vector codes of one byte a part, trained and assigned in whole numbers.

Components become integers and vectors are cut into ``PARTS`` equal parts, each with its own
codebook. The nearest entry of a part is found in the Walsh-Hadamard domain: parts and entries
are padded with zeros to a power of two and transformed by additions only. As the transform
keeps squared distances up to the factor of its length, the squared differences of the
coefficients are added in sequency order, from the slow patterns, which carry most of a
distance, to the fast ones. An entry whose sum so far is above the whole distance of a good
guess can't be nearest and is left out. All of it is integer arithmetic, so results are exact
and do not depend on the order of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repostrata.llm.common import settle
from repostrata.operators.skew import join_lookup
from repostrata.session import pinned

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CLIP = 1 << 40  # components are cut to this size, so every sum has a bound
_ROWS = 4096  # vectors worked on at a time
_LOW = 32


def sequency(size: int) -> np.ndarray:
    """Natural positions of the Walsh functions of a power of two, by number of sign changes."""
    signs = _butterflies(np.eye(size, dtype=np.int64))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def _butterflies(x: np.ndarray) -> np.ndarray:
    size, step = x.shape[-1], 1
    while step < size:
        pairs = x.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        x = np.stack((a + b, a - b), axis=-2).reshape(*x.shape[:-1], size)
        step *= 2
    return x


def transform(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients along the last axis, padded with zeros, in sequency order."""
    width = parts.shape[-1]
    size = 1 << max(width - 1, 0).bit_length()
    padded = np.zeros((*parts.shape[:-1], size), parts.dtype)
    padded[..., :width] = parts
    return _butterflies(padded)[..., sequency(size)]


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each row and its squared distance; ties to the lower number.

    Both are coefficients in sequency order; distances come without the transform's factor.
    """
    size = vectors.shape[1]
    first = (vectors[:, :1] - entries[None, :, 0]) ** 2
    guess = entries[first.argmin(axis=1)]
    limit = ((vectors - guess) ** 2).sum(axis=1)
    rows, which = np.nonzero(first <= limit[:, None])
    total = first[rows, which]
    for k in range(1, size):
        total = total + (vectors[rows, k] - entries[which, k]) ** 2
        stay = total <= limit[rows]
        rows, which, total = rows[stay], which[stay], total[stay]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    best = np.minimum.reduceat(total, starts)
    hits = np.flatnonzero(total == np.repeat(best, np.diff(np.r_[starts, len(rows)])))
    hits = hits[np.r_[True, rows[hits][1:] != rows[hits][:-1]]]
    return which[hits], total[hits] // size


def integers(column: pa.Array, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of a list column as a matrix; shorter vectors end in zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values * float(SCALE)), -CLIP, CLIP).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def _fitting(peak: int, width: int) -> type:
    """64-bit integers where no sum of squares can leave them, else Python's."""
    size = 1 << max(width - 1, 0).bit_length()
    return np.int64 if 4 * size**3 * (peak + 1) ** 2 < 1 << 62 else object


def _blocks(batches: Iterator[pa.RecordBatch], at: int, books: np.ndarray):
    """``(slice of a batch, parts, codes, errors)`` of at most ``_ROWS`` vectors each."""
    n_parts, _, width = books.shape
    top = int(np.abs(books).max(initial=0))
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(start, _ROWS)
            parts = integers(rows.column(at), n_parts * width).reshape(-1, n_parts, width)
            kind = _fitting(max(top, int(np.abs(parts).max(initial=0))), width)
            moved, entries = transform(parts.astype(kind)), transform(books.astype(kind))
            found = [nearest(moved[:, p], entries[p]) for p in range(n_parts)]
            codes, errors = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
            yield rows, parts, codes, errors


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """``(vec_id, vector[, label])`` of the rows whose vector is there and finite throughout."""
    columns = [F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")]
    columns += [F.col(label_col).alias("label")] if label_col else []
    value = lambda x: x.cast("double")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return vectors.select(*columns).where(F.col("vector").isNotNull()).where(F.coalesce(finite, F.lit(False)))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks ``[part, entry, position]`` of ``rows(vec_id, vector)``; None without rows.

    They start as the parts of the vectors with the smallest ids. A round brings one row of
    sums per part, entry and position to the driver, whatever the number of vectors.
    """
    width = rows.agg(F.max(F.size("vector")).alias("w")).head().w
    if width is None:
        return None
    width = max(-(-width // parts), 1)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    start = pa.array([r.vector for r in first], pa.list_(pa.float64()))
    books = integers(start, parts * width).reshape(-1, parts, width).swapaxes(0, 1)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the rounded down mean of the parts nearest to it."""
    n_parts, n_entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = (np.zeros((n_parts * n_entries, width), np.int64) for _ in range(2))
        count = np.zeros(n_parts * n_entries, np.int64)
        for _, parts, codes, _ in _blocks(batches, 0, books):
            cell = (codes + np.arange(n_parts) * n_entries).reshape(-1)
            order = np.argsort(cell, kind="stable")
            cells, values = cell[order], parts.reshape(-1, width)[order]
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            which = cells[starts]
            count[which] += np.diff(np.r_[starts, len(cells)])
            high[which] += np.add.reduceat(values >> _LOW, starts, axis=0)
            low[which] += np.add.reduceat(values & ((1 << _LOW) - 1), starts, axis=0)
        used = np.flatnonzero(count)
        at = (used[:, None] * width + np.arange(width)).reshape(-1)
        columns = [at, np.repeat(count[used], width), high[used].reshape(-1), low[used].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "n", "high", "low"])

    sums = rows.select("vector").mapInArrow(add, "at long, n long, high long, low long")
    found = sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    flat = books.reshape(-1).copy()
    for r in found:
        flat[r["at"]] = ((r.high << _LOW) + r.low) // r.n
    return flat.reshape(books.shape)


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` without the vector, with ``code`` (two hex digits a part) and ``error``.

    ``error`` is the sum of the squared distances; null where it is beyond 64 bits.
    """
    names = [c for c in rows.columns if c != "vector"]
    hexed = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, codes, errors in _blocks(batches, 0, books):
            text = ["".join(c) for c in hexed[codes].tolist()]
            sums = [int(e) if e < 1 << 63 else None for e in errors.astype(object).sum(axis=1)]
            columns = [*block.columns[1:], pa.array(text, pa.string()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "code", "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector"]
    return rows.select("vector", *names).mapInArrow(run, ", ".join([*fields, "code string", "error long"]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per kept row.

    Rows whose vector is null or holds a null, NaN or infinite component are left out; an empty
    table gives no rows. Vectors shorter than the longest, or than a multiple of the parts,
    count as ended by zeros. Null ids come last among the starting entries, and equal ids in the
    order of their vectors; with fewer rows than entries the codebooks are smaller. Repeated rows
    each get a row. ``label_error`` is null where a sum is beyond 64 bits. Extra columns are not read.
    """
    spark = settle(vectors.sparkSession)
    rows = kept(vectors, id_col, vector_col, label_col)
    books = fit(rows.select("vec_id", "vector"))
    if books is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    # A label as text that is never null, so that equal labels and nulls join alike.
    coded = pinned(encode(rows, books).select("vec_id", F.to_json(F.struct("label")).alias("key"), "code", "error"))
    sums = coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = join_lookup(coded, sums, ["key"], "n")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
