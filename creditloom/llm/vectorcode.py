"""Operator 11, vector codes: product codebooks of 64 entries, nearest entries found by slicing sorted coordinates and intersecting bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import stored

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
#: Components up to here keep all sums of squares of a vector within 64 bits; larger ones are worked out with whole Python numbers.
SAFE = 1 << 26
LONG = (1 << 63) - 1
BATCH = 8192


def usable(vector: Column) -> Column:
    """True where the vector is neither null nor holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers."""
    grown = np.floor(values.astype(np.float64) * SCALE)
    if not len(grown) or np.abs(grown).max(initial=0) <= SAFE:
        return grown.astype(np.int64)
    exact = [v * SCALE for v in values.ravel().tolist()]  # 256 x is exact but where it passes the largest double
    return np.array([int(v // 1) if np.isfinite(v) else int(x) * SCALE for v, x in zip(exact, values.ravel().tolist(), strict=True)], dtype=object).reshape(values.shape)


class Slices:
    """One codebook (entries x dimensions). Each dimension holds its coordinates in order, and for each place in that order the mask of all entries before it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = [np.argsort(c, kind="stable") for c in entries.T]
        self.sorted = [c[o] for c, o in zip(entries.T, self.order, strict=True)]
        bits = [np.uint64(1) << o.astype(np.uint64) for o in self.order]
        self.before = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(b)]) if len(b) else np.zeros(1, np.uint64) for b in bits]

    def distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = x - self.entries[entry]
        return (apart * apart).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number not below the distance to the nearest entry: the best of the neighbours in each dimension."""
        best = None
        for values, order, held in zip(x.T, self.order, self.sorted, strict=True):
            at = np.searchsorted(held, values)
            for place in (at - 1, at):
                d = self.distance(x, order[np.clip(place, 0, len(order) - 1)])
                best = d if best is None else np.minimum(best, d)
        if best is None:  # a part without components
            return np.zeros(len(x), dtype=np.int64)
        if best.dtype == object:
            return np.array([int(b**0.5 * (1 + 1e-9)) + 1 for b in best], dtype=object)
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that lie within ``radius`` in every dimension: a range of each order, masks of its ends taken apart, all dimensions ANDed."""
        full = np.uint64((1 << len(self.entries)) - 1)
        mask = np.full(len(x), full, dtype=np.uint64)
        for values, held, before in zip(x.T, self.sorted, self.before, strict=True):
            low = np.searchsorted(held, values - radius, side="left")
            high = np.searchsorted(held, values + radius, side="right")
            mask &= before[high] ^ before[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of the least squared distance for each row and that distance; of equal ones the first entry.

        The box of a radius that some entry reaches holds every entry that is as near, so only the bits left are measured.
        """
        mask = self.candidates(x, self.radius(x))
        entry = np.zeros(len(x), dtype=np.int64)
        best = np.full(len(x), LONG, dtype=np.int64) if x.dtype != object else np.array([None] * len(x), dtype=object)
        rows = np.arange(len(x))
        while len(rows):
            lowest = mask[rows] & (~mask[rows] + np.uint64(1))
            index = np.log2(lowest.astype(np.float64)).astype(np.int64)
            d = self.distance(x[rows], index)
            better = d < best[rows] if x.dtype != object else np.array([b is None or a < b for a, b in zip(d, best[rows], strict=True)], dtype=bool)
            best[rows[better]], entry[rows[better]] = d[better], index[better]
            mask[rows] ^= lowest
            rows = rows[mask[rows] != 0]
        return entry, best


def _rows_of(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of ``width`` components, and those vectors as integers."""
    lengths = np.diff(vectors.offsets.to_numpy())
    fits = np.flatnonzero(lengths == width)
    flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, whole(flat.reshape(len(fits), width))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def seed_books(df: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts x entries x components) from the vectors of the ``entries`` smallest keys; equal keys go by their vectors."""
    first = df.where(F.col(key).isNotNull()).orderBy(key, vector).limit(entries).select(vector).collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    width = len(first[0][0])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    x = whole(np.array([r[0] for r in first if len(r[0]) == width], dtype=np.float64).reshape(-1, width))
    return np.stack(_parts(x, parts))


def refined(df: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of the parts nearest to it. Tasks send a sum for each entry and component that they met."""
    parts, entries, length = books.shape
    shipped = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in shipped.value]
        sums, counts = np.zeros((parts, entries, length), dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for batch in _batches(batches):
            _, x = _rows_of(batch.column(0), parts * length)
            for p, own in enumerate(_parts(x, parts)):
                entry, _ = slices[p].nearest(own)
                counts[p] += np.bincount(entry, minlength=entries)
                met, at = np.unique(entry, return_inverse=True)
                part = np.zeros((len(met), length), dtype=own.dtype)
                np.add.at(part, at, own)
                sums[p, met] += part.astype(object)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), pa.array([[int(v) for v in s] for s in sums[p, e]], pa.list_(pa.decimal128(38)))],
            ["part", "entry", "n", "sums"],
        )

    met = df.select(vector).mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    totals = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(length)])
    new = books.astype(object)
    for r in totals.collect():  # parts x entries rows
        new[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length)]
    return new.astype(np.int64) if not new.size or np.abs(new).max() <= SAFE else new


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def encode(df: DataFrame, books: np.ndarray, key: str, vector: str, label: str) -> DataFrame:
    """``(key, label, code, error)`` of every row. A vector of another length than the codebooks' has neither code nor error."""
    parts, _, length = books.shape
    shipped = df.sparkSession.sparkContext.broadcast(books)
    rows = df.select(key, label, vector)
    schema = df.select(key, label).schema.add("code", "string").add("error", "long")
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in shipped.value]
        for batch in _batches(batches):
            fits, x = _rows_of(batch.column(2), parts * length)
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            found = [slices[p].nearest(own) for p, own in enumerate(_parts(x, parts))] if len(fits) else []
            if found:
                text = ["".join(r) for r in digits[np.stack([e for e, _ in found], axis=1)].tolist()]
                total = sum(d for _, d in found).tolist()
                for i, c, d in zip(fits.tolist(), text, total, strict=True):
                    code[i], error[i] = c, int(d) if d <= LONG else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], [key, label, "code", "error"])

    return rows.mapInArrow(run, schema)


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all vectors: ``vec_id, code, error, label_error, codebooks_sha256``; other columns are not read.

    Codebooks start from the smallest keys and are refined ``rounds`` times over all rows; only they (parts x entries x
    components) and their sums reach the driver. Rows whose vector is null or holds null or non-finite components go. A null key is
    coded but seeds nothing; rows with one key are coded one by one and seed in the order of their vectors; fewer rows than entries
    give fewer entries; an empty table gives no rows. Vectors of another length than that of the smallest key have a null code
    and error. An error beyond 64 bits is null. A label's errors are summed before the shuffle, null labels together.
    """
    if not 1 <= entries <= 64:
        raise ValueError("a mask has room for 1 to 64 entries")
    kept = df.select(F.col(key), F.col(vector), F.col(label)).where(usable(F.col(vector)))
    books = seed_books(kept, key, vector, parts, entries)
    if not books.shape[1]:  # no row with a key: nothing to start from
        return kept.where(F.lit(False)).select(key, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256"))
    for _ in range(rounds):
        books = refined(kept, vector, books)
    coded = stored(encode(kept, books, key, vector, label), "codes")
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label"))).select(key, "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
