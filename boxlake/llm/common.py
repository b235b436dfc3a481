"""Shared pieces: word splitting, folds, ranks, chunking of Arrow batches, numpy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.session import cut_lineage

# The word pattern of the contracts: runs of anything but space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Code points (or bytes) handled at once by numpy inside a task; bounds its memory.
CHUNK = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, however often `use` reads it
    (a column inside a lambda would be computed for each element)."""
    return F.transform(F.array(value), use)[0]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def hash_place(key: str, seed: int) -> tuple[Column, int]:
    """The place of a row by its key's hash, and the number of places."""
    span = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(span)), span


def bounded_sample(df: DataFrame, n: int, total: int, seed: int, key: str, *ties: Column | str) -> DataFrame:
    """The `n` rows of `df` first in the order of the key's hash. Of `total` rows (about),
    only those with a hash small enough for twice as many are gathered and sorted, so that
    the gathered part doesn't grow with the table."""
    place, span = hash_place(key, seed)
    if total > 2 * n:
        df = df.filter(place < -(-2 * n * span // total))
    return df.orderBy(place, key, *ties).limit(n)


def slices(lengths, limit: int = CHUNK) -> Iterator[slice]:
    """Consecutive slices of at most `limit` in total, a longer item alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield slice(start, len(lengths))


def small_batches(batches, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the named string column holds about `limit` bytes."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        for part in slices(sizes.tolist(), limit):
            yield batch.slice(part.start, part.stop - part.start)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the offset of each text (one more at the end)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return data, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a string column: 64-bit hash, first byte, end byte (both in the
    column's joined bytes), and the number of words of each row.

    Works on UTF-8 bytes: the separators are ASCII, so words cut there are whole."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    bounds = offsets - lo
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~space
    edge = np.diff(inside)
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] |= ~space[inner]
    ends[inner - 1] |= ~space[inner - 1]
    first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    per_row = np.searchsorted(first, bounds[1:]) - np.searchsorted(first, bounds[:-1])
    if not len(first):
        return np.zeros(0, np.uint64), first, end, per_row
    # Polynomial in the byte's place within the word, so equal words hash alike anywhere.
    powers = np.ones(int((end - first).max()), dtype=np.uint64)
    np.multiply.accumulate(np.concatenate([powers[:1], np.full(len(powers) - 1, BASE)]), out=powers)
    lengths = end - first
    at = np.arange(int(lengths.sum()))
    at -= np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = data[~space].astype(np.uint64)
    kept += np.uint64(1)
    kept *= powers[at]
    sums = np.add.reduceat(kept, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, end, per_row


def window_hashes(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `size` consecutive entries of `h`; the caller leaves out those
    that cross a row. One entry per start, len(h) - size + 1 in all."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        salt = np.uint64(seed * 2 + 1) * BASE
        for j in range(size):
            out *= BASE
            out += h[j : j + n] ^ salt
    return mix(out)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, size: str) -> DataFrame:
    """`df` with the place of each row in its group (`name`, from 0) and the rows of the group
    (`size`). Rows are dealt out by ranges of group and order, so one group spreads over many
    tasks; only one line for each group and range is gathered. Rows that tie in everything
    are told apart by where they were read, so copies spread too."""
    seq, at, part, ahead = (unused(df, c) for c in ("_seq", "_at", "_part", "_ahead"))
    ties = [*[F.col(f"`{k}`") for k in keys], *order, F.col(seq)]
    spread = df.withColumn(seq, F.monotonically_increasing_id()).repartitionByRange(*ties).sortWithinPartitions(*ties)
    spread = cut_lineage(spread.drop(seq).withColumn(at, F.monotonically_increasing_id()))
    spread = spread.withColumn(part, F.shiftrightunsigned(at, 33))
    runs = spread.groupBy(*[f"`{k}`" for k in keys], part).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*[f"`{k}`" for k in keys])
    before = F.sum("n").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(part).alias("_p"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias(ahead),
        F.sum("n").over(group).alias(size),
    )
    match = F.col(part) == F.col("_p")
    for i, k in enumerate(keys):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    found = spread.join(runs, match)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(at) + F.col(ahead)).alias(name), size)
