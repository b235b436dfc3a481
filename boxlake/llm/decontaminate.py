"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs with at most k edits shares m + 1 - q (k + 1)
q-grams or more with its occurrence, and their diagonals (place in the text less place in
the passage) differ by at most k. So shared q-grams are counted in overlapping bands of
diagonals, bands that reach the bound are kept, and a banded alignment decides.

The passages are the fixed side. They travel to the tasks in blocks of at most
`BLOCK_CHARS` characters; a larger benchmark takes more blocks over the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.llm.common import code_points, mix, small_batches, unused

Q = 10
RATE = 0.08  # edits allowed for each character of a passage
BLOCK_CHARS = 4_000_000
BITS = 22  # of the table that settles most q-grams that no passage has

_SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return _SPACE.sub(" ", (text or "").lower()).strip()


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in a passage of `m` characters: `rate`, less where the lemma's bound
    would fall below one common q-gram; -1 where the passage is shorter than q."""
    return min(int(rate * m), (m + 1 - 1) // q - 1) if m >= q else -1


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += wide[j : j + n]
    return mix(h)


class Index:
    """The q-grams of some passages: sorted hashes, and for each its passages and places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.texts = [normal(t) for _, t in items]
        parts = [(gram_hashes(code_points([t])[0]), n) for n, t in enumerate(self.texts) if len(t) >= Q]
        self.short = [n for n, t in enumerate(self.texts) if 0 < len(t) < Q]
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.item = np.concatenate([np.full(len(h), n) for h, n in parts])[order] if parts else order
        self.place = np.concatenate([np.arange(len(h)) for h, _ in parts])[order] if parts else order
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(order)])
        self.present = np.zeros(1 << BITS, dtype=bool)
        self.present[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.size = sizes
        self.edits = np.array([budget(int(m)) for m in sizes], dtype=np.int64)


def aligned(passage: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Whether `passage` occurs in `text` with at most `edits` edits along the diagonals
    `low` to `high`: the passage's rows over a band of columns that moves with them."""
    low, high = low - edits, high + edits
    width = high - low + 1
    far = len(passage) + len(text) + 1
    padded = np.full(len(passage) + width + len(text) + abs(low) + 1, -1, dtype=np.int64)
    shift = max(0, -low)
    padded[shift : shift + len(text)] = text
    cells = np.arange(width)
    # Row 0: any place in the text may begin an occurrence.
    ends = low + cells
    row = np.where((ends >= 0) & (ends <= len(text)), 0, far)
    for i, c in enumerate(passage.tolist()):
        ends = low + cells + i + 1  # characters of the text used
        at = ends - 1 + shift
        inside = (ends >= 1) & (ends <= len(text))
        same = inside & (padded[np.clip(at, 0, len(padded) - 1)] == c)
        best = np.where(inside, row + ~same, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.minimum.accumulate(best - cells) + cells
        row = np.where((ends >= 0) & (ends <= len(text)), best, far)
        if row.min() > edits:
            return False
    return bool(row.min() <= edits)


def leaks(index: Index, texts: list[str]) -> list[list[int]]:
    """Ids of the passages that occur in each of the (normalised) texts, ascending."""
    found: list[set[int]] = [set() for _ in texts]
    for n in index.short:
        for row, text in enumerate(texts):
            if index.texts[n] in text:
                found[row].add(n)
    codes, offsets = code_points([t + "\x00" for t in texts])
    h = gram_hashes(codes)
    at = np.flatnonzero(index.present[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if len(at) and len(index.hashes):
        slot = np.minimum(np.searchsorted(index.hashes, h[at]), len(index.hashes) - 1)
        hit = index.hashes[slot] == h[at]
        at, slot = at[hit], slot[hit]
        row = np.searchsorted(offsets, at, side="right") - 1
        count = index.count[slot]
        post = np.repeat(index.first[slot] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        item, row, at = index.item[post], np.repeat(row, count), np.repeat(at, count)
        diagonal = at - offsets[row] - index.place[post]
        step = index.edits[item] + 1
        band = diagonal // step
        keys = np.stack([np.r_[row, row], np.r_[item, item], np.r_[band, band - 1]], axis=1)
        order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
        keys = keys[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.r_[new, len(keys)])
        m, k = index.size[keys[new, 1]], index.edits[keys[new, 1]]
        for r, n, b in keys[new[sizes >= m + 1 - Q * (k + 1)]].tolist():
            if n in found[r]:
                continue
            if index.texts[n] in texts[r]:
                found[r].add(n)
                continue
            k, m = int(index.edits[n]), int(index.size[n])
            low, high = b * (k + 1), (b + 2) * (k + 1) - 1
            begin = max(0, low - k)
            piece = codes[offsets[r] + begin : min(offsets[r + 1] - 1, offsets[r] + high + m + k + 1)]
            if aligned(code_points([index.texts[n]])[0], piece, low - begin, high - begin, k):
                found[r].add(n)
    return [sorted(int(index.ids[n]) for n in s) for s in found]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    usable = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = usable if n == 1 else usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").toLocalIterator()]


def add_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "items", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` with the column `name`: ids of the passages that occur in `text`, ascending,
    each once. Null and empty texts hold none, null and empty passages occur nowhere;
    passages shorter than `Q` characters must occur exactly. Rows stay as they are."""
    kept = [f for f in docs.schema.fields if f.name != name]
    out = docs.select(*[f"`{f.name}`" for f in kept])
    for i, items in enumerate(_blocks(benchmark, block_chars)):
        schema = T.StructType([*out.schema.fields, T.StructField(f"{name}__{i}", T.ArrayType(T.LongType()))])
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, shared=shared, names=schema.names):
            index = Index(shared.value)
            for batch in small_batches(batches, "text"):
                lists = leaks(index, [normal(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names)

        out = out.mapInArrow(search, schema)
    found = [f"{name}__{j}" for j in range(i + 1)]
    return out.withColumn(name, F.array_sort(F.array_distinct(F.concat(*found)))).drop(*found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the rows in which a passage occurs; all columns as they are."""
    name = unused(docs, "leaked_items")
    return add_leaks(docs, benchmark, name, **options).filter(F.size(name) == 0).drop(name)
