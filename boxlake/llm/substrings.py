"""Repeated passages by fingerprints of windows of words.

The corpus is its own reference. It is written as blocks of about `BLOCK_BYTES` of text,
and every start of `window` words in it is indexed by hash in shards spread over the
cluster. Of each document the windows whose hash occurs more than once are flagged, and
those that meet or overlap are joined, from whatever sources: the repeated passages. There
is no Lempel-Ziv parse: no longest match is looked for, and words aren't compared one by one.

A block sends each shard one packed list of its different hashes and gets back one bit for
each: a passage shared by a third of all documents costs a block one entry, and texts cross
the network once. Hashes have 64 bits: of n windows about n * n / 2^65 pairs collide, 5e-4
pairs in 10^8 windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import small_batches, window_hashes, word_hashes
from boxlake.session import cut_lineage

WINDOW = 35
BLOCK_BYTES = 4_000_000
# Windows of a shard: 8 bytes each in the task that settles it.
SHARD_WINDOWS = 1_000_000


def _pack(batches) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in small_batches(batches, "text", BLOCK_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
            writer.write_batch(batch)
        n = int(word_hashes(batch.column("text"))[3].sum())
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([n])], ["payload", "n_words"])


def blocks(docs: DataFrame) -> DataFrame:
    """`block, payload, n_words`: the rows `doc_id, text` of `docs`, compressed."""
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _pack, "payload binary, n_words long"
    )
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def starts(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of the texts, the word each begins at (counted over all
    texts), and the number of words of each text."""
    h, _, _, per_row = word_hashes(texts)
    hashes = window_hashes(h, window)
    inside = np.zeros(len(h), dtype=bool)
    first = np.cumsum(per_row) - per_row
    for a, n in zip(first.tolist(), per_row.tolist()):
        if n >= window:
            inside[a : a + n - window + 1] = True
    at = np.flatnonzero(inside)
    return hashes[at], at, per_row


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes sorted by shard and value, which of them come up twice, for each
    window its place among them, and where each shard begins."""
    known, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(_shard(known, shards), kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    bounds = np.searchsorted(_shard(known[order], shards), np.arange(shards + 1))
    return known[order], counts[order] > 1, place[back], bounds


def _index(window: int, shards: int):
    def index(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                texts = unpacked(payload.as_py())["text"].combine_chunks()
                known, twice, _, bounds = _by_shard(starts(texts, window)[0], shards)
                full = np.flatnonzero(np.diff(bounds))
                parts = [slice(bounds[s], bounds[s + 1]) for s in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full),
                        pa.array(np.full(len(full), block)),
                        pa.array([known[p].tobytes() for p in parts], pa.binary()),
                        pa.array([np.packbits(twice[p]).tobytes() for p in parts], pa.binary()),
                    ],
                    ["shard", "block", "hashes", "twice"],
                )

    return index


def _settle(rows: pa.Table) -> pa.Table:
    """One shard: for each block the bits of its hashes that occur more than once."""
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in rows["hashes"]]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(bool) for x, h in zip(rows["twice"], lists)]
    joined = np.concatenate(lists)
    _, back, counts = np.unique(joined, return_inverse=True, return_counts=True)
    often = (counts > 1)[back] | np.concatenate(twice)
    ends = np.cumsum([len(h) for h in lists])
    bits = [np.packbits(often[e - len(h) : e]).tobytes() for h, e in zip(lists, ends)]
    return pa.table({"block": rows["block"], "shard": rows["shard"], "bits": pa.array(bits, pa.binary())})


def factors(known: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Joined windows of one text of which `known[i]` tells whether the window at word i
    occurs elsewhere: the factors as (first word, word after the last). A factor takes
    every word that its windows reach; factors that meet or overlap are joined."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(known).tolist():
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + window)
        else:
            out.append((i, i + window))
    return out


def _parse(window: int, shards: int):
    def parse(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column("payload"), batch.column("answers")):
                rows = unpacked(payload.as_py())
                texts = rows["text"].combine_chunks()
                hashes, at, per_row = starts(texts, window)
                known, _, place, bounds = _by_shard(hashes, shards)
                often = np.zeros(len(known), dtype=bool)
                for answer in answers.as_py() or []:
                    part = slice(bounds[answer["shard"]], bounds[answer["shard"] + 1])
                    often[part] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=part.stop - part.start)
                flag = np.zeros(int(per_row.sum()), dtype=bool)
                flag[at] = often[place]
                removed, digests, spans = [], [], []
                begin = 0
                for text, n in zip(texts, per_row.tolist()):
                    words = text.as_py().encode().split()
                    found = factors(flag[begin : begin + n], window)
                    begin += n
                    kept, last = [], 0
                    for a, b in found:
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                    removed.append(n - len(kept))
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    spans.append([{"first": a, "end": b} for a, b in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"].combine_chunks(),
                        pa.array(per_row.astype(np.int64)),
                        pa.array(removed, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
                )

    return parse


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, spans` for each row of `docs` (`doc_id,
    text`). A word goes if it lies in a run of `window` words that starts anywhere else
    too; `spans` has the joined factors by word number, `kept_sha256` names the words left,
    joined by single spaces. Null and empty texts have no words; a repeated row repeats
    all its windows."""
    packed = blocks(docs)
    total = packed.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WINDOWS))
    sent = packed.select("block", "payload").mapInArrow(
        _index(window, shards), "shard long, block long, hashes binary, twice binary"
    )
    settled = sent.groupBy("shard").applyInArrow(lambda rows: _settle(rows), "block long, shard long, bits binary")
    answers = settled.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
    # Both sides grow with the corpus, so neither is ever broadcast.
    joined = packed.select("block", "payload").join(answers.hint("merge"), "block", "left")
    return joined.select("payload", "answers").mapInArrow(
        _parse(window, shards),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,end:int>>",
    )
