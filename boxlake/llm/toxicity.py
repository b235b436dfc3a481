"""Toxicity by class-conditional Kneser-Ney models of words and characters.

Two models, one of toxic and one of ordinary labelled texts, are built from all labelled
training documents. Words have the number of documents of each class as counts, discounted,
and share one backoff, so that a rare word is as likely in both. Characters (of the words)
have own counts in orders 5 to 3, tokens at the top and continuation counts below; orders 2
and 1 are shared. A word's evidence is the difference of its log-likelihoods, that of its
characters normalised by its length. A text's is that of its strongest words and the mean
over its length, which a logistic curve, fitted on labelled documents left out of the
counts, turns into a score.

The models grow with the corpus and stay in Spark: grams and words are tables keyed by
themselves. Texts are packed into blocks that hold each of their words once; a block asks for
each of its different grams once, and for the words that a filter of fixed size lets through,
by joins, and scores its texts with the answers. Only totals, the curve and that filter come
to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import bounded_sample, fold, slices, small_batches, unused, window_hashes
from boxlake.session import cut_lineage

ORDER = 5
OWN = 3  # the lowest order with counts for each class
DISCOUNT = 0.75
WORD_DISCOUNT = 3.0  # documents; copies and chance meetings of a rare word stay below it
ALPHABET = 1 << 16  # of the uniform distribution below the lowest order
# Labelled documents that the logistic curve is fitted on, taken in hash order.
CALIBRATION_ROWS = 20_000
CUT = 0.7
FEATURES = 5
NAMES = [f"f{i}" for i in range(1, FEATURES)]
STRONG = 1.0
TEXT_AT_ONCE = 500_000  # bytes of text whose words a task holds as arrays
# Different words, counted by block, for each shard that answers what blocks ask.
SHARD_WORDS = 250_000
BLOCK_BYTES = 24_000_000  # of text (or of words) that share a list of different words
# Places of a filter of the words with evidence: blocks ask only for words it may hold.
FILTER = 1 << 20
PAD = "\x02"
END = "\x03"


def _shuffled(df: DataFrame) -> DataFrame:
    """For a side that grows with the corpus: joined by shuffle at any size."""
    return df.hint("merge")


# ------------------------------------------------------------------ words

def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word among the different words, these words, and each word's row."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lowered, r"[\x20\x09-\x0D]+")
    flat = pc.ascii_trim(pc.list_flatten(lists), ".,;:!?\"'()")
    rows = np.asarray(pc.list_parent_indices(lists))
    coded = flat.dictionary_encode()
    numbers = np.asarray(coded.indices)
    filled = np.asarray(pc.not_equal(flat, ""))
    return numbers[filled], coded.dictionary, rows[filled]


def _count_words(batches) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", TEXT_AT_ONCE):
        numbers, vocabulary, rows = split_words(batch.column("text"))
        pairs = np.unique(rows * len(vocabulary) + numbers)
        rows, numbers = np.divmod(pairs, max(1, len(vocabulary)))
        toxic = np.asarray(batch.column("toxic"))[rows].astype(bool)
        n = len(vocabulary)
        t = np.bincount(numbers[toxic], minlength=n)
        o = np.bincount(numbers[~toxic], minlength=n)
        seen = np.flatnonzero(t + o)
        yield pa.RecordBatch.from_arrays(
            [vocabulary.take(pa.array(seen)), pa.array(t[seen].astype(np.int64)), pa.array(o[seen].astype(np.int64))],
            ["word", "t", "o"],
        )


def word_counts(labelled: DataFrame) -> DataFrame:
    """`word, t, o`: how many toxic and ordinary texts hold each word. Each task adds up its
    own words before the shuffle, so a frequent word is a few rows."""
    counted = labelled.select("text", "toxic").mapInArrow(_count_words, "word string, t long, o long")
    return counted.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


# ------------------------------------------------------------------ n-grams

def known_words(counts: DataFrame) -> DataFrame:
    """`word, evidence` of the words that point to the toxic class. P(w) of a class is
    (count - discount) / total + weight * shared(w)."""
    d = F.lit(WORD_DISCOUNT)
    totals = counts.agg(
        *[F.sum(c).cast("double").alias(f"n_{c}") for c in "to"],
        *[F.sum(F.least(F.col(c), d)).alias(f"d_{c}") for c in "to"],
    ).first()
    if not totals["n_t"] or not totals["n_o"]:
        return counts.select("word", F.lit(0.0).alias("evidence")).limit(0)
    shared = (F.col("t") + F.col("o")) / (totals["n_t"] + totals["n_o"])
    p = {
        c: (F.greatest(F.col(c) - d, F.lit(0.0)) + totals[f"d_{c}"] * shared) / totals[f"n_{c}"] for c in "to"
    }
    known = counts.filter(F.col("t") > d).select("word", F.log(p["t"] / p["o"]).alias("evidence"))
    return known.filter("evidence > 0")


def gram_counts(counts: DataFrame) -> dict[int, DataFrame]:
    """For each order: `gram, t, o`. At the top, tokens; below, continuation counts: the
    different longer grams ending in this one. Up to order 2 both classes hold the sum."""
    padded = F.concat(F.lit(PAD * (ORDER - 1)), "word", F.lit(END))
    ends = F.sequence(F.lit(1), F.length("word") + 1)
    top = (
        counts.select(F.explode(F.transform(ends, lambda i: F.substring(padded, i, ORDER))).alias("gram"), "t", "o")
        .groupBy("gram")
        .agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    )
    grams = {ORDER: cut_lineage(top)}
    for n in range(ORDER - 1, 0, -1):
        above = grams[n + 1].withColumn("gram", F.substring("gram", 2, n))
        if n >= OWN:
            sums = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in "to"]
        else:
            sums = [F.count(F.lit(1)).alias(c) for c in "to"]
        grams[n] = cut_lineage(above.groupBy("gram").agg(*sums))
    return grams


def gram_ratios(seen: DataFrame, grams: dict[int, DataFrame]) -> DataFrame:
    """`gram, ratio`: the log-likelihood ratio of the last character of each of the different
    grams `seen`, of the top order. Each order meets its own counts, those of what comes
    before the last character, and the order below."""
    below = None
    for n in range(1, ORDER + 1):
        sums = [F.sum(c).alias(f"n_{c}") for c in "to"] + [F.count_if(F.col(c) > 0).alias(f"d_{c}") for c in "to"]
        here = seen.select(F.substring("gram", ORDER - n + 1, n).alias("gram")).distinct()
        here = here.join(_shuffled(grams[n]), "gram", "left")
        if below is None:
            totals = grams[n].agg(*sums).first()
            here = here.select("*", *[F.lit(totals[c]).cast("long").alias(c) for c in ("n_t", "n_o", "d_t", "d_o")])
            lower = {c: F.lit(1.0 / ALPHABET) for c in "to"}
        else:
            before = grams[n].groupBy(F.substring("gram", 1, n - 1).alias("before")).agg(*sums)
            here = here.select("*", F.substring("gram", 1, n - 1).alias("before"), F.substring("gram", 2, n - 1).alias("after"))
            here = here.join(_shuffled(before), "before", "left").join(_shuffled(below), "after")
            lower = {c: F.col(f"p_{c}") for c in "to"}
        p = []
        for c in "to":
            total = F.col(f"n_{c}")
            mixed = F.greatest(F.coalesce(c, F.lit(0)) - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * F.col(f"d_{c}") / total * lower[c]
            p.append(F.when(total > 0, F.least(mixed, F.lit(1.0))).otherwise(lower[c]).alias(f"p_{c}"))
        below = cut_lineage(here.select(F.col("gram").alias("after"), *p))
    return below.select(F.col("after").alias("gram"), (F.log(F.col("p_t") + 1e-12) - F.log(F.col("p_o") + 1e-12)).alias("ratio"))


# ------------------------------------------------------------------ words in blocks

def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _grams_of(words: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The words with their padding in one text, where each of their different grams first
    begins, the number of the gram at each character, and the characters of each word."""
    joined = "".join([PAD * (ORDER - 1) + word + END for word in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(word) + 1 for word in words], dtype=np.int64)
    at = np.arange(lengths.sum()) + np.repeat(np.arange(len(words)) * (ORDER - 1), lengths)
    _, first, number = np.unique(window_hashes(codes, ORDER)[at], return_index=True, return_inverse=True)
    return joined, at[first], number, lengths


def _shards(strings: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings' places in order of their shards, and where each shard begins."""
    of = np.fromiter((zlib.crc32(s.encode()) for s in strings), np.int64, len(strings)) % n
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(n + 1))


def _told_words(words: list[str], known: np.ndarray) -> np.ndarray:
    """The places of the words that may have evidence."""
    of = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % FILTER
    return np.flatnonzero(np.unpackbits(known, count=FILTER)[of])


def _asked_of(words: list[str], known: np.ndarray | None) -> list[str]:
    """What a block asks for: words, with a filter of the `known` ones, else grams."""
    if known is not None:
        return [words[i] for i in _told_words(words, known).tolist()]
    joined, first, _, _ = _grams_of(words)
    return [joined[i : i + ORDER] for i in first.tolist()]


def _word_filter(known: DataFrame) -> np.ndarray:
    """Which places of the filter hold a word of `known`, as bits; a fixed size for any corpus."""
    places = known.select((F.crc32(F.col("word").cast("binary")) % FILTER).cast("int").alias("place")).distinct().toArrow()
    filled = np.zeros(FILTER, dtype=bool)
    filled[np.asarray(places["place"])] = True
    return np.packbits(filled)


def _ask(known: np.ndarray | None, shards: int):
    def ask(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("words")):
                keys = _asked_of(_unpacked(payload.as_py())["word"].to_pylist(), known)
                order, bounds = _shards(keys, shards)
                sorted_ = pa.array(keys, pa.string()).take(pa.array(order))
                full = np.flatnonzero(np.diff(bounds))
                lists = [_packed(pa.table({"key": sorted_.slice(bounds[s], bounds[s + 1] - bounds[s])})) for s in full]
                n = len(full)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int64)), pa.array([block] * n, pa.int64()), pa.array(lists, pa.binary())], ["shard", "block", "keys"]
                )

    return ask


def _different(rows: pa.Table) -> pa.Table:
    """The different keys that the blocks ask one shard for."""
    lists = [_unpacked(k.as_py())["key"] for k in rows["keys"]]
    return pa.table({"gram": pa.chunked_array([c for column in lists for c in column.chunks], pa.string()).unique()})


def _tell(asked: pa.Table, known: pa.Table) -> pa.Table:
    """One shard: for each block the values of its keys, in the order asked; 0 where unknown."""
    index = known["key"].combine_chunks()
    values = np.append(np.asarray(known["v"], dtype=np.float32), np.float32(0))
    told = []
    for keys in asked["keys"]:
        found = pc.fill_null(pc.index_in(_unpacked(keys.as_py())["key"].combine_chunks(), index), len(values) - 1)
        told.append(_packed(pa.table({"v": values[np.asarray(found)]})))
    return pa.table({"block": asked["block"], "shard": asked["shard"], "values": pa.array(told, pa.binary())})


def _answers(asked: DataFrame, known: DataFrame, shards: int, kind: str) -> DataFrame:
    """`block, kind, shard, values` from what blocks ask and `key, v`."""
    shard = (F.crc32(F.col("key").cast("binary")) % shards).alias("shard")
    told = asked.groupBy("shard").cogroup(known.select(shard, "key", "v").groupBy("shard"))
    told = told.applyInArrow(lambda a, k: _tell(a, k), "block long, shard long, values binary")
    return told.select("block", F.lit(kind).alias("kind"), "shard", "values")


def _answered(blocks: DataFrame, counts: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """`blocks` (`block, n_words, words, ...`) with `answers`, a list of `kind, shard, values`,
    the number of shards, and the filter of words with evidence. A block sends each shard one packed list of its different grams
    (words) and gets one of their ratios (evidence) back."""
    shards = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS))
    schema = "shard long, block long, keys binary"
    grams = cut_lineage(blocks.select("block", "words").mapInArrow(_ask(None, shards), schema))
    seen = grams.groupBy("shard").applyInArrow(lambda rows: _different(rows), "gram string")
    ratios = gram_ratios(cut_lineage(seen), gram_counts(counts))
    evidence = cut_lineage(known_words(counts))
    known = _word_filter(evidence)
    words = blocks.select("block", "words").mapInArrow(_ask(known, shards), schema)
    told = _answers(grams, ratios.select(F.col("gram").alias("key"), F.col("ratio").alias("v")), shards, "gram")
    told = told.unionByName(_answers(words, evidence.select(F.col("word").alias("key"), F.col("evidence").alias("v")), shards, "word"))
    told = told.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "values")).alias("answers"))
    return blocks.join(_shuffled(told), "block", "left"), shards, known


def _of_words(words: list[str], answers: list[dict] | None, shards: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The evidence of each word as a whole and of its characters, the latter divided by the
    root of their number, so that neither many common characters nor few rare ones decide
    alone. A word that doesn't point to the toxic class has 0 as a whole."""
    values = {}
    for kind in ("gram", "word"):
        keys = _asked_of(words, known if kind == "word" else None)
        order, bounds = _shards(keys, shards)
        values[kind] = np.zeros(len(keys))
        for told in answers or []:
            if told["kind"] == kind:
                at = order[bounds[told["shard"]] : bounds[told["shard"] + 1]]
                values[kind][at] = np.asarray(_unpacked(told["values"])["v"])
    if not words:
        return np.zeros(0), np.zeros(0)
    _, _, number, lengths = _grams_of(words)
    sums = np.add.reduceat(values["gram"][number], np.cumsum(lengths) - lengths)
    whole = np.zeros(len(words))
    whole[_told_words(words, known)] = values["word"]
    return whole, sums / np.sqrt(lengths)


def _pack_vocabulary(batches) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "word", BLOCK_BYTES):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([_packed(batch.select(["word"]))], pa.binary())], ["n_words", "words"])


def _unpack_vocabulary(shards: int, known: np.ndarray):
    def unpack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column("words"), batch.column("answers")):
                words = _unpacked(payload.as_py())["word"].combine_chunks()
                whole, parts = _of_words(words.to_pylist(), answers.as_py(), shards, known)
                yield pa.RecordBatch.from_arrays([words, pa.array(whole), pa.array(parts)], ["word", "whole", "parts"])

    return unpack


def word_evidence(vocabulary: DataFrame, labelled: DataFrame) -> DataFrame:
    """`word, whole, parts` of the words `vocabulary` by the models of `labelled` (`text,
    toxic`): see `_of_words`."""
    blocks = vocabulary.select("word").mapInArrow(_pack_vocabulary, "n_words long, words binary")
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    told, shards, known = _answered(blocks, cut_lineage(word_counts(labelled)))
    return told.select("words", "answers").mapInArrow(_unpack_vocabulary(shards, known), "word string, whole double, parts double")


# ------------------------------------------------------------------ texts

def _pack_texts(batches) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", BLOCK_BYTES):
        counted, vocabulary, rows = [], pa.array([], pa.string()), []
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for part in slices(lengths, TEXT_AT_ONCE):  # words as arrays are many times their text
            numbers, words, at = split_words(batch.column("text").slice(part.start, part.stop - part.start))
            pairs, n = np.unique(at.astype(np.int64) * max(1, len(words)) + numbers, return_counts=True)
            at, numbers = np.divmod(pairs, max(1, len(words)))
            used, numbers = np.unique(numbers, return_inverse=True)
            counted.append(words.take(pa.array(used)))
            rows.append((at + part.start, numbers, n))
        coded = pa.chunked_array(counted, pa.string()).dictionary_encode().combine_chunks() if counted else None
        if coded is not None:
            inorder = pc.array_sort_indices(coded.dictionary)  # neighbours alike compress well
            vocabulary = coded.dictionary.take(inorder)
            place = np.empty(len(vocabulary), dtype=np.int64)
            place[np.asarray(inorder)] = np.arange(len(vocabulary))
            back, start, found = place[np.asarray(coded.indices)], 0, []
            for words, (at, numbers, n) in zip(counted, rows):
                found.append((at, back[start + numbers], n))
                start += len(words)
            rows = found
        row, word, n = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3))
        pairs = pa.table({"row": row.astype(np.int32), "word": word.astype(np.int32), "n": n.astype(np.int32)})
        filled = batch.column("text").is_valid()
        parts = [pa.table({"word": vocabulary}), pairs, pa.table({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "filled": filled})]
        packed = [pa.array([_packed(p)], pa.binary()) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([len(vocabulary)]), *packed], ["n_words", "words", "pairs", "rows"])


def _features(shards: int, known: np.ndarray):
    def features(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, pairs, rows, answers = (batch.column(c)[i] for c in ("words", "pairs", "rows", "answers"))
                whole, parts = _of_words(_unpacked(words.as_py())["word"].to_pylist(), answers.as_py(), shards, known)
                rows, pairs = _unpacked(rows.as_py()), _unpacked(pairs.as_py())
                row, word, n = (np.asarray(pairs[c]) for c in ("row", "word", "n"))
                first = np.flatnonzero(np.diff(row, prepend=-1))  # pairs are in order of their rows
                values = np.zeros((FEATURES - 1, rows.num_rows))
                if len(first):
                    at, whole, parts = row[first], whole[word], parts[word]
                    values[0, at] = np.maximum.reduceat(whole, first)
                    values[1, at] = np.log1p(np.add.reduceat(n * np.where(whole > STRONG, whole, 0.0), first))
                    values[2, at] = np.maximum.reduceat(parts, first)
                    values[3, at] = np.add.reduceat(n * parts, first) / np.add.reduceat(n, first)
                yield pa.RecordBatch.from_arrays(
                    [*(rows[c].combine_chunks() for c in ("doc_id", "h")), *map(pa.array, values)], ["doc_id", "h", *NAMES]
                )

    return features


def _unpack_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("rows")):
            rows = _unpacked(payload.as_py())
            rows = rows.append_column("row", pa.array(np.arange(rows.num_rows, dtype=np.int32)))
            rows = rows.append_column("block", pa.array([block] * rows.num_rows, pa.int64()))
            yield from rows.filter(rows["filled"]).select(["block", "row", "doc_id", "h"]).combine_chunks().to_batches()


def text_blocks(docs: DataFrame) -> DataFrame:
    """The rows `doc_id, h, text` of `docs` as blocks: their words once each, which row has
    which word how often, and the rows themselves without their texts."""
    packed = docs.select("doc_id", "h", "text").mapInArrow(_pack_texts, "n_words long, words binary, pairs binary, rows binary")
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


def _count_words_of_blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, pairs, marks in zip(*(batch.column(c) for c in ("words", "pairs", "marks"))):
            words, pairs = _unpacked(words.as_py())["word"].combine_chunks(), _unpacked(pairs.as_py())
            row, word = (np.asarray(pairs[c]) for c in ("row", "word"))
            weight = np.zeros((2, int(row.max(initial=0)) + 1), dtype=np.int64)
            for mark in marks.as_py():  # a row has one text, and a line for each labelled copy of its id
                if mark["row"] < weight.shape[1]:
                    weight[1 - int(mark["toxic"] > 0), mark["row"]] += 1
            t, o = (np.bincount(word, weights=w[row], minlength=len(words)).astype(np.int64) for w in weight)
            seen = np.flatnonzero(t + o)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)), pa.array(t[seen]), pa.array(o[seen])], ["word", "t", "o"])


def _may_be_marked(doc_id: np.ndarray) -> np.ndarray:
    """Rows whose crc32(doc_id) lets them into the counts, labelled or not."""
    of = np.fromiter((zlib.crc32(str(d).encode()) for d in doc_id.tolist()), np.int64, len(doc_id))
    return (of % 3 != 1) & (of % 7 != 0)


def _words_to_count(batches) -> Iterator[pa.RecordBatch]:
    """Blocks without how often a row has a word, and without the rows that are never counted."""
    for batch in batches:
        for block, words, pairs, rows in zip(*(batch.column(c) for c in ("block", "words", "pairs", "rows"))):
            pairs, ids = _unpacked(pairs.as_py()), _unpacked(rows.as_py())["doc_id"]
            may = np.array(ids.is_valid())
            may[may] = _may_be_marked(np.asarray(ids.drop_null()))
            pairs = pairs.select(["row", "word"]).filter(pa.array(may[np.asarray(pairs["row"])]))
            used, place = np.unique(np.asarray(pairs["word"]), return_inverse=True)
            words = _unpacked(words.as_py()).take(pa.array(used))
            pairs = pa.table({"row": pairs["row"], "word": place.astype(np.int32)})
            packed = [pa.array([_packed(p)], pa.binary()) for p in (words, pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), *packed], ["block", "words", "pairs"])


def block_word_counts(blocks: DataFrame, marked: DataFrame) -> DataFrame:
    """`word, t, o` as of `word_counts`, of the rows `marked` (`block, row, toxic`), of those
    that `_may_be_marked`. Labels travel to the blocks, so no text is shuffled for them."""
    marks = marked.groupBy("block").agg(F.collect_list(F.struct("row", "toxic")).alias("marks"))
    least = blocks.select("block", "words", "pairs", "rows").mapInArrow(_words_to_count, "block long, words binary, pairs binary")
    met = least.join(_shuffled(marks), "block").select("words", "pairs", "marks")
    counted = met.mapInArrow(_count_words_of_blocks, "word string, t long, o long")
    return counted.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def block_features(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """For each row of the blocks: `doc_id, h`, the strongest evidence of a word (f1), the
    logarithm of 1 + the sum of that over `STRONG` (f2), the strongest of a word's characters
    (f3), and the characters' mean over the words (f4); all 0 without words."""
    told, shards, known = _answered(blocks, counts)
    told = told.select("words", "pairs", "rows", "answers")
    return cut_lineage(told.mapInArrow(_features(shards, known), f"doc_id long, h long, {', '.join(f'{c} double' for c in NAMES)}"))


# ------------------------------------------------------------------ scores

def fit_curve(features: np.ndarray, toxic: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - toxic) + ridge * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def marked_rows(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """`block, row, doc_id, h, toxic` of the labelled rows whose crc32(doc_id) mod 3 is not 1.
    Rows without an id, text or label are left out. A document labelled twice with
    different labels counts as toxic."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = blocks.select("block", "rows").mapInArrow(_unpack_rows, "block long, row int, doc_id long, h long")
    # Both sides grow with the corpus, so neither is ever broadcast.
    return cut_lineage(rows.filter(~fold(F.col("doc_id"), 3).isin(1, -1)).join(known.hint("merge"), "doc_id"))


def _hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, h, score` for each row of `docs`: its id, the hash of its text, and the score
    in 0 to 1. Documents whose crc32(doc_id) mod 7 is 0 are left out of the counts and fit the
    curve. Without rows of both classes there is no curve and every text scores 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("h"), "text")
    blocks = text_blocks(docs)
    labelled = marked_rows(blocks, labels)
    left_out = fold(F.col("doc_id"), 7) == 0
    chosen = labelled.filter(left_out)
    chosen = bounded_sample(chosen, CALIBRATION_ROWS, chosen.count(), 1, "doc_id", "h")
    chosen = cut_lineage(chosen.select("h", F.col("toxic").cast("int").alias("toxic")))
    if chosen.select("toxic").distinct().count() < 2:
        return docs.select("doc_id", "h", F.lit(0.0).alias("score"))
    features = block_features(blocks, cut_lineage(block_word_counts(blocks, labelled.filter(~left_out))))
    once = features.join(chosen.select("h").distinct(), "h", "left_semi").groupBy("h").agg(*[F.first(c).alias(c) for c in NAMES])
    rows = chosen.join(once, "h").select("toxic", *NAMES).toArrow()
    x = np.column_stack([np.ones(rows.num_rows), *[np.asarray(rows[c]) for c in NAMES]])
    curve = fit_curve(x, np.asarray(rows["toxic"]).astype(float)).tolist()
    z = sum((F.col(c) * w for c, w in zip(NAMES, curve[1:])), F.lit(curve[0]))
    return features.select("doc_id", "h", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row of `docs` (`doc_id, text`; other
    columns don't count). Null and empty texts score alike, as texts without words; long texts
    count whole; repeated rows score alike, each in a row of its own."""
    return scores(docs, labels).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted toxic; all columns as they are."""
    h = unused(docs, "_h")
    toxic = cut_lineage(scores(docs, labels).filter(F.col("score") >= CUT).select(F.col("h").alias(h)).distinct())
    return docs.withColumn(h, _hash()).join(toxic, h, "left_anti").select(*[f"`{c}`" for c in docs.columns])
