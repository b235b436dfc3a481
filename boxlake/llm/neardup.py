"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is its distinct word shingles. Equal sets become one class first. Signatures
of `HASHES` minima are cut into bands; classes that share a band are candidates. A
candidate pair is compared batch by batch of its signatures and given up as soon as the
posterior probability of a similarity of `percent` or more, under a uniform prior, falls
below `MISS`; survivors are confirmed on the full sets.

Pairs within a group of copies aren't all needed: first each class of a band is compared
with one chosen lead of that band (`LEAD_ROUNDS` times, with other leads) and linked
classes grow together. Then what isn't joined yet is compared with all it shares a band
with, in crowded bands by way of the band's centre (`_around_centres`), so that no link
between components is lost (but for what the bands miss: (1 - s^4)^32, or 5e-8 at
s = 0.8, and as little by long keys).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.common import BASE, mix, slices, small_batches, window_hashes, word_hashes
from boxlake.operators.clusters import connected_components
from boxlake.session import cut_lineage

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
BATCH = 32
MISS = 1e-7
LEAD_ROUNDS = 1
# In bands of more classes than this, classes meet by what the centre lacks or in long keys.
CROWD = 16
# Pairs for each class around a centre above which its classes meet in long keys.
MANY = 32
# Texts whose long keys a task holds at once.
LONG_TEXTS = 500
# Pairs for each row of the open bands up to which all are compared at once.
FEW = 8


# ------------------------------------------------------------------ sets and signatures

def shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words has its whole
    sequence as the only one; one without words has none."""
    h, _, _, per_row = word_hashes(pc.ascii_lower(column))
    windows = window_hashes(h, size)
    start = 0
    for n in per_row.tolist():
        if n >= size:
            yield np.unique(windows[start : start + n - size + 1])
        elif n:
            yield window_hashes(h[start : start + n], n, seed=n)
        else:
            yield np.zeros(0, np.uint64)
        start += n


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the `HASHES` minima of the (non-empty) sets, one row each."""
    rng = np.random.RandomState(20_011)
    factors = rng.randint(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), HASHES), dtype=np.uint16)
    buffer = np.empty_like(joined)
    for k in range(HASHES):
        np.multiply(joined, factors[k], out=buffer)
        buffer ^= buffer >> np.uint64(29)
        buffer *= factors[HASHES - 1 - k]
        out[:, k] = (mix(np.minimum.reduceat(buffer, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _sketch(size: int):
    def sketch(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = list(shingles(batch.column("text"), size))
            n = np.array([len(s) for s in sets])
            filled = [s for s in sets if len(s)]
            signature: list[bytes | None] = [None] * len(sets)
            keys = np.zeros((2, len(sets)), dtype=np.int64)
            if filled:
                starts = np.cumsum([0, *[len(s) for s in filled[:-1]]])
                joined = np.concatenate(filled)
                keys[0, n > 0] = np.add.reduceat(mix(joined.copy()), starts).view(np.int64)
                keys[1, n > 0] = np.bitwise_xor.reduceat(joined * np.uint64(0x9FB21C651E98DF25), starts).view(np.int64)
                for i, row in zip(np.flatnonzero(n), _minima(filled)):
                    signature[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *map(pa.array, keys), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "set1", "set2", "signature"],
            )

    return sketch


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """`doc_id, n_shingles, set1, set2, signature` of each row; the sums `set1, set2` and
    `n_shingles` name the set, the signature of an empty set is null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _sketch(size), "doc_id long, n_shingles long, set1 long, set2 long, signature binary"
    )


def band_keys(signature: Column) -> Column:
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.substring(signature, 1 + width * i, width), F.lit(i)) for i in range(BANDS)])


# ------------------------------------------------------------------ verification

def least_matches(share: float) -> list[int]:
    """For each number of compared batches: the fewest equal minima with which the
    posterior probability of a similarity of `share` or more is still `MISS`."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:  # P(J >= share | m of n) = P(Binomial(n + 1, share) <= m)
            total += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append(m)
    return out


def _promising(share: float):
    least = least_matches(share)

    def promising(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb")]
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, dtype=np.int64)
            for i, m in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (sides[0][alive, part] == sides[1][alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            kept = batch.select(["a", "b"]).take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches[alive])], ["a", "b", "matches"])

    return promising


def promising_pairs(pairs: DataFrame, signatures: DataFrame, share: float) -> DataFrame:
    """`a, b, matches` of the pairs that survive the sequential comparison."""
    for side in "ab":
        pairs = pairs.join(signatures.select(F.col("doc_id").alias(side), F.col("signature").alias(f"s{side}")), side)
    return pairs.mapInArrow(_promising(share), "a long, b long, matches long")


def _confirmed(size: int, percent: int):
    def confirmed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.add(pc.binary_length(batch.column("ta")), pc.binary_length(batch.column("tb"))).to_pylist()
            for part in slices(lengths):
                piece = batch.slice(part.start, part.stop - part.start)
                good = []
                for i, (x, y) in enumerate(zip(shingles(piece.column("ta"), size), shingles(piece.column("tb"), size))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append(i)
                yield piece.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return confirmed


def confirmed_pairs(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), side)
    return pairs.select("a", "b", "ta", "tb").mapInArrow(_confirmed(size, percent), "a long, b long")


# ------------------------------------------------------------------ groups

def _open(bands: DataFrame) -> DataFrame:
    """`key, n` of the bands that hold more than one group, with their number of classes."""
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("_lo"), F.max("grp").alias("_hi"))
    return sizes.filter("_lo < _hi").select("key", "n")


def _met(bands: DataFrame, keys: DataFrame) -> DataFrame:
    """`key, doc_id, grp` of the bands in `keys`."""
    return bands.join(keys.select("key"), "key", "left_semi").select("key", "doc_id", "grp")


def _grouped(bands: DataFrame, links: DataFrame | None) -> DataFrame:
    """`bands` with the groups that `links` make."""
    if links is None:
        return bands
    groups = connected_components(links, []).select(F.col("node").alias("doc_id"), F.col("root").alias("_grp"))
    return bands.join(groups, "doc_id", "left").select("key", "doc_id", F.coalesce("_grp", "doc_id").alias("grp"))


def _with_groups(bands: DataFrame, links: DataFrame | None) -> DataFrame:
    """`key, doc_id, grp`, left to bands that hold more than one group."""
    bands = _grouped(bands, links)
    return _met(bands, _open(bands))


def _lead_pairs(bands: DataFrame, turn: int, apart: bool = True) -> DataFrame:
    """Each class of a band with the band's lead. At first that is the class with the most
    neighbours over all its bands: an original among edited copies is near to all of them
    while they may be far from each other. Then the smallest id, then others."""
    ranked = bands
    if turn == 0:
        sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        met = bands.join(sizes, "key").groupBy("doc_id").agg((-F.sum("_n")).alias("o"))
        ranked = bands.join(met, "doc_id")
    else:
        ranked = bands.withColumn("o", F.lit(0) if turn == 1 else F.xxhash64("doc_id", F.lit(turn)))
    leads = ranked.groupBy("key").agg(F.min(F.struct("o", "doc_id", "grp")).alias("lead"))
    met = bands.join(leads.select("key", F.col("lead.doc_id").alias("b"), F.col("lead.grp").alias("_g")), "key")
    met = met.filter("grp <> _g" if apart else "doc_id <> b")
    return met.select(F.col("doc_id").alias("a"), "b").distinct()


def _all_pairs(bands: DataFrame) -> DataFrame:
    """Every pair of classes of different groups that share a band."""
    left, right = (bands.select("key", F.col("doc_id").alias(s), F.col("grp").alias(f"g{s}")) for s in "ab")
    return left.join(right, "key").filter("a < b and ga <> gb").select("a", "b").distinct()


def _residues(size: int, percent: int):
    """For pairs with texts: whether they are linked, what `a` has beyond `b`, and the sizes
    of sets that could be linked with `a` without sharing any of that."""

    def residues(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.add(pc.binary_length(batch.column("ta")), pc.binary_length(batch.column("tb"))).to_pylist()
            for part in slices(lengths):
                piece = batch.slice(part.start, part.stop - part.start)
                out = []
                for x, y in zip(shingles(piece.column("ta"), size), shingles(piece.column("tb"), size)):
                    own = np.setdiff1d(x, y, assume_unique=True)
                    common = len(x) - len(own)
                    linked = (100 + percent) * common >= percent * (len(x) + len(y))
                    low = -(-percent * len(x) // 100)
                    high = -1 if linked else (100 + percent) * common // percent - len(x)
                    out.append((len(x), linked, low, high, own.view(np.int64)))
                n, linked, low, high, own = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*piece.select(["a", "b"]).columns, *map(pa.array, (n, linked, low, high)), pa.array(own, pa.list_(pa.int64()))],
                    ["a", "b", "n", "linked", "low", "high", "own"],
                )

    return residues


def _long_shape(share: float) -> tuple[int, int]:
    """How many minima a long key has, so that a link shares one with a probability of about
    1 / 35, and how many keys let a link go unmet no more often than the bands do."""
    rows = max(ROWS, round(log(1 / 35) / log(min(share, 0.99))))
    return rows, ceil(log((1 - share**ROWS) ** BANDS) / log1p(-(share**rows))) if share < 1 else 1


def _long_keys(size: int, share: float):
    """For each row: the long keys of its text's set, one row each. They are told apart by
    minima of their own, other than those of the signature."""
    rows, bands = _long_shape(share)
    factors = np.random.RandomState(20_012).randint(0, 1 << 31, (bands, rows)).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def keys(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for start in range(0, batch.num_rows, LONG_TEXTS):
                piece = batch.slice(start, LONG_TEXTS)
                sets = list(shingles(piece.column("text"), size))
                at = np.flatnonzero([len(s) for s in sets])
                if not len(at):
                    continue
                joined = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
                starts = np.cumsum([0, *[len(sets[i]) for i in at[:-1]]])
                out = np.zeros((bands, len(at)), dtype=np.uint64)
                buffer = np.empty_like(joined)
                for i in range(bands):
                    out[i] = i
                    for factor in factors[i]:
                        np.multiply(joined, factor, out=buffer)
                        out[i] = out[i] * BASE + np.minimum.reduceat(buffer, starts)
                    mix(out[i])
                named = piece.select(["doc_id", "grp"]).take(pa.array(np.tile(at, bands)))
                yield pa.RecordBatch.from_arrays([*named.columns, pa.array(out.ravel().view(np.int64))], ["doc_id", "grp", "key"])

    return keys


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """`doc_id, grp` with the groups that `links` join as one."""
    for side in "ab":
        links = links.join(groups.select(F.col("doc_id").alias(side), F.col("grp").alias(f"g{side}")), side)
    joined = connected_components(links.select(F.col("ga").alias("a"), F.col("gb").alias("b")), [])
    groups = groups.join(joined.select(F.col("node").alias("grp"), "root"), "grp", "left")
    return groups.select("doc_id", F.coalesce("root", "grp").alias("grp"))


def _around_centres(bands: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links with the centres of crowded bands, and the pairs of their other classes that may
    be linked. Groups joined by links with the centres are joined first. Classes of different
    groups left around a centre meet in one of two ways, by the centre:

    Sharing only what the centre has, x and y have at most |x & centre| in common, which must
    reach s / (1 + s) (|x| + |y|), at least s |x|. So they share s |x| - |x & centre| elements
    beyond the centre, or the other's size lies in the range that needs none. The former meet
    in the rarest of x's elements beyond the centre, all but that many less one. This spares
    the pairs of copies that are near to the centre.

    Where many classes have the same beyond the centre, that would make nearly all pairs. The
    classes of such a centre meet in long keys instead, of so many minima that pairs
    well below a link seldom share one, and of so many of these that a link is lost no more
    often than by the bands."""
    centres = _lead_pairs(bands, 0, apart=False)
    for side in "ab":
        centres = centres.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), side)
    found = cut_lineage(centres.select("a", "b", "ta", "tb").mapInArrow(
        _residues(size, percent), "a long, b long, n long, linked boolean, low long, high long, own array<bigint>"
    ))
    linked = found.filter("linked").select("a", "b")
    groups = _merged(cut_lineage(bands.select("doc_id", "grp").distinct()), linked)
    found = found.join(groups.withColumnRenamed("doc_id", "a"), "a")
    around = found.groupBy("b").agg(
        F.count(F.lit(1)).alias("rows"), F.min("grp").alias("g1"), F.max("grp").alias("g2")
    )
    around = cut_lineage(around.filter("g1 < g2").select("b", "rows"))
    found = cut_lineage(found.join(around.select("b"), "b"))

    beyond = F.greatest(F.lit(1), F.col("low") - (F.col("n") - F.size("own")))
    # lists are as long as sets, so they are dealt evenly before they become rows
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = found.repartition(tasks, "a", "b").select("a", "b", "grp", (F.size("own") - beyond + 1).alias("rarest"), F.size("own").alias("all"), F.explode("own").alias("s"))
    often = met.groupBy("b", "s").agg(F.count(F.lit(1)).alias("df"), F.min("grp").alias("g1"), F.max("grp").alias("g2"))
    met = met.filter("rarest > 0").join(often.filter("df > 1"), ["b", "s"])
    # elements of one class only are the rarest, and lead nowhere
    mine = Window.partitionBy("a", "b")
    alone = F.col("all") - F.count(F.lit(1)).over(mine)
    met = met.withColumns({"alone": alone, "place": F.row_number().over(mine.orderBy("df", "s"))})
    met = cut_lineage(met.filter("place + alone <= rarest and g1 < g2").select("b", "s", "a", "grp"))
    long_ = _by_long_keys(around, met)
    met = met.join(long_, "b", "left_anti")
    left, right = (met.select("b", "s", F.col("a").alias(n), F.col("grp").alias(f"g{n}")) for n in ("x", "y"))
    pairs = left.join(right, ["b", "s"]).filter("x < y and gx <> gy").select("x", "y")
    near = found.join(long_, "b", "left_anti")
    open_ = near.filter("not linked and high >= low")
    sized = open_.select("b", F.explode(F.sequence("low", "high")).alias("n"), F.col("a").alias("x"), F.col("grp").alias("gx"))
    others = near.select("b", "n", F.col("a").alias("y"), F.col("grp").alias("gy"))
    small = sized.join(others, ["b", "n"]).filter("x <> y and gx <> gy")
    pairs = pairs.union(small.select(F.least("x", "y"), F.greatest("x", "y"))).toDF("a", "b")

    far = found.join(long_, "b", "left_semi").select(F.col("a").alias("doc_id"), "grp").distinct()
    keyed = texts.join(far, "doc_id").select("doc_id", "grp", "text")
    keyed = cut_lineage(keyed.mapInArrow(_long_keys(size, percent / 100), "doc_id long, grp long, key long"))
    return linked, pairs.unionByName(_all_pairs(cut_lineage(_with_groups(keyed, None)))).distinct()


def _by_long_keys(around: DataFrame, met: DataFrame) -> DataFrame:
    """The centres `b` around which the elements `met` would make more than `MANY` pairs for
    each class."""
    sizes = met.groupBy("b", "s", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("b", "s")
    sizes = sizes.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    pairs = sizes.groupBy("b").agg(F.sum("pairs").alias("pairs"))
    return cut_lineage(around.join(pairs, "b").filter(F.col("pairs") > MANY * F.col("rows")).select("b"))


def _few_pairs(keys: DataFrame) -> bool:
    """Whether the pairs of all open bands are no more than a few for each row, so that
    further leads would save nothing."""
    row = keys.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    return (row["pairs"] or 0) <= FEW * (row["rows"] or 0)


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for each row of `docs` (`doc_id, text`).

    Documents are linked if 100 * intersection >= percent * union of their sets;
    `component_id` is the smallest id reachable over links, `kept` marks that document.
    Null and empty texts have an empty set and are linked with nothing, like rows without
    an id (their component is null and they are kept). Rows that repeat an id must repeat
    its text; they come out once each. Letters A-Z count as lower case."""
    share = percent / 100
    known = cut_lineage(sketches(docs, size))
    usable = known.filter("signature is not null and doc_id is not null")
    named = ["n_shingles", "set1", "set2"]
    classes = cut_lineage(usable.groupBy(*named).agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = reps.select("doc_id", "signature").dropDuplicates(["doc_id"])

    keyed = reps.select("doc_id", F.explode(band_keys(F.col("signature"))).alias("key")).withColumn("grp", F.col("doc_id"))
    bands = cut_lineage(_with_groups(keyed, None))
    met = bands.select("doc_id").distinct()
    signatures = cut_lineage(reps.join(met, "doc_id", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(met, "doc_id", "left_semi")
    texts = cut_lineage(texts.dropDuplicates(["doc_id"]))

    links, open_ = None, cut_lineage(_open(bands))
    for turn in range(LEAD_ROUNDS + 1):
        last = turn == LEAD_ROUNDS or turn > 0 and _few_pairs(open_)
        pairs = None if last else _lead_pairs(bands, turn)
        if last:
            crowded = F.col("n") > CROWD
            central, pairs = _around_centres(_met(bands, open_.filter(crowded)), texts, size, percent)
            links = central if links is None else links.unionByName(central)
            pairs = pairs.unionByName(_all_pairs(_met(bands, open_.filter(~crowded)))).distinct()
        pairs = promising_pairs(pairs, signatures, share)
        if not last:  # one attempt each: the lead that looks most alike
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
        found = cut_lineage(confirmed_pairs(pairs, texts, size, percent))
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            if not last:
                bands = cut_lineage(_grouped(bands, links))
                open_ = cut_lineage(_open(bands))
        if last or not open_.limit(1).count():
            break

    members = classes
    if links is not None:
        roots = connected_components(links, []).select(F.col("node").alias("rep"), "root")
        members = classes.join(roots, "rep", "left").withColumn("rep", F.coalesce("root", "rep")).drop("root")
    out = known.drop("signature").join(members, named, "left")
    top = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("rep"))
    top = F.when(F.col("doc_id").isNotNull(), top)
    return out.select("doc_id", "n_shingles", top.alias("component_id"), F.coalesce(top == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group, that of the smallest id; a repeated row
    counts as a copy of itself and stays once. All columns stay as they are."""
    gone = components(docs, size, percent).filter(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti")
    return rest.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rest.filter("doc_id is null"))
