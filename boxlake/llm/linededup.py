"""Near-equal lines by a segment-partition edit join.

A line of n characters is cut into `threshold + 1` segments. A line within `threshold`
edits of it holds one of them unchanged, at a place the length difference bounds. So every
line enters its segments, and for each length down to `threshold` shorter the substrings
that can match a segment of such a line (multi-match-aware windows), under a hash of
length, number and text. Lines that meet are verified by a banded bit-parallel edit
distance. Keys that many lines share are refined: what is left of the lines without the
shared segment is partitioned again, until few lines share a key.

Only DataFrame functions are used. All texts stay in place until the lines that met
somewhere are known; keys and counts travel as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import WORD, let, unused
from boxlake.session import cut_lineage

THRESHOLD = 1
# Shorter lines are repeats only of equal ones: few edits make other words of them.
MIN_CHARS = 24
# Meeting lines under one key beyond which the key is refined.
CROWD = 40


def row_key(text: str | Column = "text") -> Column:
    """Tells rows of one id by their texts."""
    return F.xxhash64(text)


def lines(docs: DataFrame) -> DataFrame:
    """`doc_id, row, line_no, line`: the lines that take part, those with a word."""
    text = F.coalesce("text", F.lit(""))
    listed = F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    return docs.select("doc_id", row_key().alias("row"), listed).filter(F.col("line").rlike(WORD))


# ------------------------------------------------------------------ keys

def _segment(n: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment `i` of a line of `n` characters: all about as
    long, the longer ones last."""
    parts = threshold + 1
    short = parts - n % parts  # number of short segments
    base = F.floor(n / parts).cast("int")
    return base * i + F.greatest(F.lit(i) - short, F.lit(0)), base + (F.lit(i) >= short).cast("int")


def entries(line: Column, size: Column, base: Column, threshold: int) -> list[tuple[int, Column, Column, Column, int]]:
    """All entries of a line of `size` characters: role, key, the line without the segment,
    what the segment's owner has left, and `gap`. Role 1 are its own segments, which also meet those
    of equally long lines; role 0 the substrings that may be segments of other lines, of
    `gap` characters fewer. A key is null where the entry doesn't exist."""
    out = []
    for gap in range(threshold + 1):
        n = size - gap
        for i in range(threshold + 1):
            first, length = _segment(n, i, threshold)
            for shift in range(max(-i, gap - (threshold - i)), min(i, gap + (threshold - i)) + 1):
                start = first + shift
                key = F.xxhash64(base, n, F.lit(i), F.substring(line, start + 1, length))
                fits = (n > threshold) & (start >= 0) & (start + length <= size)
                rest = F.concat(F.substring(line, F.lit(1), start), F.substring(line, start + length + 1, size))
                out.append((int(gap == 0 and shift == 0), F.when(fits, key), rest, n - length, gap))
    return out


def _level_entries(rows: DataFrame, base: Column, threshold: int, *columns: str) -> DataFrame:
    """`columns, key, role, rest, left` of the entries of `rest`."""
    sized = rows.withColumn("_size", F.length("rest"))
    found = [
        F.struct(key.alias("key"), F.lit(role).alias("role"), rest.alias("rest"), left.alias("left"))
        for role, key, rest, left, _ in entries(F.col("rest"), F.col("_size"), base, threshold)
    ]
    listed = sized.select(*columns, F.explode(F.array(*found)).alias("_e")).filter("_e.key is not null")
    return listed.select(*columns, "_e.*")


# ------------------------------------------------------------------ verification

def _strip_common(pair: Column, front: bool) -> Column:
    """`pair` (x, y) without their common start, or end: halving steps from the largest
    power of two."""

    def cut(acc: Column, width: Column) -> Column:
        x, y = acc["x"], acc["y"]
        nx, ny = F.length(x), F.length(y)
        if front:
            same = F.substring(x, F.lit(1), width) == F.substring(y, F.lit(1), width)
            rest = [F.substring(s, width + 1, n).alias(a) for s, n, a in ((x, nx, "x"), (y, ny, "y"))]
        else:
            same = F.substring(x, nx - width + 1, width) == F.substring(y, ny - width + 1, width)
            rest = [F.substring(s, F.lit(1), n - width).alias(a) for s, n, a in ((x, nx, "x"), (y, ny, "y"))]
        return F.when((nx >= width) & (ny >= width) & same, F.struct(*rest)).otherwise(acc)

    # The steps 2^30 ... 1 twice each, for what is left after the first descent.
    steps = F.transform(F.sequence(F.lit(30), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    longest = F.greatest(F.length(pair["x"]), F.length(pair["y"]))
    return F.aggregate(F.filter(steps, lambda w: w <= longest), pair, cut)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most `threshold`.

    Of what is left without common start and end, bit d of level e says that the prefixes
    of lengths i and i + d - threshold are e edits apart or fewer; one step of i moves the
    whole band of 2 * threshold + 1 diagonals by shifts and masks."""
    band = (1 << (2 * threshold + 1)) - 1
    middle = 1 << threshold

    def named(levels: list[Column]) -> Column:
        return F.struct(*[v.cast("long").alias(f"r{e}") for e, v in enumerate(levels)])

    def run(p: Column) -> Column:
        xs, ys = (F.filter(F.split(p[s], ""), lambda c: c != "") for s in "xy")
        first = []
        for e in range(threshold + 1):
            first.append(F.lit(sum(middle << k for k in range(e + 1)) & band))

        def over(both: Column) -> Column:
            x, y = both["xs"], both["ys"]

            def step(acc: Column, i: Column) -> Column:
                equal = F.lit(0).cast("long")
                for d in range(-threshold, threshold + 1):
                    place = i + d
                    hit = (place >= 1) & (place <= F.size(y)) & (F.get(x, i - 1) == F.get(y, place - 1))
                    equal = equal + F.when(hit, F.lit(1 << (d + threshold))).otherwise(F.lit(0)).cast("long")

                def moved(mask: Column) -> Column:
                    levels = []
                    for e in range(threshold + 1):
                        now = acc[f"r{e}"].bitwiseAND(mask)
                        if e:
                            before = acc[f"r{e - 1}"]
                            now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
                        levels.append(now)
                    for e in range(1, threshold + 1):
                        levels[e] = levels[e].bitwiseOR(F.shiftleft(levels[e - 1], 1)).bitwiseAND(F.lit(band).cast("long"))
                    return named(levels)

                return let(equal, moved)

            last = F.aggregate(F.sequence(F.lit(1), F.size(x)), named(first), step)
            bits = F.array(*[F.lit(1 << k).cast("long") for k in range(2 * threshold + 1)])
            return last[f"r{threshold}"].bitwiseAND(F.get(bits, F.size(y) - F.size(x) + threshold)) != 0

        return (
            F.when(F.size(xs) == 0, F.size(ys) <= threshold)
            .when(F.size(ys) == 0, F.size(xs) <= threshold)
            .otherwise(let(F.struct(xs.alias("xs"), ys.alias("ys")), over))
        )

    start = F.struct(a.alias("x"), b.alias("y"))
    stripped = let(let(start, lambda p: _strip_common(p, True)), lambda p: _strip_common(p, False))
    near = F.abs(F.length(a) - F.length(b)) <= threshold
    return near & let(stripped, lambda p: F.when(F.abs(F.length(p["x"]) - F.length(p["y"])) <= threshold, run(p)).otherwise(F.lit(False)))


# ------------------------------------------------------------------ join

def _shuffled(df: DataFrame) -> DataFrame:
    """For a side that grows with the corpus: joined by shuffle at any size."""
    return df.hint("merge")


def _meetings(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Rows (`key, h, role, ...`) whose key another line shares: those of few lines, and
    those of crowded keys."""
    counts = rows.groupBy("key").agg(
        F.min("h").alias("_lo"), F.max("h").alias("_hi"), F.max("role").alias("_own"), F.count(F.lit(1)).alias("_n")
    )
    shared = counts.filter("_lo < _hi and _own = 1").select("key", "_n")
    met = cut_lineage(rows.join(_shuffled(shared), "key"))
    return met.filter(F.col("_n") <= crowd).drop("_n"), met.filter(F.col("_n") > crowd).drop("_n")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different lines that meet: an own segment with any entry."""
    own = rows.filter("role = 1").select("key", F.col("h").alias("a"))
    other = rows.select("key", F.col("h").alias("b"), "role")
    met = own.join(other, "key").filter("a <> b and (role = 0 or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(found: DataFrame, keyed: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """`a, b`: hashes of different lines at most `threshold` edits apart. `found` has the
    lines' occurrences (`h, line`), `keyed` the entries of each different line (`h, key,
    role`)."""
    few, many = _meetings(keyed, crowd)
    met = few.select("h").union(many.select("h")).distinct()
    texts = found.select("h", "line").join(_shuffled(met), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = cut_lineage(texts)
    pairs = _pairs(few)
    level = many
    first = True
    while level.limit(1).count():
        if first:  # the rests of the lines' crowded entries
            lines_of = texts.select("h", F.col("line").alias("rest"))
            again = _level_entries(lines_of, F.lit(0).cast("long"), threshold, "h")
            level = again.join(level.select("h", "key", "role").distinct(), ["h", "key", "role"])
            first = False
        # `left`, what is left of the owner of the segment, is the same under one key. A
        # role goes on: other lines' substrings stay probes, own segments stay both.
        pairs = pairs.unionByName(_pairs(level.filter(F.col("left") <= 2 * threshold)))
        longer = level.filter(F.col("left") > 2 * threshold).select(
            "h", F.col("role").alias("_role"), F.col("key").alias("_key"), "rest"
        )
        finer = _level_entries(longer, F.col("_key"), threshold, "h", "_role")
        finer = finer.select("h", "key", F.least("role", "_role").alias("role"), "rest", "left").distinct()
        few, level = _meetings(finer, crowd)
        pairs = pairs.unionByName(_pairs(few))
    for side in "ab":
        pairs = pairs.join(_shuffled(texts.select(F.col("h").alias(side), F.col("line").alias(f"t{side}"))), side)
    return pairs.filter(within(F.col("ta"), F.col("tb"), threshold)).select("a", "b").distinct()


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """`doc_id, row, line_no, repeated, links` of each line with a word. A line is repeated if
    a line before it (in the order of doc_id, row, line_no; a null id comes first) is the same
    or, both having `min_chars` or more, within `threshold` edits, whether that one is repeated
    or not. `links` counts the different lines within reach. `row` is a hash of the text: rows
    of one id and different texts are told apart, exact copies of a row are not."""
    found = lines(docs).withColumn("h", F.xxhash64("line"))
    at = F.struct("doc_id", "row", "line_no")
    kept = found.withColumn("_size", F.length("line"))
    own = entries(F.col("line"), F.col("_size"), F.lit(0).cast("long"), threshold)
    # Equal lines have equal entries, so any of them stands for all.
    names = [f"k{i}" for i in range(len(own))]
    keys = [F.when(F.col("_size") - gap >= min_chars, key).alias(n) for n, (_, key, _, _, gap) in zip(names, own)]
    distinct = kept.select("h", at.alias("at"), *keys)
    distinct = cut_lineage(distinct.groupBy("h").agg(F.min("at").alias("at"), *[F.max(n).alias(n) for n in names]))
    listed = F.array(*[F.struct(F.col(n).alias("key"), F.lit(e[0]).alias("role")) for n, e in zip(names, own)])
    keyed = distinct.select("h", F.inline(listed)).filter("key is not null")
    pairs = cut_lineage(near_pairs(found, keyed, threshold, crowd))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = distinct.select("h", "at")
    near = both.join(_shuffled(firsts.select(F.col("h").alias("b"), "at")), "b").groupBy(F.col("a").alias("h"))
    near = near.agg(F.min("at").alias("near_at"), F.count(F.lit(1)).alias("links"))
    known = firsts.join(_shuffled(near), "h", "left").select(
        "h", F.least("at", "near_at").alias("first_at"), F.coalesce("links", F.lit(0)).alias("links")
    )
    placed = found.select("h", "doc_id", "row", "line_no").join(_shuffled(known), "h")
    return placed.select("doc_id", "row", "line_no", (F.col("first_at") < at).alias("repeated"), "links")


def line_decisions(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of `docs` with lines that take part: `doc_id, row, n_lines,
    n_links, n_removed, removed` (numbers of the repeated lines from 0, ascending). Exact
    copies of a row, id and text, are one row here, and their lines and links add up."""
    out = repeated_lines(docs, **options).groupBy("doc_id", "row").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("links").alias("n_links"),
        F.sort_array(F.collect_set(F.when(F.col("repeated"), F.col("line_no")))).alias("removed"),
    )
    return out.withColumn("n_removed", F.size("removed").cast("long"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the repeated lines taken out of `text`, whatever share of it they are; all
    other columns and rows stay as they are (n_chars, if there, follows the text). A document
    that loses all of its lines stays as a row with an empty text; blank lines stay."""
    doc, row, gone = unused(docs, "_doc"), unused(docs, "_row"), unused(docs, "_gone")
    chosen = line_decisions(docs, **options).filter("n_removed > 0")
    chosen = chosen.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("removed").alias(gone))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (row_key() == F.col(row))
    joined = docs.join(_shuffled(chosen), same, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select([f"`{c}`" for c in docs.columns])
