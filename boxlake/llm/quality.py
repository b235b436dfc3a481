"""Quality rules: text statistics, and a decision list learned from labelled documents.

Sequential covering in the manner of IREP: a rule for low quality grows by the condition
`feature >= cut` or `feature < cut` with the best gain on two thirds of the labelled rows,
is pruned on the other third, and the rows it covers are left out for the next rule. The
list becomes one ordered conditional expression. Only DataFrame functions are used; a
condition costs one aggregation to a row for each feature and cut.

The list is learned from a bounded sample of the labelled rows (`TRAINING_ROWS`, in hash
order); the statistics are those of the whole texts of all documents.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import WORD, bounded_sample, let, words
from boxlake.session import cut_lineage

SYMBOLS = r"[#*$%&|<>]"
RUN = 5
TRAINING_ROWS = 20_000
CUTS = 48
MAX_RULES = 8
MAX_CONDITIONS = 3
# Rules below this precision on the pruning rows aren't used: doubtful documents stay.
MIN_PRECISION = 0.9
MIN_COVERED = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


# ------------------------------------------------------------------ statistics

def repeated_words(w: Column, run: int = RUN) -> Column:
    """Words of `w` (an array that is already there, not an expression) in windows of `run`
    words that occur twice or more in it. Windows are compared by 64-bit hashes."""

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(run)])

    def places(pairs: Column) -> Column:
        """First words of the repeated windows, ascending, from (hash, place) in order."""

        def repeated(p: Column, j: Column) -> Column:
            again = (p["h"] == F.get(pairs, j - 1)["h"]) | (p["h"] == F.get(pairs, j + 1)["h"])
            return F.when(again, p["i"])

        return F.array_sort(F.filter(F.transform(pairs, repeated), lambda i: i.isNotNull()))

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

        def add(acc: Column, i: Column) -> Column:
            more = i + run - F.greatest(i, acc["end"])
            return F.struct((acc["n"] + more).alias("n"), (i + run).alias("end"))

        return F.aggregate(found, start, add)["n"]

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = let(pairs, lambda p: let(places(p), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - run), hashed)
    return F.when(F.size(w) > run, let(windows, count)).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` with `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words` (long) and
    the learner's shares. Null and empty texts have zeros."""
    text = F.coalesce("text", F.lit(""))
    held = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    counted = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")),
    )
    lines = let(held, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    out = docs.withColumns({
        "_w": counted,
        "_l": lines,
        "word_chars": F.length(F.translate(text, " \t\n\v\f\r", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "_caps": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "_marks": F.regexp_count(text, F.lit(r"[!?]")),
        "_digits": F.regexp_count(text, F.lit(r"[0-9]")),
    })
    out = out.withColumns({
        "n_words": F.col("_w.n"),
        "n_repeat_words": F.col("_w.r"),
        "n_dup_lines": F.col("_l.d").cast("long"),
        "_lines": F.col("_l.n"),
    })
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    shares = {
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": F.col("word_chars") / n,
        "f_symbols": F.col("n_symbols") / n,
        "f_repeats": F.col("n_repeat_words") / n,
        "f_dup_lines": F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)),
        "f_capitals": F.col("_caps") / chars,
        "f_marks": F.col("_marks") / n,
        "f_digits": F.col("_digits") / chars,
    }
    return out.withColumns(shares).drop("_w", "_l", "_caps", "_marks", "_digits", "_lines")


FEATURES = ["f_words", "f_word_length", "f_symbols", "f_repeats", "f_dup_lines", "f_capitals", "f_marks", "f_digits"]

Condition = tuple[str, str, float]  # feature, ">=" or "<", cut
Rule = list[Condition]


# ------------------------------------------------------------------ learning

def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, sign, cut in rule:
        out = out & ((F.col(feature) >= cut) if sign == ">=" else (F.col(feature) < cut))
    return out


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= value))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Conditions one by one, by the best gain (FOIL), until no good row is covered."""
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS:
        binned = rows.filter(holds(rule)).select("bad", F.posexplode("bins").alias("f", "bin"))
        table = binned.groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        p0 = sum(r.p for r in table if r.f == 0)
        n0 = sum(r.n for r in table if r.f == 0)
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for f, feature in enumerate(FEATURES):
            own = [r for r in table if r.f == f]
            for b, cut in enumerate(cuts[feature]):
                for sign in (">=", "<"):
                    inside = [r for r in own if (r.bin > b) == (sign == ">=")]
                    p, n = sum(r.p for r in inside), sum(r.n for r in inside)
                    if p < MIN_COVERED or (p, n) == (p0, n0):
                        continue
                    gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, (feature, sign, cut)
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float]:
    """The beginning of the rule with the best balance on other rows, and its precision."""
    sums = []
    for i in range(1, len(rule) + 1):
        inside = holds(rule[:i])
        sums += [F.sum(F.when(inside, F.col("bad")).otherwise(0)).alias(f"p{i}"), F.count_if(inside).alias(f"c{i}")]
    row = rows.agg(*sums).first()
    best, kept = (-2.0, 0.0), rule
    for i in range(1, len(rule) + 1):
        p, covered = row[f"p{i}"] or 0, row[f"c{i}"]
        if covered:
            value = (2 * p - covered) / covered
            if value > best[0] + 1e-9:
                best, kept = (value, p / covered), rule[:i]
    return kept, best[1]


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for `bad` = 1 from rows with `bad`, an `id` and the features. An empty list if
    there is nothing to learn from."""
    labelled = cut_lineage(labelled.select("id", "bad", *FEATURES))
    chosen = cut_lineage(bounded_sample(labelled, TRAINING_ROWS, labelled.count(), 3, "id", *FEATURES))
    points = [i / CUTS for i in range(1, CUTS)]
    quantiles = chosen.agg(*[F.percentile(f, F.array(*map(F.lit, points))).alias(f) for f in FEATURES]).first()
    if quantiles[FEATURES[0]] is None:
        return []
    cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}
    bins = [_bin(F.col(f), cuts[f]) for f in FEATURES]
    rows = cut_lineage(chosen.select("id", "bad", *FEATURES, F.array(*bins).alias("bins")))
    pruning = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(3)) == 0
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule = _grow(left.filter(~pruning), cuts)
        if not rule:
            break
        rule, precision = _prune(left.filter(pruning), rule)
        if precision < MIN_PRECISION:
            break
        rules.append(rule)
        left = left.filter(~holds(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false by the first rule that holds."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(holds(rule), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, the statistics, `base_failed` and `kept` for each row of `docs` (`doc_id,
    text`). Labels without an id or quality aren't used; a document labelled twice counts as
    low if any label says so. Repeated rows are judged alike."""
    stats = cut_lineage(statistics(docs.select("doc_id", "text")).drop("text"))
    known = labels.filter("quality is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").alias("id")).agg((1 - F.min("quality")).cast("int").alias("bad"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The list follows the base rules, so it is learned from what they let pass.
    labelled = stats.filter(~base).join(known.hint("merge"), F.col("doc_id") == F.col("id")).dropDuplicates(["id"])
    return stats.select(
        "doc_id", *COUNTS, base.alias("base_failed"), (~base & verdict(learn(labelled))).alias("kept")
    )
