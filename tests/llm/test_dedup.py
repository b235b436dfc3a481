"""Near duplicates, repeated lines and repeated passages against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake.llm import linededup, neardup, substrings
from tests.llm.helpers import awkward, documents, rows


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, k, letters="abé"):
    text = list(text)
    for _ in range(k):
        at = rnd.randrange(len(text) + 1)
        kind = rnd.random()
        if kind < 0.4 and text:
            text[min(at, len(text) - 1)] = rnd.choice(letters)
        elif kind < 0.7:
            text.insert(at, rnd.choice(letters))
        elif text:
            del text[min(at, len(text) - 1)]
    return "".join(text)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_within_is_the_edit_distance(spark, threshold):
    rnd = random.Random(5)
    pairs = []
    for _ in range(150):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(14)))
        pairs.append((a, edited(rnd, a, rnd.randrange(5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = rows(df.withColumn("near", linededup.within(F.col("a"), F.col("b"), threshold)), "a", "b", "near")
    assert all(near == (edit_distance(a, b) <= threshold) for a, b, near in got)


@pytest.mark.parametrize("threshold, crowd", [(1, 40), (1, 2), (2, 3)])
def test_repeated_lines_match_all_pairs(spark, threshold, crowd):
    rnd = random.Random(threshold * 10 + crowd)
    base = ["".join(rnd.choice("abcde fg") for _ in range(rnd.randrange(6, 15))) for _ in range(12)]
    docs = [(i, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2])) for _ in range(4))) for i in range(20)]
    found = linededup.repeated_lines(
        spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold, min_chars=5, crowd=crowd
    )
    got = {(d, n): (r, k) for d, n, r, k in rows(found, "doc_id", "line_no", "repeated", "links")}
    lines = [(d, n, x) for d, t in docs for n, x in enumerate(t.split("\n")) if x.strip()]

    def near(x, y):
        return x == y or min(len(x), len(y)) >= 5 and edit_distance(x, y) <= threshold

    want = {
        (d, n): (
            any((e, m) < (d, n) and near(x, y) for e, m, y in lines),
            len({y for _, _, y in lines if y != x and near(x, y)}),
        )
        for d, n, x in lines
    }
    assert got == want


def test_line_dedup_keeps_rows_columns_and_copies(spark):
    same = "This boilerplate line is found everywhere.\n"
    texts = [same + "Own words of the first document, quite long, which stay."] * 2
    texts += [same + "Something altogether different from what stood before, and long."]
    docs = documents(spark, texts).withColumn("removed", F.lit("mine"))
    out = {r.doc_id: r for r in linededup.drop_repeated_lines(docs).collect()}
    assert out[0].text == texts[0]
    assert out[1].text == ""  # a copy as a whole
    assert out[2].text == texts[2].split("\n")[1]
    assert out[2].removed == "mine"
    table = awkward(spark)
    kept = linededup.drop_repeated_lines(table)
    assert kept.columns == table.columns and kept.count() == table.count()
    assert linededup.drop_repeated_lines(table.limit(0)).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    table = spark.createDataFrame(
        [(1, "L\nA"), (1, "B\nL"), (2, "Les.\n\nOwn"), (None, "A\nC"), (3, "\nLes."), (4, None)], "doc_id long, text string"
    )
    out = sorted(linededup.drop_repeated_lines(table).collect(), key=str)
    kept = sorted(line for r in out if r.doc_id == 1 for line in r.text.split("\n"))
    assert kept in (["", "B", "L"], ["B", "L"])  # `A` stands in the row without an id before
    assert {r.text for r in out if r.doc_id != 1} == {"Les.\n\nOwn", "A\nC", "", None}


def plain_components(texts, size, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        whole = {tuple(words)} if words else set()
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or whole)
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def copies(rnd, groups=6, members=12):
    texts = []
    for _ in range(groups):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(60, 140))]
        for _ in range(members):
            copy = list(words)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(4000)}"
            texts.append(" ".join(copy[rnd.randrange(9) :]))
    return texts + ["Two words", "two WORDS", "", None, "one"]


@pytest.mark.parametrize("crowd", [200, 1, 0])
def test_components_match_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "LEAD_ROUNDS", 1 if crowd else 0)
    texts = copies(random.Random(4))
    got = neardup.components(documents(spark, texts), 4, 80)
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == plain_components(texts, 4, 80)
    assert all(k == (d == c) for d, c, k in rows(got, "doc_id", "component_id", "kept"))


def test_near_duplicates_stand_awkward_rows(spark):
    table = awkward(spark)
    out = neardup.drop_near_duplicates(table)
    assert out.columns == table.columns
    assert sorted(rows(out, "doc_id"), key=str) == [(1,), (2,), (3,), (4,), (5,), (8,), (None,)]
    assert neardup.components(table.limit(0)).count() == 0
    assert neardup.components(table).count() == table.count()


def test_bounds_of_the_sequential_comparison():
    least = neardup.least_matches(0.8)
    assert least == sorted(least) and len(least) == neardup.HASHES // neardup.BATCH
    assert all(m < 0.8 * n for m, n in zip(least, range(32, 129, 32)))


def plain_passages(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in enumerate(words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages_match_plain_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 300)
    rnd = random.Random(8)
    shared = [" ".join(f"s{rnd.randrange(900)}é" for _ in range(n)) for n in (5, 9, 14, 30)]
    texts = ["\x0b".join(f"w{rnd.randrange(9000)}" for _ in range(rnd.randrange(40))) for _ in range(60)]
    texts = [t + " " + rnd.choice(shared) + "\r\n" + " ".join(["a"] * rnd.randrange(15)) for t in texts] + ["", None, "b " * 40]
    got = substrings.repeated_passages(documents(spark, texts), 7)
    assert sorted(rows(got, "doc_id", "n_words", "n_removed", "kept_sha256")) == plain_passages(texts, 7)


def test_passages_stand_awkward_rows(spark):
    out = {r.doc_id: r for r in substrings.repeated_passages(awkward(spark), 4).collect()}
    assert out[2].n_words == 0 and out[2].spans == []
    assert out[6].n_removed == out[6].n_words
    assert substrings.repeated_passages(awkward(spark).limit(0)).count() == 0
    assert substrings.factors(np.array([1, 0, 0, 1, 1, 0, 0, 0, 0, 1], bool), 3) == [(0, 7), (9, 12)]


def test_pairs_of_two_clusters_grow_linearly(spark):
    """Two clusters of 600 near copies that share a third of their text, so some bands."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(130)]
    bases = [shared + [word() for _ in range(70)] for _ in range(2)]
    docs = []
    for i in range(1200):
        words = list(bases[i % 2])
        words[rnd.randrange(150, 200)] = word()
        docs.append(" ".join(words))
    df = documents(spark, docs)
    known = neardup.sketches(df, 4)
    keyed = known.select("doc_id", F.explode(neardup.band_keys(F.col("signature"))).alias("key")).withColumn("grp", F.col("doc_id") % 2)
    bands = neardup._with_groups(keyed, None)
    assert bands.count() > 2000
    linked, pairs = neardup._around_centres(bands, df, 4, 80)
    assert pairs.count() < 4 * 1200
    got = {d: c for d, c in rows(neardup.components(df, 4), "doc_id", "component_id")}
    assert got == {i: i % 2 for i in range(1200)}


def test_pairs_of_texts_of_common_passages_are_few(spark):
    """Texts of 28 of 40 common passages: any two have much in common, few are linked."""
    rnd = random.Random(3)
    passages = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(40)]
    docs = [" ".join(passages[i] for i in sorted(rnd.sample(range(40), 28))) for _ in range(250)]
    docs += [d.replace(d.split()[50], "other") for d in docs[:20]]
    df = documents(spark, docs)
    known = neardup.sketches(df, 4)
    keyed = known.select("doc_id", F.explode(neardup.band_keys(F.col("signature"))).alias("key")).withColumn("grp", F.col("doc_id"))
    bands = neardup._with_groups(keyed, None)
    linked, pairs = neardup._around_centres(bands, df, 4, 80)
    assert pairs.count() < 15 * len(docs)
    got = neardup.components(df, 4)
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == plain_components(docs, 4, 80)


def test_bands_are_met_once(spark, monkeypatch):
    """Crowded bands and others are told apart without meeting the open bands again."""
    import traceback

    from pyspark.sql.classic.dataframe import DataFrame

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    docs = []
    for base in ([word() for _ in range(200)] for _ in range(3)):
        for _ in range(60):
            words = list(base)
            for _ in range(rnd.randrange(1, 12)):
                words[rnd.randrange(200)] = word()
            docs.append(" ".join(words))
    made, join = [], DataFrame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if (on, how) == ("key", "left_semi") and "boxlake" in traceback.extract_stack()[-2].filename:
            made.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "join", counted)
    got = neardup.components(documents(spark, docs), 4)
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == plain_components(docs, 4, 80)
    first, *later = made
    assert len(later) <= 3 and sum(later[:1] + later[2:]) <= first
