"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from boxlake.llm import manifest
from tests.llm.helpers import SCHEMA, awkward, rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Root, and for each leaf the siblings of its path, by level, left and right apart."""
    paths = [[] for _ in leaves]
    at, level = list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 16 * 16
            paths[i].append((level[run:p], level[p + 1 : run + 16]))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], paths


def plain(docs):
    bysource = {}
    for r in docs:
        bysource.setdefault(r[3], []).append(r)
    order = sorted(bysource, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        group = sorted(bysource[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((group, *plain_tree([leaf(r) for r in group])))
    root, above = plain_tree([m[1] for m in made])
    out = []
    for (group, subroot, paths), more in zip(made, above):
        for r, path in zip(group, paths):
            path = path + more
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf((r[0], text, *r[2:]))
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*[d for left, right in path for d in left + right])
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return out


def leaf(r):
    return h(*map(field, (r[0], r[3], r[2], r[4], r[1])))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def key(r):
    return tuple(map(repr, r))


def test_trees_of_all_sizes(spark):
    rnd = random.Random(3)
    docs = []
    for s, n in enumerate([1, 2, 15, 16, 17, 33, 256, 257, 300]):
        source = None if n == 33 else f"söurce {s}"
        docs += [(len(docs) + i, rnd.choice(["Ab", "ab", "", None, "É x"]), rnd.choice(["en", None]), source, rnd.choice([None, i])) for i in range(n)]
    docs += [(10_000 + i, "T", "en", f"one {i}", 1) for i in range(20)]
    rnd.shuffle(docs)
    got = rows(manifest.verify(spark.createDataFrame(docs, SCHEMA).repartition(7)), *COLUMNS)
    assert sorted(got, key=key) == sorted(plain(docs), key=key)
    assert {r[6] for r in got} == {True, False}


def test_awkward_rows_and_copies(spark):
    df = awkward(spark)
    got = rows(manifest.verify(df), *COLUMNS)
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    assert sorted(got, key=key) == sorted(plain(docs), key=key)


def test_hot_copies(spark):
    docs = [(7, "Same", "en", "a", 4)] * 600 + [(i, "x", "en", "b", 1) for i in range(40)]
    got = rows(manifest.verify(spark.createDataFrame(docs, SCHEMA).repartition(5)), *COLUMNS)
    assert sorted(got, key=key) == sorted(plain(docs), key=key)


def test_empty_table(spark):
    df = manifest.verify(spark.createDataFrame([], SCHEMA))
    assert df.columns == COLUMNS and df.count() == 0


def test_requests_for_some_leaves(spark):
    docs = [(i, str(i), "en", f"s{i % 3}", i) for i in range(900)]
    found = manifest.build(spark.createDataFrame(docs, SCHEMA))
    some = F.col("key").isin(0, 5, 899, 450)
    every = {r.key: r.proof for r in manifest.proofs(found).collect()}
    asked = {r.key: r.proof for r in manifest.proofs(found, some).collect()}
    assert set(asked) == {0, 5, 899, 450} and all(asked[k] == every[k] for k in asked)
    assert found.records.count() == found.records.select("digest").distinct().count()
