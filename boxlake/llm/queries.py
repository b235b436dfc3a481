"""Registered queries of the package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm import (
    decontaminate,
    html,
    language,
    linededup,
    manifest,
    mixing,
    neardup,
    negatives,
    pii,
    quality,
    substrings,
    toxicity,
    urls,
)
from boxlake.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_toxicity(spark, d):
    return toxicity.score_documents(documents(spark, d), table(spark, d, "labels"))


@query
def op10_minhash_near_dedup(spark, d):
    return neardup.components(documents(spark, d), size=4, percent=80)


@query
def op8_line_dedup(spark, d):
    docs = documents(spark, d)
    found = linededup.line_decisions(docs).withColumn("removed", F.array_join("removed", ","))
    found = found.withColumnRenamed("doc_id", "of").withColumnRenamed("row", "of_row")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))
    out = docs.select("doc_id", linededup.row_key().alias("row")).join(found, same, "left").drop("row", "of", "of_row")
    return out.fillna(0, ["n_lines", "n_links", "n_removed"]).fillna("", ["removed"])


# One edit leaves the first or the second half of the shorter line as it is.
ORACLE["op8_line_dedup"] = r"""
with occ as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no
  from documents where text is not null),
judged as (select * from occ where regexp_matches(line, '[^\x20\x09-\x0D]')),
d as (select line, length(line) as n, min({'d': doc_id, 'l': line_no}) as at from judged group by line),
met as (
  select a.line as a, b.line as b from d a join d b on left(a.line, a.n // 2) = left(b.line, a.n // 2)
    where a.n >= 24 and b.n between a.n and a.n + 1 and a.line <> b.line
  union
  select a.line, b.line from d a join d b on right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)
    where a.n >= 24 and b.n between a.n and a.n + 1 and a.line <> b.line),
near as (select a, b from met where levenshtein(a, b) <= 1),
links as (select a, b from near union select b, a from near),
best as (select a as line, count(*) as links, min(d.at) as at from links join d on d.line = links.b group by a),
flagged as (
  select j.doc_id, j.line_no, coalesce(best.links, 0) as links,
    least(d.at, coalesce(best.at, d.at)) < {'d': j.doc_id, 'l': j.line_no} as repeated
  from judged j join d on d.line = j.line left join best on best.line = j.line),
sums as (
  select doc_id, count(*) as n_lines, count(*) filter (repeated) as n_removed, sum(links)::bigint as n_links,
    coalesce(string_agg(line_no::varchar, ',' order by line_no) filter (repeated), '') as removed
  from flagged group by doc_id)
select documents.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_links, 0)::bigint as n_links,
  coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed
from documents left join sums using (doc_id)
"""


@query
def op5_benchmark_decontamination(spark, d):
    found = decontaminate.add_leaks(documents(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), "items")


@query
def op2_source_mixing(spark, d):
    return mixing.mix_by_source(documents(spark, d))


@query
def op6_substring_dedup(spark, d):
    found = substrings.repeated_passages(documents(spark, d))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


@query
def op4_language_id(spark, d):
    return language.identify(documents(spark, d))


@query
def op3_quality_rules(spark, d):
    return quality.judge(documents(spark, d), table(spark, d, "labels"))


@query
def op1_html_extraction(spark, d):
    return html.extract(table(spark, d, "pages"))


@query
def op7_pii(spark, d):
    return pii.find(documents(spark, d))


@query
def op11_merkle_manifest(spark, d):
    return manifest.verify(documents(spark, d))


def _manifest_sql(doc_levels: int = 6, source_levels: int = 4) -> str:
    """Levels written out: enough for 16^6 rows of a source and 16^4 sources."""
    fields = "||".join(
        f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """(select xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''),
      lambda c: [unicode(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295))"""
    ctes = [
        f"base as (select doc_id, source, sha256({fields.format(text='text')}) as leaf, sha256({fields.format(text='changed')}) as again "
        f"from (select *, case when {crc} % 5 = 0 then {lower} else text end as changed from documents))",
        "d0 as (select source as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, "
        "count(*) over (partition by source) as n, leaf as digest, doc_id, again from base)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            run = "over (partition by g, pos // 16 order by pos rows between"
            ctes.append(
                f"{name}s{k} as (select g, pos, n, "
                f"case when n > 1 then coalesce(string_agg(digest, '') {run} unbounded preceding and 1 preceding), '') else '' end as l, "
                f"case when n > 1 then coalesce(string_agg(digest, '') {run} 1 following and unbounded following), '') else '' end as r "
                f"from {name}{k})"
            )
            ctes.append(
                f"{name}{k + 1} as (select g, pos // 16 as pos, ceil(any_value(n) / 16)::bigint as n, "
                f"case when any_value(n) > 1 then sha256(string_agg(digest, '' order by pos)) else any_value(digest) end as digest "
                f"from {name}{k} group by g, pos // 16)"
            )

    levels("d", doc_levels)
    ctes.append(
        f"t0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, digest, g as source from d{doc_levels})"
    )
    levels("t", source_levels)
    joins, proof, folded = [], [], "again"
    for name, count, group, pos in (("d", doc_levels, "d0.g", "d0.pos"), ("t", source_levels, "0", "t0.pos")):
        for k in range(count):
            s = f"{name}s{k}"
            joins.append(f"join {s} on {s}.g is not distinct from {group} and {s}.pos = {pos} // {16**k}")
            proof.append(f"{s}.l || {s}.r")
    steps = [f"{name}s{k}" for name, count in (("d", doc_levels), ("t", source_levels)) for k in range(count)]
    ctes.append(
        "met as (select d0.doc_id, d0.digest as leaf, d0.again, t0.digest as subroot, "
        + ", ".join(f"{s}.l as {s}l, {s}.r as {s}r, {s}.n as {s}n" for s in steps)
        + f" from d0 join t0 on t0.source is not distinct from d0.g {' '.join(joins)})"
    )
    before = "met"
    for i, s in enumerate(steps):
        ctes.append(f"f{i} as (select *, case when {s}n > 1 then sha256({s}l || {folded} || {s}r) else {folded} end as c{i} from {before})")
        before, folded = f"f{i}", f"c{i}"
    sides = " || ".join(f"{s}l || {s}r" for s in steps)
    return (
        f"with {', '.join(ctes)} select doc_id, leaf, subroot, (select digest from t{source_levels}) as root, sha256({sides}) as proof_sha256, "
        f"{folded} as folded_root, {folded} = (select digest from t{source_levels}) as verified from {before}"
    )


ORACLE["op11_merkle_manifest"] = _manifest_sql()


@query
def op12_url_filters(spark, d):
    return urls.judge(table(spark, d, "pages"), urls.RULES)


def _urls_sql() -> str:
    """The same descent, on the same table, as a recursive query."""
    pairs = [(url, 0) for url in urls.WANTED.split()] + [(url, 1) for url in urls.UNWANTED.split()]
    rows = ", ".join(f"('{url}', {block})" for url, block in pairs)

    def grams(text: str, kind: int) -> str:
        codes = f"list_transform(string_split(chr(2) || translate({text}, '{urls.DIGITS}', '{"0" * 10}') || chr(3), ''), lambda c: unicode(c)::bigint)"
        parts = []
        for n in urls.SIZES:
            h = f"{kind}::bigint"
            for k in range(n):
                h = f"(({h}) * {urls.FACTOR} + codes[i + {k}]) % {urls.MODULUS}"
            parts.append(f"list_transform(range(1, len(codes) - {n - 2}), lambda i: ({h}) % {urls.PLACES})")
        return f"(select {' || '.join(parts)} from (select {codes} as codes))"

    split = r"""regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"""
    host = f"translate({split.format(1)}, '{urls.UPPER}', '{urls.LOWER}')"
    name = "null::varchar"
    verdict = "null::varchar"
    for r in sorted(urls.RULES, key=lambda r: len(r.name)):
        fits = f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        name = f"case when {fits} then '{r.name}' else {name} end"
        verdict = f"case when {fits} then '{r.verdict}' else {verdict} end"
    return f"""
with recursive labelled(url, y) as (values {rows}),
parted as (select row_number() over (order by url, y) - 1 as i, y, {host} as host, {split.format(2)} as path from labelled),
features as (select i, y, {grams("host", 1)} || {grams("path", 2)} as g from parted),
flat as (select i, len(g) as total, unnest(g) as place from features),
vals as (select i, place, count(*) / sqrt(any_value(total)) as x from flat group by i, place),
products as (select a.i as a, b.i as b, round(sum(a.x * b.x), 9) as dot from vals a join vals b using (place) group by a.i, b.i),
lines as (select f.i, any_value(f.y) as y, list(coalesce(dot, 0.0) + 1 order by o.i) as dots
  from features f cross join features o left join products p on p.a = f.i and p.b = o.i group by f.i),
rows_ as (select list({{'i': i, 'y': y, 'dots': dots}} order by i) as t from lines),
descent(k, alpha) as (
  select 0, list_transform(t, lambda r: 0.0::double) from rows_
  union all
  select k + 1, list_transform(t, lambda r: alpha[r.i + 1] * (1 - {urls.RATE} * {urls.RIDGE})
      + (r.y - 1 / (1 + exp(-list_dot_product(r.dots, alpha)))) * {urls.RATE} / len(t)) from descent, rows_ where k < {urls.STEPS}),
alphas as (select unnest(alpha) as a, unnest(range(len(alpha))) as i from descent where k = {urls.STEPS}),
weights as (select place, sum(x * a) as w from vals join alphas using (i) group by place),
judged as (select row_number() over () as row_no, page_id, {host} as host, {split.format(2)} as path from pages),
own as (select *, {grams("host", 1)} || {grams("path", 2)} as g from judged),
places as (select row_no, unnest(g) as place from own),
sums as (select row_no, sum(coalesce(w, 0)) as z from places left join weights using (place) group by row_no),
scored as (select own.*, 1 / (1 + exp(-((select sum(a) from alphas) + coalesce(z, 0) / sqrt(greatest(len(g), 1))))) as s from own left join sums using (row_no))
select page_id, host, path, {name} as rule, coalesce({verdict}, case when s >= {urls.CUT} then 'block' else 'allow' end) as verdict,
  round(s, 4) as score from scored
"""


ORACLE["op12_url_filters"] = _urls_sql()


@query
def op13_hard_negatives(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, d, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vec"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLE["op13_hard_negatives"] = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
