"""The operators bound to whole tables, and SQL that must agree where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logquarry.llm import centroids, decontam, language, minhash, mixing, perplexity, resample, rules, simhash, suffixes, tokens, toxicity, urls
from logquarry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.query(table(spark, folder, "documents"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeats(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality(table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op10_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(table(spark, folder, "embeddings"))


_ALL = (op1_mix, op2_decontaminate, op3_simhash, op4_toxicity, op5_token_counts, op6_suffixes, op7_quality_rules, op8_url_filter, op9_language, op10_perplexity, op11_minhash, op12_resample, op13_centroids)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_OP1 = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
  md5(coalesce(doc_id::varchar, '')) as place from documents),
ranked as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as k
  from sized group by source),
weighed as (select *, case k when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, source_size * 3.0::double as most from ranked),
level as (select *, (sum(source_size) over () - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (o rows between current row and unbounded following) as lvl
  from weighed window o as (order by source_size / weight, source nulls last)),
freed as (select *, first_value(case when most > lvl * weight then lvl end ignore nulls) over
  (order by source_size / weight, source nulls last rows between unbounded preceding and current row) as shared from level),
goals as (select source, source_size, k, least(coalesce(shared * weight, most), most) as target from freed),
led as (select s.*, g.source_size, g.target, g.k, coalesce(sum(size) over (partition by s.source order by place, size desc
  rows between unbounded preceding and 1 preceding), 0)::bigint as lead from sized s join goals g on s.source is not distinct from g.source),
rounds as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from led),
parts as (select *, least(greatest(floor(target - rounds * source_size)::bigint - lead, 0), size) as part from rounds),
took as (select *, rounds * size + part as taken, lead / target as d from parts),
curves as (select *, case k when 0 then struct_pack(t := 0.0, b := 0.0, w := 1.5, s := -1.0)
  when 1 then case when d < 0.5 then struct_pack(t := 0.0, b := 0.0, w := 2 / 3.0::double, s := 4 / 3.0::double)
   else struct_pack(t := 0.5, b := 0.5, w := 4 / 3.0::double, s := -4 / 3.0::double) end
  else case when d < 0.375 then struct_pack(t := 0.0, b := 0.0, w := 0.625, s := 0.0)
   else struct_pack(t := 0.6, b := 0.375, w := 0.625, s := 4.6875) end end as c from took)
select doc_id, size, source_size, target, taken, case when taken > 0 then rounds + (part > 0)::int else 0 end::int as copies,
 case when taken > 0 then round(c.t + 2 * (d - c.b) / (c.w + sqrt(greatest(0, c.w * c.w + 2 * c.s * (d - c.b)))), 9) end as position
from curves"""

_OP12 = r"""
with recursive crc(i, v, step) as (select range, range::bigint, 0 from range(256) union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from crc where step < 8),
steps as (select list(v order by i) as t from crc where step = 8),
lower_docs as (select row_number() over () as r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
docs as (select r, doc_id, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words from lower_docs),
raw as (select r, unnest(words) as w from docs),
aim as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
bytes as (select w, list_transform(string_split(trim(regexp_replace(hex(encode(w)), '(..)', '\1 ', 'g')), ' '),
  lambda h: ('0x' || h)::bigint) as octets from (select w from raw union select w from aim)),
hashed as (select w, xor(list_reduce(list_prepend(4294967295::bigint, octets),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, steps),
s as (select bucket, count(*) as n from raw join hashed using (w) group by bucket),
t as (select bucket, count(*) as n from aim join hashed using (w) group by bucket),
gain as (select g.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from raw) + 10000)
  / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from aim) + 10000))))::bigint as gain
  from (select range as bucket from range(10000)) g left join s using (bucket) left join t using (bucket)),
weights as (select r, sum(gain)::bigint as weight from raw join hashed using (w) join gain using (bucket) group by r),
scored as (select r, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
  / 4294967296::double))))::bigint as score from docs left join weights using (r)),
placed as (select r, row_number() over (order by score desc, doc_id nulls last) as place from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * (select count(*) from placed) // 100 then place end as rank
from scored left join placed using (r)"""


def _op13(rounds: int = 5) -> str:
    """Every assignment and every move of the centroids written out."""
    parts = ["""with kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as i from kept),
c0 as materialized (select j, unnest(v) as x, generate_subscripts(v, 1) as i from
  (select row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as j, v from kept qualify j < 40))"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} as materialized (select r, min_by(j, d * 64 + j) as j, min(d) as d from
  (select e.r, c.j, sum((e.x - c.x) * (e.x - c.x))::bigint as d from e join c{k} c using (i) group by e.r, c.j) group by r)""")
        if k < rounds:
            parts.append(f"""c{k + 1} as materialized (select c.j, c.i, coalesce(m.x, c.x) as x from c{k} c left join
  (select j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x from a{k} join e using (r) group by j, i) m using (j, i))""")
    parts.append(f"digest as (select j, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by j)")
    return ",\n".join(parts) + f"""
select vec_id, j::int as cluster, d as distance, (sum(d) over (partition by j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from a{rounds} join kept using (r) join digest using (j)"""


_OP11 = r"""
with recursive split as (select row_number() over () as r, doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
sets as (select r, doc_id, case when len(w) < 2 then w
  else list_sort(list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) end as s from split),
classes as (select row_number() over () as k, s, len(s) as n, min(doc_id) as first_id from sets where len(s) > 0 group by s),
parts as (select k, n, unnest(s) as x from classes),
links as (select a.k as u, b.k as v from parts a join parts b on a.x = b.x and a.k < b.k
  group by a.k, b.k, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways as (select u, v from links union all select v, u from links),
reach(k, t) as (select k, k from classes union select reach.k, ways.v from reach join ways on ways.u = reach.t),
named as (select reach.k, min(c.first_id) as component_id from reach join classes c on c.k = reach.t group by reach.k),
placed as (select s, component_id from classes join named using (k))
select doc_id, len(sets.s)::bigint as n_shingles, case when len(sets.s) = 0 then doc_id else component_id end as component_id,
  doc_id is not distinct from (case when len(sets.s) = 0 then doc_id else component_id end) as kept from sets left join placed on sets.s = placed.s"""

ORACLE_SQL: dict[str, str] = {"op1_mix": _OP1, "op11_minhash": _OP11, "op12_resample": _OP12, "op13_centroids": _op13()}
