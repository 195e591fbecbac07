"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import audit, avi, bpe, collocations, iblt, langid, licenses, packing, preference, quality, secrets, sharding, simhash


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, 1 of low quality, 2 good; of several labels the lowest grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, graded(table(spark, sf_dir, "labels")))
    out = quality.rate(docs, model)
    return out.withColumn("kept", F.col("tail_prob") >= quality.LEAST)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_components(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.describe(table(spark, sf_dir, "documents"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.format_pairs(preference.borrowed_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), x["train"])), ",")
    return rows.withColumns({c: spans(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_next(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_language, op3_packing, op4_licenses, op5_sharding, op6_simhash, op7_bpe, op8_media, op9_preference, op10_fingerprint, op11_collocations, op12_secrets, op13_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_preference": PREFERENCE_SQL, "op11_collocations": COLLOCATION_SQL, "op13_audit": AUDIT_SQL}


#: Chosen and rejected differ in one turn, so the prompt is what lies before it.
PREFERENCE_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, text, row_number() over (partition by conv_id order by turn, role, text) as p from conversations where conv_id is not null),
ends as (select conv_id, max(p) filter (where role = 'assistant') as a_at, max(p) as n from t group by conv_id),
answer as (select t.conv_id, t.text as other from t join ends l on t.conv_id = l.conv_id and t.p = l.a_at),
nxt as (select conv_id, coalesce(lead(conv_id) over (order by conv_id), min(conv_id) over ()) as next_id from ends),
pair as (select l.conv_id, l.a_at, l.n, a.other from ends l join nxt x on l.conv_id = x.conv_id left join answer a on a.conv_id = x.next_id),
side as (
  select p.conv_id, 'a' as side, t.p as p, t.role, coalesce(t.text, '') as text from pair p join t on t.conv_id = p.conv_id
  union all
  select p.conv_id, 'b', case when p.other is null and t.p > p.a_at then t.p - 1 else t.p end, t.role, case when t.p = p.a_at then p.other else coalesce(t.text, '') end
  from pair p join t on t.conv_id = p.conv_id where p.a_at is null or t.p <> p.a_at or p.other is not null),
both_sides as (
  select p.conv_id, s.p, max(case when side = 'a' then s.role || chr(1) || s.text end) as a, max(case when side = 'b' then s.role || chr(1) || s.text end) as b
  from pair p join side s on s.conv_id = p.conv_id group by p.conv_id, s.p),
prefix as (select conv_id, coalesce(min(p) filter (where a is distinct from b), max(p) + 1) - 1 as k from both_sides group by conv_id),
r as (
  select s.conv_id, s.side, s.p, x.k, s.role, '<|' || s.role || '|>' || chr(10) || s.text || chr(10) as line, length(s.role) + 5 as head, length(s.role) + length(s.text) + 6 as size
  from side s join prefix x on x.conv_id = s.conv_id),
place as (select *, case when p > k then sum(case when p > k then size else 0 end) over (partition by conv_id, side order by p) - size end as pos from r),
spans as (select *, pos || '-' || (pos + head) || ':0,' || (pos + head) || '-' || (pos + size) || ':' || (case when role = 'assistant' then '1' else '0' end) as span from place)
select conv_id, cast(max(k) as int) as prompt_turns, coalesce(string_agg(line, '' order by p) filter (where side = 'a' and p <= k), '') as prompt,
  coalesce(string_agg(line, '' order by p) filter (where side = 'a' and p > k), '') as chosen_text, coalesce(string_agg(line, '' order by p) filter (where side = 'b' and p > k), '') as rejected_text,
  coalesce(string_agg(span, ',' order by p) filter (where side = 'a' and p > k), '') as chosen_mask, coalesce(string_agg(span, ',' order by p) filter (where side = 'b' and p > k), '') as rejected_mask,
  coalesce(bool_or(p > k), false) as "distinct"
from spans group by conv_id
"""

#: Failure flags by document, all orders as strings, and each order's steps as sums over the documents' masks.
AUDIT_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
m as (
  select doc_id, part, (len(words) < 200)::int as a, (100 * len(list_distinct(words)) < 50 * len(words))::int as b,
    (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int as c, regexp_matches(text, '[#$%&*|]')::int as d, coalesce(doc_id > first, false)::int as e from w),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
k as (
  select part, case when a = 1 then 'A' else '' end || case when b = 1 then 'B' else '' end || case when c = 1 then 'C' else '' end || case when d = 1 then 'D' else '' end || case when e = 1 then 'E' else '' end as fails,
    count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from m left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from f p, f q, f r, f s, f t
  where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x),
st as (select filter_order, step::int as step, filter_order[step:step] as own, filter_order[1:step - 1] as prior from o, range(1, 6) g(step)),
z as (
  select part, filter_order, step, own, n, good, toxic, contains(fails, own) as fail, regexp_matches(fails, '[' || prior || '0]') as gone, fails = own as only_one from k, st),
r as (
  select part, filter_order, step, own, coalesce(sum(n) filter (where not fail and not gone), 0)::bigint as kept, coalesce(sum(n) filter (where fail and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (where fail and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where only_one), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where fail and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where fail and not gone), 0)::bigint as toxic_lost
  from z group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""

#: All phrases of pieces, counted; each cut's parts are phrases too.
COLLOCATION_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
q as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
u as (select lang, id, unnest(w) as x, generate_subscripts(w, 1) as i from q),
e as (select lang, x, lead(x, 1) over v as x2, lead(x, 2) over v as x3, lead(x, 3) over v as x4 from u window v as (partition by id order by i)),
g as (
  select lang, 1 as k, x as phrase from e union all select lang, 2, x || ' ' || x2 from e where x2 is not null
  union all select lang, 3, x || ' ' || x2 || ' ' || x3 from e where x3 is not null union all select lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 from e where x4 is not null),
f as (select lang, phrase, k::int as k, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, phrase, string_split(phrase, ' ') as w, k, f as a from f where k between 2 and 4 and f >= 30),
cut as (select lang, phrase, w, c.k as len, a, j::int as j, array_to_string(w[1:j], ' ') as x, array_to_string(w[j + 1:], ' ') as y from c, range(1, 4) q(j) where j < c.k),
sc as (
  select cut.lang, cut.phrase, a, j, lf.f as l, rf.f as r, (2000000::hugeint * a // (lf.f + rf.f))::bigint as score
  from cut join f lf on lf.lang = cut.lang and lf.phrase = x join f rf on rf.lang = cut.lang and rf.phrase = y),
one as (select * from sc qualify row_number() over (partition by lang, phrase order by score, j) = 1),
sub as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from c, range(2, 4) q(m), range(1, 4) z(i) where m < c.k and i + m - 1 <= c.k group by all),
kept as (select one.* from one left join sub using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from kept) join n using (lang) where rank <= 2000
"""
