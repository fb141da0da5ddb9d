"""One query per operator, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, langid, lexical, licenses, merkle, mixing, near_dedup, packing, pii, quality, secrets, token_counts
from .common import shared_dir

#: The key of the pseudonyms: ``spark.scriptoria.pii.key``; the other one serves tests, on a local master alone.
PII_KEY_CONF, PII_TEST_KEY = "spark.scriptoria.pii.key", "not-a-secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    # documents arrive in two loads, which together are all of them; the second scan runs on blobs that the first lacks alone
    load = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(2))
    for number in range(2):
        ledger.scan(f"load-{number}", docs.where(load == number))
    found = ledger.findings(docs, ["doc_id"])
    of = lambda kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined_spans(of(secrets.BASE_KINDS)), 256).alias("base_sha256"), secrets.joined_spans(F.col("findings")).alias("spans"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found, (lang, score) = langid.identify(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).totals()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    places = F.transform("phrases", lambda p: p["places"])
    base = F.transform(F.filter("phrases", lambda p: p["places"]["n"] > 0), lambda p: p["label"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    n_base = F.aggregate(F.transform(places, lambda p: p["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_base.alias("n_base"), F.array_min(F.transform(places, lambda p: p["first"])).alias("first_word"), F.array_max(F.transform(places, lambda p: p["last"])).alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, "template_labels")).alias("labels"), "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without a key set, a cluster gets one that nobody knows: values stay linked within the result, and in no other
    key = spark.conf.get(PII_KEY_CONF, PII_TEST_KEY if spark.sparkContext.master.startswith("local") else token_hex(32))
    if not key:
        raise ValueError(f"set {PII_KEY_CONF}")
    masked = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key, counts_col="found")
    return masked.select("doc_id", "text", *[F.col(f"found.{kind}").cast("long").alias(f"n_{kind}") for kind, _ in pii.KINDS])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (n_words, spans, items) = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    names = F.array_join(items, ",")
    return found.select("doc_id", F.col(n_words).alias("n_words"), decontaminate.hit_words(F.col(spans)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), decontaminate.contaminated(F.col(n_words), F.col(spans)).alias("contaminated"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in merkle.FIELDS]
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(drawn, merkle.record_hash([*fields[:-1], small]))
    leaves = docs.select("doc_id", "lang", merkle.record_hash(fields).alias("leaf"), tampered.alias("tampered"))
    found, (subroot, root, proof) = merkle.prove(leaves, "leaf", "lang", "doc_id")
    proved = found.select("doc_id", "leaf", F.col(subroot).alias("subroot"), F.col(root).alias("root"), F.sha2(merkle.siblings(F.col(proof)), 256).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col(proof)).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"))
    own = pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return own.join(packing.pack(pieces.select("key", "length")), "key").drop("key")


def _spans_sql(name: str, pattern: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} as (
  select doc_id, '{name}' as kind, st, st + length(m) as en from (
    select doc_id, m, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as st from (
      select doc_id, p, ms, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m from (
        select doc_id, string_split_regex(t, '{quoted}') as p, regexp_extract_all(t, '{quoted}') as ms from d where regexp_matches(t, '{quoted}'))))
  where {keep})"""


def _op1_sql() -> str:
    parts, union = [], []
    for i, rule in enumerate(secrets.RULES):
        quoted = rule.pattern.replace("'", "''")
        keep = f"length(regexp_extract(m, '{quoted}', {rule.group})) >= {rule.least}"
        parts.append(_spans_sql(rule.kind, rule.pattern, keep))
        union.append(f"select *, {i} as rk from {rule.kind}")
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), {', '.join(parts)},
every as ({' union all '.join(union)}),
joined as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as c,
  string_agg(kind || ':' || st || ':' || en, ',' order by st, rk) filter (rk < 3) as base, string_agg(kind || ':' || st || ':' || en, ',' order by st, rk) as spans from every group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join joined using (doc_id)"""


_OP2_SQL = """with recursive tok as (select doc_id, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
src as (select source, sum(n_tokens)::bigint as tokens, count(*)::bigint as docs from tok group by source),
live as (select tokens, tokens / (select sum(tokens) from src)::double as share from src where tokens > 0),
e(step, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select step + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
    select step, lo, hi, (lo + hi) / 2 as mid, (select ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(pow(share, (lo + hi) / 2))) / sum(pow(share, (lo + hi) / 2)) from live) >= 0.95 * ln((select count(*) from live)) as ok from e where step < 30)),
r(step, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select step + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
    select step, lo, hi, (lo + hi) / 2 as mid, (select max(pow(share, (lo + hi) / 2) / tokens) / sum(pow(share, (lo + hi) / 2)) * (select sum(tokens) from live)::double from live) > 4.0 as ok from r where step < 30)),
t as (select case when (select count(*) from live) < 2 then 1.0 else greatest((select lo from e where step = 30), (select hi from r where step = 30)) end as t),
w as (select source, tokens, docs, case when tokens > 0 then pow(tokens / (select sum(tokens) from src)::double, (select t from t)) else 0.0 end as p from src),
plan as (select source, greatest(1, ceil(docs / 4096.0))::bigint as blocks, floor(p / (select sum(p) from w) * (select sum(tokens) from src)::double + 1e-6)::bigint as quota, greatest(tokens, 1) as size from w),
placed as (select tok.*, md5('mix-1|' || doc_id) as key, ('0x' || substr(md5('mix-1|' || doc_id), 1, 8))::bigint % blocks as block, quota // size as full_reads, quota % size as rest from tok join plan using (source)),
run as (select *, coalesce(sum(n_tokens) over (partition by source order by block, key, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start_token from placed)
select doc_id, source, n_tokens, (full_reads + case when n_tokens > 0 and start_token + n_tokens <= rest then 1 else 0 end)::bigint as copies, start_token from run"""

_OP5_SQL = """with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d"""


def _op6_sql() -> str:
    sets = licenses.template_sets(licenses.TEMPLATES)
    values = ", ".join(f"('{label}', {step}, {words!r})" for label, step, words in sets)
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in licenses.PHRASES)
    return f"""with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
phrases(label, ws) as (values {phrases}), templates(label, step, ws) as (values {values}), steps as (select distinct step from templates),
places as (select doc_id, label, i from (select doc_id, label, ws, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = ws[1])) as i from d, phrases) where w[i:i + len(ws) - 1] = ws),
base as (select doc_id, count(*) as n, min(i) - 1 as f, max(i) - 1 as l, string_agg(distinct label, ',' order by label) as b, list(distinct label) as ls from places group by doc_id),
blocks as (select doc_id, step, w[i:i + 2 * step - 1] as b from (select doc_id, step, w, unnest(range(1, greatest(1, len(w)) + 1, step)) as i from d, steps)),
found as (select doc_id, label, max(len(list_intersect(ws, b)) / len(ws)::double) as c from blocks join templates using (step) where len(list_intersect(ws, b)) >= ceil({licenses.THRESHOLD} * len(ws) - 1e-9) group by doc_id, label),
best as (select doc_id, max(c) as s, list(label) as ls from found group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word, coalesce(b, '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(best.ls, [])))), ','), '') as labels, coalesce(s, 0.0)::double as score
from d left join base using (doc_id) left join best using (doc_id)"""


_OP9_SQL = """with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
e as (select u, v from l union all select v, u from l),
r(id, c) as (select doc_id, doc_id from documents union select e.v, r.c from r join e on e.u = r.id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, doc_id = c as kept from (select id as doc_id, min(c) as c from r group by id) left join n using (doc_id)"""

_OP10_SQL = """with dw as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
bw as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + 12], ' ') as g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from bw where len(w) > 0)),
ks as (select distinct k from win),
grams as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, ks where len(w) >= k)),
occ as (select doc_id, i, grams.k, item_id from grams join win on grams.k = win.k and grams.g = win.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from occ) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from occ group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join its using (doc_id)"""


def _crc32_sql(value: str) -> str:
    """CRC-32 of a text of ASCII characters, by its rule."""
    rows = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i))"
    step = f"lambda c, b: xor(c >> 8, ({rows})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({value}, ''), lambda x: ascii(x)::bigint), {step}, 4294967295), 4294967295)"


def _op11_sql() -> str:
    said = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    small = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    head = " || ".join(said(c) for c in merkle.FIELDS[:-1])

    def tree(name: str, leaves: str) -> str:
        return f"""{name}(g, lvl, i, h, m) as (select g, 0, i, h, count(*) over (partition by g) from ({leaves})
  union all select g, lvl, i, h, count(*) over (partition by g) from (select g, lvl + 1 as lvl, i // 8 as i, sha256(string_agg(h, '' order by i)) as h from {name} where m > 1 group by g, lvl, i // 8)),
{name}_side as (select a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
  from {name} a join {name} b on a.g = b.g and a.lvl = b.lvl and a.i // 8 = b.i // 8 where a.m > 1 group by a.g, a.lvl, a.i)"""

    return f"""with recursive crc as (select doc_id, {_crc32_sql("doc_id::varchar")} as c from documents),
d as (select doc_id, coalesce('=' || lang, '') as g, sha256({head} || {said("text")}) as leaf, sha256({head} || {said(small)}) as lower_leaf from documents),
o as (select d.doc_id, g, leaf, case when c % 3 = 0 then lower_leaf else leaf end as told, row_number() over (partition by g order by d.doc_id) - 1 as i from d join crc using (doc_id)),
{tree("t", "select g, i, leaf as h from o")},
subroots as (select g, h, row_number() over (order by g) - 1 as i from t where m = 1),
{tree("s", "select '' as g, i, h from subroots")},
f(doc_id, g, lvl, i, h, p) as (select doc_id, g, 0, i, told, '' from o
  union all select doc_id, f.g, f.lvl + 1, f.i // 8, sha256(l || h || r), p || l || r from f join t_side using (g, lvl, i)),
low as (select doc_id, f.g, h, p from f join (select g, max(lvl) as top from t group by g) x on f.g = x.g and f.lvl = x.top),
u(doc_id, lvl, i, h, p) as (select doc_id, 0, n.i, low.h, p from low join subroots n using (g)
  union all select doc_id, u.lvl + 1, u.i // 8, sha256(l || h || r), p || l || r from u join s_side using (lvl, i)),
up as (select doc_id, h, p from u where lvl = (select max(lvl) from s))
select o.doc_id, leaf, n.h as subroot, (select h from s where m = 1) as root, sha256(p) as proof_sha256, up.h as folded_root, up.h = (select h from s where m = 1) as verified
from o join subroots n using (g) join up using (doc_id)"""


_OP12_SQL = """with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
q as (select distinct item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as term from benchmark),
g as (select count(*)::bigint as docs, sum(len(w))::bigint as terms from w where len(w) > 0),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from w) where term in (select term from q) group by doc_id, term),
df as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as weight from tf, g group by term, docs),
m as (select doc_id, 10 + (90 * len(w) * docs) // terms as m from w, g where len(w) > 0),
s as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join tf using (term) join df using (term) join m using (doc_id) group by item_id, doc_id)
select item_id, rank, doc_id, score from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) where rank <= 10"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op4_token_rollups": op4_token_rollups,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scans": op6_license_scans,
    "op7_quality": op7_quality,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scans": _op1_sql(),
    "op2_source_mixing": _OP2_SQL,
    "op5_exact_dedup": _OP5_SQL,
    "op6_license_scans": _op6_sql(),
    "op9_near_dedup": _OP9_SQL,
    "op10_decontamination": _OP10_SQL,
    "op11_merkle_manifest": _op11_sql(),
    "op12_lexical_search": _OP12_SQL,
}
