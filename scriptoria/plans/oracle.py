"""The registered queries as ANSI SQL over the same tables, written with common table expressions and set logic."""

from __future__ import annotations

from ..functions import rules, text
from ..functions.dialect import ANSI as A
from ..operators import delimited, detect, markup, profile, review, segment
from ..sources.tables import MANUAL_TEXT

#: Fixed value: a canonical name's purpose, type, topic, stem, date, digest.
CANONICAL = r"^([a-z]+)__([a-z0-9]+)__([a-z0-9-]+)__([a-z0-9-]+)__(nodate|[0-9]{8})__([0-9a-f]{8})[.]md$"

DOCS = """docs as (select doc_id, '/corpus/' || source || '/doc_' || lpad(doc_id::varchar, 6, '0') || '.txt' as source_path, 'doc_' || lpad(doc_id::varchar, 6, '0') || '.txt' as source_filename,
 source as source_folder_name, 'txt' as document_type, 'doc_' || lpad(doc_id::varchar, 6, '0') as title, text as raw_text from documents)"""
_BRAND = "regexp_replace(lower(p_brand), '[^a-z0-9]', '-', 'g')"
MANUALS = f"""docs as (select p_partkey as doc_id, '/manuals/' || {_BRAND} || '/part_' || lpad(p_partkey::varchar, 6, '0') || '.md' as source_path, 'part_' || lpad(p_partkey::varchar, 6, '0') || '.md' as source_filename,
 {_BRAND} as source_folder_name, 'md' as document_type, 'part_' || lpad(p_partkey::varchar, 6, '0') as title, {MANUAL_TEXT.format(string="varchar")} as raw_text from part)"""


def _paragraphs(heading: str, start: str) -> str:
    blocks = A.keep(A.each(A.split("raw_text", "chr(10) || chr(10)"), "p", text.stripped("p", A)), "p", "p <> ''")
    return f"""blocks as (select *, {blocks} as bs from docs),
para0 as (select * exclude (bs), unnest(bs) as text, (generate_subscripts(bs, 1) - 1)::bigint as para_idx from blocks),
para1 as (select *, trim(string_split(text, chr(10))[1]) as first from para0),
para2 as (select *, case when {A.has("first", heading)} then regexp_replace(first, '^[# ]+', '') end as own from para1),
para as (select * exclude (own, first), coalesce(last_value(own ignore nulls) over (partition by source_path order by para_idx rows between unbounded preceding and current row), {start}) as heading from para2)"""


def _chunks(corpus: str = MANUALS) -> str:
    """``chunks`` with line_list, promotion_text, n_admin, low_value."""
    return f"""{corpus}, {_paragraphs(rules.HEADING, "title")},
ch0 as (select *, para_idx as chunk_index, {text.slug("source_filename", 40, A)} || '-' || lpad(para_idx::varchar, 4, '0') as chunk_id, {text.lines("text", A)} as line_list from para),
ch1 as (select *, {rules.promotion_text("line_list", A)} as promotion_text, {rules.admin_hits("line_list", A)} as n_admin, case when {A.has("text", rules.CONTACT)} then 20 else 0 end as contact from ch0),
ch2 as (select *, {rules.bare("promotion_text", A)} as bare_text from ch1),
chunks as (select *, promotion_text = '' or 100 * n_admin + contact * len(line_list) >= 50 * len(line_list) or {rules.admin_heading("bare_text", A)} as low_value from ch2)"""


_LINES = f"""raw_lines as (select * exclude (ls), unnest(ls) as raw_line, (generate_subscripts(ls, 1) - 1)::bigint as line_no from (select *, string_split(text, chr(10)) as ls from chunks)),
lines as (select * from (select *, {text.stripped("raw_line", A)} as line from raw_lines) where line <> '')"""


def _glossary() -> str:
    patterns = (*rules.TERM_LINES, rules.ACRONYM_LINE)
    which = " ".join(f"when {A.has('line', p)} then {i}" for i, p in enumerate(patterns))
    part = lambda g: "case rule " + " ".join(f"when {i} then {A.group('line', p, g)}" for i, p in enumerate(patterns)) + " end"
    return f"""{_chunks()}, {_LINES},
g0 as (select *, case {which} end as rule from lines where not low_value),
g1 as (select *, trim({part(1)}) as term, trim({part(2)}) as body from g0 where rule is not null),
g2 as (select *, {rules.bare("term", A)} as bare_term, {text.squeezed("body", A)} as flat from g1),
g3 as (select *, {text.words("flat", A)} as n, {rules.clean_term("bare_term", A)} as clean from g2),
g4 as (select *, {rules.glossary_score("term", "bare_term", "flat", "n", A)} as raw_score from g3 where clean or rule < {len(rules.TERM_LINES)}),
glossary as (select *, case when clean then raw_score else 0 end as score, case when not clean then 'unclean_term' when raw_score < {detect.GLOSSARY_LEAST} then 'below_threshold' end as rejection_reason from g4),
best_terms as (select * from (select *, row_number() over (partition by doc_id, {text.slug("term", 100, A)} order by score desc, chunk_index, line_no) as rn from glossary where rejection_reason is null) where rn = 1)"""


def _procedures() -> str:
    return f"""{_chunks()},
p0 as (select *, {rules.usable_steps("line_list", A)} as usable, {A.size(A.keep("line_list", "l", A.has("l", rules.STEP_LINE)))} as n_steps, case when heading <> '' and heading <> title then heading else title || ' Procedure' end as proc_title from chunks where not low_value),
p1 as (select *, array_to_string(usable, ' ') as joined, {rules.imperatives("usable", A)} as hits from p0 where n_steps > 0),
p2 as (select *, {rules.procedure_score("proc_title", "heading", "usable", "joined", "hits", A)} as raw_score from p1),
p3 as (select *, case when len(usable) < 2 then 'insufficient_usable_steps' when hits = 0 and not {A.has("proc_title", rules.PROCEDURE_WORDS)} then 'weak_procedural_signal' when raw_score < {detect.PROCEDURE_LEAST} then 'below_threshold' end as rejection_reason from p2),
procs as (select *, case when rejection_reason is null or rejection_reason = 'below_threshold' then raw_score else 0 end as score, array_to_string(list_transform(usable, lambda s, i: i || '. ' || s), chr(10)) as steps_text from p3)"""


def _facts(corpus: str = MANUALS) -> str:
    return f"""{_chunks(corpus)},
f0 as (select doc_id, source_filename, chunk_id, chunk_index, flatten({A.each("line_list", "x", text.sentences("x", A))}) as ss from chunks),
f1 as (select * exclude (ss), unnest(ss) as sentence, generate_subscripts(ss, 1) as sentence_idx from f0),
f2 as (select *, {rules.fact_sentence("sentence", A)} as body from f1 where {A.has("sentence", rules.FACT_SIGNAL)}),
f3 as (select *, {text.words("body", A)} as n, {rules.atomic_fact("body", A)} as atomic, {rules.fact_category("body", A)} as category from f2),
f4 as (select *, case when atomic then {rules.fact_score("body", "n", A)} else 0 end as score from f3),
facts as (select *, case when not atomic then 'non_atomic_fact' when score < {detect.FACT_LEAST} then 'below_threshold' end as rejection_reason from f4),
best_facts as (select * from (select *, row_number() over (partition by doc_id, {text.slug("body", 220, A)} order by score desc, chunk_index, sentence_idx) as rn from facts where rejection_reason is null) where rn = 1)"""


def _reference_facts(corpus: str) -> str:
    return f"""with {_facts(corpus)},
keyed as (select *, lower({text.squeezed("body", A)}) as key from best_facts),
wording as (select category, key, body from (select *, row_number() over (partition by category, key order by score desc, doc_id, body) as w from keyed) where w = 1),
merged as (select category, key, max(score) as score, count(distinct source_filename) as n_sources, string_agg(distinct source_filename, ', ' order by source_filename) as sources from keyed group by category, key),
ranked as (select category, body as text, score, n_sources, sources, row_number() over (partition by category order by n_sources desc, score desc, lower(body), body) as rank from merged join wording using (category, key))
select category, rank, text, score, n_sources, sources from ranked where rank <= 120"""


def _topics() -> str:
    words = rules.topic_words("promotion_text", A)
    return f"""{_chunks()},
t0 as (select *, {words} as tw, {rules.bare("heading", A)} as bare_heading from chunks),
counted as (select doc_id, chunk_index, w, count(*) as c from (select doc_id, chunk_index, unnest(tw) as w from t0) group by all),
ranked_terms as (select doc_id, chunk_index, list(w order by c desc, length(w) desc, w) as terms from counted group by all),
t1 as (select t0.*, coalesce(terms, [])[1:3] as terms from t0 left join ranked_terms using (doc_id, chunk_index)),
t2 as (select *, array_to_string(terms, ' ') as joined_terms, {text.words("promotion_text", A)} as n from t1),
t3 as (select *, case when heading <> '' and heading <> title and not regexp_matches(heading, '^[0-9]+$') and not {rules.admin_heading("bare_heading", A)} then heading when len(terms) > 0 then {text.title_case("joined_terms", A)} else title end as topic_label, {text.squeezed("promotion_text", A)} as flat from t2 where low_value or n >= 8),
t4 as (select *, {rules.bare("topic_label", A)} as bare_label, {rules.topic_score("flat", "n", "heading", "title", "len(terms) >= 2", A)} as raw_score, {text.slug("topic_label", 80, A)} as topic_key from t3),
t5 as (select *, case when low_value then 'admin_boilerplate' when {rules.admin_heading("bare_label", A)} and n < 12 then 'weak_sheet_anchor' when raw_score < {detect.TOPIC_LEAST} then 'below_threshold' end as rejection_reason from t4),
topics as (select *, case when rejection_reason is null or rejection_reason = 'below_threshold' then raw_score else 0 end as score from t5),
accepted as (select * from topics where rejection_reason is null)"""


def _entities() -> str:
    codes = ", ".join(A.text(b) for b in detect.STANDARD_BODIES)
    s = "bare_value"
    real = (
        f"{s} <> '' and length({s}) >= 3 and not upper({s}) in ({', '.join(A.text(w) for w in detect.ENTITY_STOP)}) and not lower({s}) in ({', '.join(A.text(w) for w in rules.GENERIC_NOTES)})"
        f" and not {rules.admin_heading(s, A)} and not ({text.is_upper(s)} and {text.tokens(s, A)} > 2) and not ({A.has(s, '^[A-Z]{1,4}$')} and {s} not in ({codes})) and not {A.has(s, rf'(?i)^[0-9]+(?:[.][0-9]+)?[ ]?(?:{rules.UNITS}|%)$')}"
    )
    return f"""{MANUALS},
e0 as (select *, {text.lines("raw_text", A)} as line_list from docs),
e1 as (select doc_id, source_filename, title, {A.groups("raw_text", detect.STANDARD, 1)} as st, {A.groups("raw_text", detect.ORGANIZATION, 1)} as og, {A.groups("raw_text", detect.PART_ID, 1)} as pt from e0 where not {rules.admin_at_least("raw_text", "line_list", 70, A)}),
e2 as (select doc_id, source_filename, 0 as k, 'standard' as entity_type, unnest(st) as value, generate_subscripts(st, 1) as i from e1
 union all select doc_id, source_filename, 1, 'organization', o, i from (select *, unnest(og) as o, generate_subscripts(og, 1) as i from e1) where not list_contains(list_transform(st, lambda x: contains(x, o)), true)
 union all select doc_id, source_filename, 2, 'product', unnest(pt), generate_subscripts(pt, 1) from e1
 union all select doc_id, source_filename, 3, 'document', v, 0 from (select *, {A.group("title", detect.NAMED_TITLE, 1)} as v from e1) where v <> '' and lower(v) not in ('entities', 'entity', 'drawing', 'topic', 'notes', 'general notes', 'title page') and not lower(v) like 'entity %'),
e3 as (select * from (select *, {rules.bare("trim(value)", A)} as bare_value from e2) where {real}),
e4 as (select *, {text.slug("entity_type || '-' || trim(value)", 180, A)} as normalized_key from e3),
entities as (select doc_id, source_filename, entity_type, trim(value) as value, normalized_key, k, i from (select *, row_number() over (partition by doc_id, normalized_key order by k, i) as rn from e4) where rn = 1)"""


def _measured(corpus: str) -> str:
    columns = ", ".join(f"{sql} as {name}" for name, sql in profile.measures("t", "ls", A).items())
    return f"""{corpus}, m0 as (select *, coalesce(raw_text, '') as t from docs), m1 as (select *, {text.lines("t", A)} as ls, lower(t) as low from m0), m2 as (select *, {columns} from m1),
measured as (select *, cast(floor({profile.score_sql()} * 1000 + 0.5e0) as bigint) as quality_score from m2)"""


def _documents() -> str:
    """``drows`` as the review workflow reads them, and ``queue`` over them."""
    long_sentences = A.size(A.keep(text.sentences("raw_text", A), "s", f"{text.words('s', A)} >= 8"))
    domain = profile.first_label("source_path || ' ' || lower(title) || ' ' || lower(substr(raw_text, 1, 600))", profile.PROJECT_DOMAINS, A)
    return f"""{DOCS},
d0 as (select *, coalesce({text.words("raw_text", A)}, 0) as word_count, coalesce({long_sentences}, 0) as knowledge_item_count, {domain} as probable_domain, min(source_path) over (partition by coalesce(raw_text, '')) as canonical from docs),
drows as (select *, case when raw_text is null then 'failed' when word_count > 0 and word_count < 25 then 'partial' else 'success' end as extraction_status, case when source_path <> canonical then canonical end as duplicate_of from d0),
queue as (
 select doc_id, source_path, 'duplicate' as kind, 'high' as severity, 'Possible duplicate document' as title, 'Near-duplicate of ' || string_split(duplicate_of, '/')[-1] as detail, 0.3::double as confidence from drows where duplicate_of is not null
 union all select doc_id, source_path, 'extraction_issue', case extraction_status when 'failed' then 'high' else 'medium' end, 'Extraction requires review', 'Extraction status: ' || extraction_status, case extraction_status when 'partial' then 0.35 else 0.2 end from drows where extraction_status in ('failed', 'partial')
 union all select doc_id, source_path, 'empty', 'high', 'Document produced no usable knowledge', 'Extraction status: ' || extraction_status, 0.15 from drows where word_count = 0
 union all select doc_id, source_path, 'low_signal', 'medium', 'Low-signal document', word_count || ' words remained', 0.45 from drows where word_count between 1 and {review.LOW_SIGNAL_WORDS - 1} and extraction_status <> 'failed'
 union all select doc_id, source_path, 'taxonomy', 'low', 'Weak classification signal', 'No domain found', 0.5 from drows where probable_domain = 'general' and knowledge_item_count <= 1 and word_count > 0),
refused as (select *, case when kind = 'duplicate' then 'rejected' else 'open' end as status from queue)"""


_SNAPSHOTS = f"""{DOCS},
old as (select source_path, sha256(coalesce(raw_text, '')) as checksum from docs where doc_id % 10 <> 0),
new as (select source_path, sha256(coalesce(case when doc_id % 7 = 0 then raw_text || ' Revised.' else raw_text end, '')) as checksum from docs where doc_id % 10 <> 1)"""


def _in_order(column: str, order: tuple[str, ...]) -> str:
    return f"case {column} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(order)) + " else 9 end"


_FILE = "lower(string_split(source_path, '/')[-1])"
_PRIORITY = f"{_in_order('status', review.STATUS_ORDER)}, {_in_order('extraction_status', review.EXTRACTION_ORDER)}, {_in_order('kind', review.KIND_ORDER)}, {_in_order('severity', review.SEVERITY_ORDER)}, {_FILE}"
_TIES = f"source_path, {_in_order('kind', review.QUEUE_KINDS)}"
_SORTED = {"priority": _PRIORITY, "file": _FILE, "kind": "kind desc", "severity": f"{_in_order('severity', review.SEVERITY_ORDER)} desc", "status": f"{_in_order('status', review.STATUS_ORDER)} desc"}


def _filters() -> str:
    parts = []
    for name, (statuses, kinds) in review.FILTERS.items():
        rules_ = [f"{column} in ({', '.join(map(repr, values))})" for column, values in (("status", statuses), ("kind", kinds)) if values]
        parts.append(f"select '{name}' as filter from refused where {' and '.join(rules_) or 'true'}")
    return f"with {_documents()} select filter, count(*) as n from ({' union all '.join(parts)}) group by filter"


def _added(whole: str, first: str) -> str:
    """What a list of table expressions adds to the chunks that it starts with."""
    return whole[whole.index(f"{first} as (") :]


_SUMMARY = f"""sc as (select *, {text.sentences("replace(text, chr(10), ' ')", A)}[1] as lead from chunks),
spts as (select doc_id, chunk_index, 0 as sub, heading as point from sc where heading <> '' and heading <> title union all select doc_id, chunk_index, 1, lead from sc where {text.words("lead", A)} between 8 and 35),
staken as (select *, {text.slug("point", 220, A)} as key from (select *, (select count(*) from spts q where q.doc_id = spts.doc_id and q.chunk_index < spts.chunk_index) as earlier from spts) where earlier < 6),
sfirst as (select *, row_number() over (partition by doc_id, key order by chunk_index, sub) as k from staken),
srank as (select * from (select doc_id, row_number() over (partition by doc_id order by chunk_index, sub) as rank, point from sfirst where k = 1) where rank <= 6)"""
_WARN = f"""ws as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as i from (select *, {text.sentences("raw_text", A)} as ss from docs)), ww as (select *, {text.slug("sentence", 220, A)} as key from ws where {A.has("sentence", detect.WARNING_WORD)}),
wf as (select doc_id, min(i) as i from ww group by doc_id, key), wrank as (select wf.doc_id, row_number() over (partition by wf.doc_id order by wf.i) as rank, sentence from wf join ww on wf.doc_id = ww.doc_id and wf.i = ww.i)"""
_TOPIC_OF_PATH = "case when regexp_matches(source_path, 'brand-1') then 'installation' when regexp_matches(source_path, '/brand-2[^/]*/') then 'maintenance' else 'service' end"
_CACHE_KEY = "sha256(concat_ws('|', {checksum}, 'none', 'none', '1'))"


def _fallback_points() -> str:
    return f"""with {_facts()}, {_SUMMARY}, {_WARN},
fp as (select doc_id, 0 as part, rank, point as value from srank union all select * from (select doc_id, 1, row_number() over (partition by doc_id order by chunk_index, sentence_idx) as rank, body from best_facts) where rank <= 3
 union all select doc_id, 2, rank, sentence from wrank where rank <= 2),
fl as (select *, {text.lines("value", A)} as ls from fp), fc as (select *, {rules.promotion_text("ls", A)} as clean from fl), fb as (select *, {rules.bare("clean", A)} as bare from fc),
fk as (select *, {text.slug("clean", 220, A)} as key from fb where clean <> '' and not {rules.admin_at_least("value", "ls", 50, A)} and not {rules.admin_heading("bare", A)} and {text.words("clean", A)} >= 4),
fo as (select *, row_number() over (partition by doc_id, key order by part, rank) as k from fk)
select * from (select doc_id, row_number() over (partition by doc_id order by part, rank) as place, clean as point from fo where k = 1) where place <= 5"""


def _enriched() -> str:
    domain = profile.first_label("source_path || ' ' || lower(title) || ' ' || lower(substr(raw_text, 1, 600))", profile.PROJECT_DOMAINS, A)
    return f"""with {_topics()}, {_added(_glossary(), "raw_lines")}, {_SUMMARY}, {_WARN},
pl as (select doc_id, list(point order by rank) as points from srank where rank <= 3 group by doc_id),
tl as (select doc_id, list(term order by score desc, lower(term), term)[1:8] as terms from best_terms group by doc_id),
ll as (select doc_id, topic_label as label from (select *, row_number() over (partition by doc_id order by score desc, chunk_index, topic_label) as k from accepted) where k = 1),
nl as (select doc_id, list(sentence order by rank) as notes from wrank where rank <= 4 group by doc_id),
ruled as (select doc_id, coalesce(regexp_replace(substr(points[1], 1, 80), '[.]+$', ''), trim(title)) as clean_title, {domain} as domain, coalesce(substr(label, 1, 60), substr(terms[1], 1, 60), 'general') as topic,
 coalesce(trim(array_to_string(points, ' ')), '') as synopsis, coalesce(array_to_string(terms, '|'), '') as glossary_hints, coalesce(array_to_string(notes, '|'), '') as review_notes from docs left join pl using (doc_id) left join tl using (doc_id) left join ll using (doc_id) left join nl using (doc_id))
select doc_id, clean_title, case when p_partkey is null then domain else 'hardware' end as domain, coalesce(nullif(trim(p_name), ''), topic) as topic, synopsis, glossary_hints, review_notes,
 case when p_partkey is null or p_size <= 25 then 55 else 100 end::bigint as confidence, case when p_partkey is null then 'deterministic' else 'model' end as mode from ruled left join (select * from part where p_type like '%LARGE%') on p_partkey = doc_id"""


def _quality_report() -> str:
    return f"""with {_facts()}, {_added(_glossary(), "raw_lines")}, {_added(_procedures(), "p0")}, {_added(_topics(), "t0")},
every as (select 'glossary' as t, {text.slug("term", 100, A)} as key, rejection_reason as r from glossary union all select 'procedures', lower(proc_title), rejection_reason from procs
 union all select 'reference_facts', {text.slug("body", 220, A)}, rejection_reason from facts union all select 'knowledge_core', topic_key, rejection_reason from topics),
a as (select count(*) filter (r is null and t = 'glossary') as glossary_kept, count(*) filter (r is null and t = 'procedures') as procedures_kept, count(*) filter (r is null and t = 'reference_facts') as reference_facts_kept,
 count(*) filter (r is null and t = 'knowledge_core') as knowledge_core_kept, count(*) filter (r is null) as accepted, count(*) filter (r is not null) as rejected, count(distinct t || '::' || key) filter (r is null) as n_keys from every)
select * exclude (n_keys), (select count(*) from docs) as documents, (select count(*) from docs where coalesce(trim(raw_text), '') = '') as empty_documents, (select count(*) from chunks) as n_chunks,
 case when accepted > 0 then floor((accepted - n_keys) * 1000 / accepted::double + 0.5) else 0 end::bigint as dedupe_thousandths from a"""


def _top(source: str, order: str, columns: str) -> str:
    return f"with {source} select row_number() over (order by {order}) as place, {columns} order by {order} limit 50"


_MARKDOWN = f"""with {MANUALS}, m as (select *, {_TOPIC_OF_PATH} as topic, coalesce({text.found_date("raw_text", A)}, 'nodate') as day,
 regexp_replace(regexp_replace(regexp_replace(raw_text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as body,
 trim({A.sub("translate(title, '-_', '  ')", text.SPACE + "+", " ")}) as shown from docs),
c as (select doc_id, '# ' || coalesce(nullif(shown, ''), 'Knowledge File') || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '- Source file: ' || source_filename || chr(10) || '- Source path: ' || source_path || chr(10) || '- Document type: ' || document_type
 || chr(10) || '- Knowledge set: reference' || chr(10) || '- Topic: ' || topic || case when day <> 'nodate' then chr(10) || '- Document date: ' || day else '' end || chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || {text.stripped("body", A)} || chr(10) as content from m)
select doc_id, strlen(content) as n_bytes, sha256(content) as digest from c"""


_PLAIN = "'[^ \\t\\n\\r\\f]+'"

_CELL_SPACE = A.text(delimited.CELL_SPACE)

ORACLE_SQL: dict[str, str] = {
    "reference_facts": _reference_facts(DOCS),
    "manual_reference_facts": _reference_facts(MANUALS),
    "word_count_by_source": f"select source, count(*) as n_docs, sum({text.words('text', A)})::bigint as n_words from documents group by source",
    "sentence_split": f"""with s as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as i from (select doc_id, {text.sentences("text", A)} as ss from documents))
select doc_id, count(*) as n_sentences, sum({text.words("sentence", A)})::bigint as n_words, max(length(sentence)) as longest, min_by(sentence, i) as first_sentence from s group by doc_id""",
    "doc_date_detect": f"with {MANUALS} select doc_id, coalesce({text.found_date('raw_text', A)}, {text.found_date('source_filename', A)}, 'nodate') as doc_date from docs",
    "canonical_name": f"""with {MANUALS}, t as (select *, case when regexp_matches(source_path, 'brand-1') then 'installation' when regexp_matches(source_path, '/brand-2[^/]*/') then 'maintenance' else 'service' end as topic from docs)
select doc_id, topic, 'reference__md__' || topic || '__' || {text.slug("title", 50, A)} || '__' || coalesce({text.found_date("raw_text", A)}, 'nodate') || '__' || substr(sha256(raw_text), 1, 8) || '.md' as canonical_name from t""",
    "doc_profile_ratios": f"with {_measured(DOCS)} select doc_id, {', '.join(profile.measures('x', 'y'))}, quality_score, n_table_lines > 0.2 * greatest(n_lines, 1) as mostly_tabular from measured",
    "quality_flags": f"with {_measured(DOCS)} select flag, count(*) as n_docs from (" + " union all ".join(f"select '{name}' as flag from measured where {rule}" for name, rule in profile.FLAGS.items()) + ") group by flag",
    "infer_domain_kind": f"""with {_measured(MANUALS)}, labels as (select {profile.first_label("low", profile.DOMAINS, A)} as probable_domain, {profile.document_kind("low", "document_type", A)} as document_kind,
 {profile.first_label("source_path || ' ' || lower(title) || ' ' || lower(substr(raw_text, 1, 600))", profile.PROJECT_DOMAINS, A)} as project_domain, quality_score from measured)
select probable_domain, document_kind, project_domain, count(*) as n_docs, sum(quality_score)::bigint as score_sum from labels group by all""",
    "type_counts": """with f as (select 'txt' as document_type, strlen(text) as b from documents union all select 'html', strlen(html) from pages union all select 'log', strlen(text) from conversations union all select 'json', strlen(props) from events)
select document_type, count(*) as n_files, sum(b)::bigint as size_bytes, max(b)::bigint as largest from f group by document_type""",
    "workload_forecast": """with f as (select source, count(*) as n_files, sum(strlen(text))::bigint as size_bytes, count(*) filter (strlen(text) >= 5242880) as n_heavy from documents group by source)
select source as source_folder_name, n_files, size_bytes, n_heavy, 0::bigint as n_ocr, case when n_files >= 250 or n_heavy >= 15 then 'heavy' when n_files >= 50 or n_heavy >= 3 then 'moderate' else 'light' end as workload from f""",
    "paragraph_chunks": f"with {_chunks()} select doc_id, chunk_index, chunk_id, heading, text, promotion_text, n_admin, low_value from chunks",
    "heading_fill": f"with {MANUALS}, {_paragraphs(segment.SECTION_HEADING, chr(39) * 2)} select doc_id, para_idx, heading as section from para",
    "chunk_flags": f"""with {MANUALS}, {_paragraphs(rules.HEADING, "title")}, f as (select contains(text, ' | ') or contains(text, chr(9)) as contains_table, {A.has("text", text.bounded("shall|must|required"))} as contains_requirements,
 {A.has("text", text.bounded("means|defined as"))} as contains_definitions, {A.has("text", text.bounded("PN|P/N|Part|Model|SKU"))} as contains_parts from para) select *, count(*) as n_chunks from f group by all""",
    "preview_units": f"""with w as (select doc_id, text, regexp_extract_all(text, {_PLAIN}) as w from documents), u as (select *, unnest(range(0, len(w), {segment.PREVIEW_WORDS})) as i from w)
select doc_id, (i // {segment.PREVIEW_WORDS})::bigint as unit, case when len(w) <= {segment.PREVIEW_WORDS} then {text.stripped("text", A)} else array_to_string(w[i + 1:i + {segment.PREVIEW_WORDS}], ' ') end as excerpt from u""",
    "definitions": f"with {_chunks()}, {_LINES} select doc_id, chunk_index, line_no as item, trim({A.group('line', detect.DEFINITION, 1)}) as term, trim({A.group('line', detect.DEFINITION, 2)}) as definition from lines where {A.has('line', detect.DEFINITION)}",
    "requirements": f"""with {_chunks()}, s as (select doc_id, chunk_index, unnest(ss) as requirement_text, (generate_subscripts(ss, 1) - 1)::bigint as item from (select *, {text.sentences("text", A)} as ss from chunks))
select doc_id, chunk_index, item, requirement_text, lower({A.group("requirement_text", detect.REQUIREMENT, 1)}) as requirement_type from s where {A.has("requirement_text", detect.REQUIREMENT)}""",
    "warnings": f"with {_chunks()}, {_LINES} select doc_id, chunk_index, line_no as item, lower({A.group('line', detect.WARNING, 1)}) as warning_type, trim({A.group('line', detect.WARNING, 2)}) as warning_text from lines where {A.has('line', detect.WARNING)}",
    "parts": f"""with {_chunks()}, s as (select doc_id, chunk_index, text, string_split_regex(text, {A.text(detect.PART_ID)}) as gaps, {A.groups("text", detect.PART_ID, 0)} as ms, {A.groups("text", detect.PART_ID, 1)} as ps from chunks),
u as (select *, unnest(range(1, len(ms) + 1)) as i from s),
v as (select doc_id, chunk_index, text, ps[i] as part_number, (i - 1)::bigint as item, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + case when regexp_matches(ms[i], '^[^A-Za-z0-9_]') then 1 else 0 end)::bigint as st from u)
select doc_id, chunk_index, part_number, min(item) as item, arg_min({text.stripped(f"substr(text, greatest(st - {detect.CONTEXT_CHARS}, 0) + 1, least(st, {detect.CONTEXT_CHARS}) + {detect.CONTEXT_CHARS})", A)}, item) as description from v group by doc_id, chunk_index, part_number""",
    "specs": f"""with {_chunks()}, s as (select doc_id, chunk_index, text, string_split_regex(text, {A.text(detect.SPEC)}) as gaps, {A.groups("text", detect.SPEC, 0)} as ms, {A.groups("text", detect.SPEC, 1)} as a, {A.groups("text", detect.SPEC, 2)} as b, {A.groups("text", detect.SPEC, 3)} as c from chunks),
u as (select *, unnest(range(1, len(ms) + 1)) as i from s),
v as (select *, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + case when regexp_matches(ms[i], '^[^A-Za-z0-9_]') then 1 else 0 end)::bigint as st from u)
select doc_id, chunk_index, (i - 1)::bigint as item, trim(a[i]) as parameter, b[i] as value, c[i] as unit, {text.stripped(f"substr(text, greatest(st - {detect.CONTEXT_CHARS}, 0) + 1, least(st, {detect.CONTEXT_CHARS}) + {detect.CONTEXT_CHARS})", A)} as context from v""",
    "procedure_steps": f"with {_chunks()}, {_LINES} select doc_id, chunk_index, line_no as item, line as step_text from lines where regexp_matches(line, '^[0-9]+[.)][ \\t]+')",
    "table_lines": f"with {_chunks()}, s as (select doc_id, chunk_index, list_filter(line_list, lambda l: contains(l, ' | ')) as ls from chunks) select doc_id, chunk_index, array_to_string(ls, chr(10)) as table_text from s where len(ls) > 0",
    "glossary": f"with {_glossary()} select doc_id, chunk_id, heading, term, body, score from best_terms",
    "glossary_rejected": f"with {_glossary()} select doc_id, chunk_id, line_no, term, body, score, rejection_reason from glossary where rejection_reason is not null",
    "corpus_glossary": f"""with {_glossary()}, r as (select *, row_number() over (partition by term order by doc_id, -score, body, source_filename) as r, count(*) over (partition by term) as n_docs from best_terms)
select term, body as definition, source_filename, n_docs from r where r = 1""",
    "procedures": f"""with {_procedures()}, r as (select *, row_number() over (partition by lower(proc_title), steps_text order by doc_id, chunk_index) as r, max(score) over (partition by lower(proc_title), steps_text) as best, count(*) over (partition by lower(proc_title), steps_text) as n_found from procs where rejection_reason is null)
select proc_title as title, steps_text, source_filename, best as score, n_found from r where r = 1""",
    "procedures_rejected": f"with {_procedures()} select doc_id, chunk_id, proc_title as title, steps_text, score, rejection_reason from procs where rejection_reason is not null",
    "facts": f"with {_facts()} select doc_id, chunk_id, category, body, score from best_facts",
    "facts_rejected": f"with {_facts()} select rejection_reason, category, count(*) as n, sum(score)::bigint as score_sum, count(distinct body) as n_bodies from facts where rejection_reason is not null group by rejection_reason, category",
    "topics": f"with {_topics()} select doc_id, chunk_id, topic_key, topic_label, promotion_text as body, score, rejection_reason from topics",
    "topic_groups": f"with {_topics()} select topic_key, arg_min(topic_label, (doc_id, chunk_index)) as label, count(*) as n_candidates, count(distinct source_filename) as n_sources, (sum(score) + 250 * count(distinct source_filename))::bigint as group_score from accepted group by topic_key",
    "topic_selection": f"""with {_topics()}, o as (select *, row_number() over (partition by topic_key order by score desc, lower(source_filename), doc_id, chunk_index) as o from accepted),
s as (select *, min(o) over (partition by topic_key, source_filename) = o as leads from o), p as (select *, row_number() over (partition by topic_key order by not leads, o) as pick from s)
select topic_key, doc_id, chunk_index, score, pick from p where pick <= 5""",
    "topic_terms": f"""with w as (select doc_id, unnest({rules.topic_words("text", A)}) as term from documents), c as (select doc_id, term, count(*) as n from w group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, length(term) desc, term) as rank from c) select doc_id, term, n, rank from r where rank <= 3""",
    "entities": f"with {_entities()} select doc_id, entity_type, value, normalized_key from entities",
    "entities_by_type": f"with {_entities()}, r as (select *, row_number() over (partition by entity_type, normalized_key order by doc_id, k, i) as r, count(distinct doc_id) over (partition by entity_type, normalized_key) as n from entities) select entity_type, value, source_filename, n as n_docs from r where r = 1",
    "warning_sentences": f"""with {MANUALS}, s as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as i from (select *, {text.sentences("raw_text", A)} as ss from docs)), w as (select *, {text.slug("sentence", 220, A)} as key from s where {A.has("sentence", detect.WARNING_WORD)}),
f as (select doc_id, min(i) as i from w group by doc_id, key), r as (select f.doc_id, row_number() over (partition by f.doc_id order by f.i) as rank, sentence from f join w on f.doc_id = w.doc_id and f.i = w.i) select doc_id, rank, sentence from r where rank <= 200""",
    "summaries": f"""with {_chunks(DOCS)}, c as (select *, {text.sentences("replace(text, chr(10), ' ')", A)}[1] as lead from chunks),
pts as (select doc_id, chunk_index, 0 as sub, heading as point from c where heading <> '' and heading <> title union all select doc_id, chunk_index, 1, lead from c where {text.words("lead", A)} between 8 and 35),
taken as (select *, {text.slug("point", 220, A)} as key from (select *, (select count(*) from pts q where q.doc_id = pts.doc_id and q.chunk_index < pts.chunk_index) as earlier from pts) where earlier < 6),
f as (select *, row_number() over (partition by doc_id, key order by chunk_index, sub) as k from taken), r as (select doc_id, row_number() over (partition by doc_id order by chunk_index, sub) as rank, point from f where k = 1) select * from r where rank <= 6""",
    "repeated_edge_lines": f"""with l as (select conv_id, {text.lines("text", A)} as ls from conversations), e as (select conv_id, unnest(list_concat(ls[1:2], ls[-2:])) as line from l where len(ls) > 0),
n as (select conv_id, line, count(*) as n from e where length(line) between 3 and 120 group by all), c as (select conv_id, greatest(2, floor(count(*) / 3)) as least from conversations group by conv_id) select conv_id, line, n from n join c using (conv_id) where n >= least""",
    "html_title": r"select page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r\f]+', ' ', 'g')) as title from pages",
    "cell_text": f"""select doc_id, case when doc_id % 2 = 0 then 'csv' else 'tsv' end as document_type,
'source | lang | text' || chr(10) || trim(coalesce(source, ''), {_CELL_SPACE}) || ' | ' || trim(coalesce(lang, ''), {_CELL_SPACE}) || ' | ' || trim(coalesce(text, ''), {_CELL_SPACE}) as text from documents""",
    "json_status": "select event_type, case when json_valid(props) then 'success' else 'partial' end as status, count(*) as n from events group by all",
    "exact_duplicates": f"with {DOCS}, g as (select doc_id, source_path, min(source_path) over (partition by coalesce(raw_text, '')) as canonical, count(*) over (partition by coalesce(raw_text, '')) as group_size from docs) select * from g where group_size > 1",
    "review_queue": f"with {_documents()} select doc_id || '::' || kind as review_id, source_path, kind, severity, 'open' as status, title, detail, confidence from queue",
    "review_priority": f"""with {_documents()} select refused.doc_id || '::' || kind as review_id, kind, severity, status, source_path from refused join (select source_path, extraction_status from drows) using (source_path) order by {_PRIORITY}, {_TIES} limit 20""",
    "review_sorted": f"with {_documents()}, q as (select refused.*, extraction_status from refused join (select source_path, extraction_status from drows) using (source_path)) "
    + " union all ".join(f"select * from (select '{by}' as sorted_by, doc_id || '::' || kind as review_id from q order by {order}, {_TIES} limit 10)" for by, order in _SORTED.items()),
    "review_filters": _filters(),
    "review_actions": f"""with {_documents()}, q as (select refused.*, extraction_status from refused join (select source_path, extraction_status from drows) using (source_path))
select doc_id || '::' || kind as review_id, case when kind in ('extraction_issue', 'empty') or extraction_status in ('failed', 'unsupported') then 'retry_then_ignore' when kind = 'duplicate' then 'keep_stronger_copy' when kind = 'taxonomy' then 'override_then_accept'
 when kind in ('ocr', 'ai_low_confidence') then 'inspect_then_accept_or_retry' when kind = 'low_signal' then 'keep_if_useful' else 'accept_or_ignore' end as action,
 concat_ws(',', case severity when 'high' then 'sev_high' when 'medium' then 'sev_medium' end, case status when 'accepted' then 'status_accepted' when 'rejected' then 'status_rejected' end, case when kind in ('extraction_issue', 'empty') then 'kind_extraction' end) as tags from q""",
    "review_overrides": f"""with {_documents()}, k as (select doc_id, bool_or(kind = 'taxonomy') as tax, bool_or(kind = 'low_signal') as low, bool_or(kind not in ('taxonomy', 'low_signal')) as other from queue group by doc_id),
o as (select drows.*, tax, low, other, 'Area of ' || source_folder_name as area, string_split(source_filename, '.')[1] as stem from drows left join k using (doc_id))
select doc_id, case when low then 'Short: ' || stem else stem end as title, case when tax then replace({text.slug("area", 40, A)}, '-', '_') else probable_domain end as probable_domain, case when low then 'rejected' when other then 'flagged' else 'clean' end as review_status from o""",
    "fallback_points": _fallback_points(),
    "enriched": _enriched(),
    "enrichment_to_ask": f"""with {_SNAPSHOTS}, a as (select source_path, {_CACHE_KEY.format(checksum="checksum")} as cache_key from new), b as (select {_CACHE_KEY.format(checksum="checksum")} as cache_key from old)
select min(source_path) as source_path, cache_key from a where cache_key not in (select cache_key from b) group by cache_key""",
    "quality_report": _quality_report(),
    "glossary_order": _top(_glossary(), "score desc, lower(term), doc_id", "doc_id, term, score from best_terms"),
    "procedures_order": _top(_procedures() + ", r as (select *, row_number() over (partition by lower(proc_title), steps_text order by doc_id, chunk_index) as r, max(score) over (partition by lower(proc_title), steps_text) as best from procs where rejection_reason is null), one as (select proc_title as title, source_filename, best as score, steps_text from r where r = 1)", "score desc, lower(title), lower(source_filename), steps_text", "title, source_filename, score from one"),
    "topics_order": _top(_topics() + ", g as (select topic_key, arg_min(topic_label, (doc_id, chunk_index)) as label, count(*) as n_candidates, (sum(score) + 250 * count(distinct source_filename))::bigint as group_score from accepted group by topic_key)", "group_score desc, n_candidates desc, lower(label), topic_key", "topic_key, label, group_score from g"),
    "record_columns": f"""with {_chunks()}, {_LINES}, s as (select unnest(ss) as x from (select {text.sentences("text", A)} as ss from chunks)),
k as (select 'definitions' as kind, count(*) as n from lines where {A.has("line", detect.DEFINITION)} union all select 'requirements', count(*) from s where {A.has("x", detect.REQUIREMENT)} union all select 'warnings', count(*) from lines where {A.has("line", detect.WARNING)})
select kind, n, """ + ", ".join(f"case kind when '{kind}' then n else 0 end as n_{c}" for kind, cs in (("definitions", ("term", "definition")), ("requirements", ("requirement_text", "requirement_type")), ("warnings", ("warning_type", "warning_text"))) for c in cs) + " from k where n > 0",
    "rendered_markdown": _MARKDOWN,
    "corpus_names": f"with {MANUALS} select distinct source_folder_name, replace({text.slug('source_folder_name', 80, A)}, '-', '_') as corpus_name from docs",
    "low_quality_pages": f"""with p as (select len(regexp_extract_all(html, '<a ')) > len(regexp_extract_all(html, '<p')) as image_heavy, array_to_string({markup.pieces("html", A)}, chr(10)) as shown from pages),
q as (select image_heavy, length(shown) as n, length(trim(shown)) as t, len(regexp_extract_all(shown, '\\p{{L}}')) as l from p)
select image_heavy, t = 0 or (image_heavy and (t < 40 or l < greatest(10.0, t * 0.2))) as low_quality, count(*) as n_pages, sum(n)::bigint as n_chars from q group by all""",
    "html_text": f"""with p as (select page_id, array_to_string({markup.pieces("coalesce(html, '')", A)}, chr(10)) as shown, {markup.raw_title("coalesce(html, '')", A)} as t from pages)
select page_id, nullif(trim({A.sub(markup.resolved("t", A), text.SPACE + "+", " ")}), '') as title, {markup.resolved("shown", A)} as text from p""",
    "degraded_documents": f"with {_documents()} select source_path, extraction_status as status, 'Extraction finished with status ' || extraction_status || '.' as reason, document_type, coalesce(duplicate_of, '') as duplicate_of from drows where extraction_status <> 'success' or duplicate_of is not null",
    "scan_report": f"""with {_documents()} select 'type:' || document_type as metric, count(*) as n from drows group by document_type union all select 'documents', count(*) from drows
union all select s || '_docs', (select count(*) from drows where extraction_status = s) from (values ('partial'), ('failed'), ('metadata_only'), ('unsupported')) v(s) union all select 'duplicates', count(duplicate_of) from drows union all select 'open_reviews', count(*) from refused where status = 'open'""",
    "recent_issues": f"""with {_documents()}, i as (select 0 as part, source_path, 0 as k, case when extraction_status <> 'success' then extraction_status else 'duplicate' end as status, case when extraction_status <> 'success' then 'Extraction finished with status ' || extraction_status || '.'
 else 'Near-duplicate of ' || string_split(duplicate_of, '/')[-1] || '.' end as reason from drows where extraction_status <> 'success' or duplicate_of is not null
 union all select 1, source_path, {_in_order("kind", review.QUEUE_KINDS)}, kind, title from refused where status = 'open')
select row_number() over (order by part, source_path, k) as place, source_path, status, reason from i order by part, source_path, k limit 12""",
    "batch_summary": f"""with {_documents()}, f as (select source_folder_name as corpus, count(*) as p, count(*) filter (word_count > 0 and extraction_status <> 'failed') as c, count(*) filter (extraction_status = 'failed') as x, source_folder_name = (select min(source_folder_name) from drows) as skipped from drows group by 1)
select corpus, case when skipped then 'SKIPPED' when c > 0 then 'SUCCESS' else 'FAILED' end as status, case when skipped then 0 else p end as processed, case when skipped then 0 else c end as contributed, case when skipped then 0 else x end as failed from f""",
    "promoted_duplicates": f"with {DOCS}, g as (select source_path, max(source_path) over (partition by coalesce(raw_text, '')) as duplicate_of from docs) select * from g where source_path <> duplicate_of",
    "recent_activity": """with e as (select *, row_number() over (order by ts desc, event_id desc) as place from events)
select place, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, event_type as kind, 'user=' || user_id || ' id=' || event_id as summary from e where place <= 24""",
    "review_counts": f"with {_documents()} select count(*) filter (status = 'open') as open, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'rejected') as rejected, count(*) as total from refused",
    "retry_targets": f"with {_documents()} select distinct source_path, document_type, extraction_status from queue join drows using (source_path) where kind = 'extraction_issue'",
    "export_eligible": f"with {_documents()} select doc_id, source_path, word_count from drows where extraction_status <> 'failed' and source_path not in (select source_path from refused where status = 'rejected')",
    "diagnostics": f"""with {_documents()} select 'documents' as metric, count(*) as n from drows union all select s, (select count(*) from drows where extraction_status = s) from (values ('success'), ('partial'), ('failed'), ('unsupported'), ('metadata_only')) v(s)
union all select 'duplicates', count(*) from drows where duplicate_of is not null union all select 'open_reviews', count(*) from queue""",
    "folder_candidates": f"with {_documents()}, f as (select source_folder_name, count(*) filter (extraction_status <> 'success') as n_degraded, count(*) filter (extraction_status = 'failed') as n_failed, count(*) as n_docs from drows group by 1) select * from f where n_degraded > 0",
    "workspace_summary": f"""with {_documents()}, a as (select count(*) as n_docs, sum(word_count)::bigint as n_words, count(*) filter (extraction_status <> 'success') as n_degraded, count(duplicate_of) as n_duplicates from drows),
b as (select count(*) as n_open, count(*) filter (severity = 'high') as n_high from queue)
select *, case when n_docs = 0 then 'empty' when n_high > 0 then 'needs_review' when n_degraded > 0 then 'degraded' else 'healthy' end as corpus_health, case when n_docs = 0 then 'nothing_to_export' when n_high > 0 then 'blocked' when n_open > 0 then 'review_recommended' else 'ready' end as export_state from a, b""",
    "changed_docs": f"with {_SNAPSHOTS} select coalesce(new.source_path, old.source_path) as source_path, case when old.source_path is null then 'added' when new.source_path is null then 'removed' when old.checksum <> new.checksum then 'changed' else 'unchanged' end as change from new full join old on new.source_path = old.source_path",
    "docs_to_process": f"with {_SNAPSHOTS} select source_path, checksum from new except select source_path, checksum from old",
    "removed_docs": f"with {_SNAPSHOTS} select * from old where source_path not in (select source_path from new)",
    "artifact_duplicates": f"""with {MANUALS}, {_paragraphs(rules.HEADING, "title")}, a as (select source_filename as file_name, arg_max(text, para_idx) as content from para group by 1), g as (select *, min(file_name) over (partition by content) as first_name from a)
select file_name, first_name from g where file_name <> first_name""",
    "event_windows": "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n, count(value) as n_values from events group by all",
    "stream_scan": "select source, count(*) as n_docs, count(distinct text) as n_texts from documents group by source",
    "log_parse": "select event_type as kind, count(*) as n, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) as last_at, count(distinct user_id) as n_users, max(event_id) as last_id from events group by event_type",
}


def _provenance() -> str:
    facts, terms = _facts(), _glossary()
    # both start with the same chunks: the second takes only what it adds
    added = terms[terms.index("raw_lines as") :]
    return f"""with {facts}, {added},
acc as (select 'reference_facts' as target_type, category as title, body, doc_id, chunk_id from facts where rejection_reason is null union all select 'glossary', term, body, doc_id, chunk_id from glossary where rejection_reason is null),
prom as (select distinct target_type, title, body from acc)
select p.target_type, p.title, p.body, count(a.chunk_id) as n_places, count(distinct a.doc_id) as n_docs, min(a.chunk_id) as first_chunk from prom p left join acc a on p.target_type = a.target_type and trim(p.body) = trim(a.body) group by all"""


ORACLE_SQL["provenance"] = _provenance()
ORACLE_SQL["canonical_parts"] = f"""with n as (select doc_id, canonical_name as name from ({ORACLE_SQL["canonical_name"]}) union all select doc_id, source_filename from (with {MANUALS} select doc_id, source_filename from docs))
select doc_id, name, regexp_matches(name, '{CANONICAL}') as is_canonical, regexp_extract(name, '{CANONICAL}', 3) as topic, regexp_extract(name, '{CANONICAL}', 4) as stem, regexp_extract(name, '{CANONICAL}', 5) as doc_date from n"""
ORACLE_SQL["table_sentences"] = ORACLE_SQL["sentence_split"]
ORACLE_SQL["table_headings"] = ORACLE_SQL["heading_fill"]
ORACLE_SQL["stream_revisions"] = """with s as (select source, doc_id, coalesce(text, '') as t, unnest(range(0, doc_id % 3 + 1)) as r from documents),
k as (select source, doc_id, max_by(sha256(t || case when r = 2 then '!' else '' end), r) as checksum from s group by source, doc_id)
select source, count(*) as n_docs, count(distinct checksum) as n_texts, min(checksum) as first_checksum from k group by source"""
ORACLE_SQL["stage_progress"] = f"""with {_facts()} select 'documents' as stage, count(*) as n from docs union all select 'chunks', count(*) from chunks
union all select 'candidates', count(*) from facts union all select 'accepted', count(*) from facts where rejection_reason is null"""
ORACLE_SQL["state_changes"] = """with m as (select doc_id, sha256(coalesce(text, '')) as checksum from documents),
v1 as (select * from m where doc_id % 10 <> 0), v2 as (select doc_id, case when doc_id % 7 = 0 then 'revised' else checksum end as checksum from v1 where doc_id % 11 <> 0)
select 2 as version, 'changed' as change, doc_id, v2.checksum from v1 join v2 using (doc_id) where v1.checksum <> v2.checksum union all select 2, 'removed', doc_id, checksum from v1 where doc_id % 11 = 0
union all select 3, 'added', doc_id, checksum from m where doc_id % 10 = 0"""
ORACLE_SQL["state_as_of"] = "select doc_id, case when doc_id % 7 = 0 then 'revised' else sha256(coalesce(text, '')) end as checksum from documents where doc_id % 10 <> 0 and doc_id % 11 <> 0"
ORACLE_SQL["corpus_source"] = "select page_id, strlen(html) + 1 as length, sha256(html || chr(10)) as checksum, 'plain' as method from pages where html is not null"

ORACLE_SQL["line_rebuilds"] = """select doc_id, case when text is null then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end::bigint as n_lines, sha256(text) as digest from documents"""
ORACLE_SQL["path_rules"] = f"""with {MANUALS}, numbered as (select *, lpad(p_partkey::varchar, 6, '0') as number from part),
rules as (select p_partkey as pos, case p_partkey % 4 when 0 then '**/part_' || number || '.md' when 1 then '/manuals/brand-[!3]*/*_' || number || '.??' when 2 then '*_' || number || '[.]*' else '/corpus/*/doc_' || substr(number, 1, 5) || '[0-4].txt' end as pattern, p_type || '/' || p_partkey::varchar as label from numbered
 union all select distinct 1::bigint << 40, '*/' || {_BRAND} || '/*', p_brand from part),
paths as (select distinct source_path from (select source_path from docs union all select '/corpus/' || source || '/doc_' || lpad(doc_id::varchar, 6, '0') || '.txt' from documents)),
fits as (select source_path, min((pos, label)) as first from paths join rules on source_path glob pattern or (pattern like '**/%' and source_path glob substr(pattern, 4)) group by source_path)
select p.source_path, first[1] as rule_pos, coalesce(first[2], 'general') as rule_label from paths p left join fits f on p.source_path = f.source_path"""
