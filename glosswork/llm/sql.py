"""SQL for DuckDB that says the same as the queries, where SQL can."""

from glosswork.functions.analyze import SPACES

_LATEST = "select pipeline, doc_id, arg_max({0}, row_id) as {0} from (select pipeline, doc_id, row_id, {0}, row_number() over (partition by pipeline, doc_id order by row_id desc) as place from preprocessed_docs) where place = 1 group by 1, 2"
_KEPT = "select pipeline, doc_id, {0} from (select *, row_number() over (partition by pipeline, doc_id order by row_id desc) as place from preprocessed_docs) where place = 1"

_TERMS = f"""
with kept as ({_KEPT.format('tokens')}),
each as (select pipeline, doc_id, unnest(tokens) as term from kept),
counted as (select pipeline, term, count(*) as occurrences, count(distinct doc_id) as records from each where term <> '' group by 1, 2),
totals as (select pipeline, count(distinct doc_id) as total from each where term <> '' group by 1)
"""
_MARK = "case when records = 1 then 'rare' when records > total * 0.2 then 'common' end"

_TEXT = f"article_text is not null and regexp_matches(article_text, '[^{SPACES}]') and trim(article_text) <> 'No Article Text Found'"
_CANON = r"""
with kept as (
  select page_id, article_text, split_part(url, '?', 1) as base,
    case when strpos(url, '?') > 0 then string_split(substr(url, strpos(url, '?') + 1), '&') else [''] end as params
  from crawled_pages where url is not null and regexp_matches(url, '[^\s]') and """ + _TEXT + r"""),
canon as (
  select page_id,
    lower(regexp_replace(base, '[^\p{L}\p{N}]+', '', 'g')) || array_to_string(list_sort(list_transform(params, lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')))), '') as u,
    lower(regexp_replace(article_text, '[^\p{L}\p{N}]+', '', 'g')) as t
  from kept)
"""

_SCORES = f"""
with kept as ({_KEPT.format('normalized_text')}),
each as (select doc_id, unnest(regexp_split_to_array(normalized_text, '\\s+')) as term from kept where pipeline = 'baseline' and normalized_text is not null and regexp_matches(normalized_text, '[^\\s]')),
pairs as (select doc_id, term, count(*) as tf from each where term <> '' group by 1, 2),
stats as (select term, count(*) as df, sum(tf) as cf from pairs group by 1),
whole as (select count(distinct doc_id) as n, sum(tf) as total from pairs),
sized as (select doc_id, sum(tf) as length from pairs group by 1),
cells as (select p.doc_id, p.term, p.tf, s.df, s.cf, n, tf::double as a, (cf - tf)::double as b, (length - tf)::double as c, (total - length - cf + tf)::double as d from pairs p join stats s using (term) join sized using (doc_id), whole),
x as (select *, (1 + log10(tf)) * log10(n / df) as weight,
  greatest(2 * (case when a > 0 then a * ln(a / ((a + b) * (a + c) / (a + b + c + d))) else 0 end + case when b > 0 then b * ln(b / ((a + b) * (b + d) / (a + b + c + d))) else 0 end
   + case when c > 0 then c * ln(c / ((c + d) * (a + c) / (a + b + c + d))) else 0 end + case when d > 0 then d * ln(d / ((c + d) * (b + d) / (a + b + c + d))) else 0 end), 0) as g from cells)
"""

SQL: dict[str, str] = {
    "p1_found": _TERMS + f"select pipeline, term, {_MARK} as mark from counted join totals using (pipeline) where {_MARK} is not null",
    "p1_terms": _TERMS + f"select pipeline, term, occurrences, records, total, {_MARK} as mark from counted join totals using (pipeline)",
    "p1_vocab": _TERMS + ", listed as (select pipeline, term, max(freq) as stored from vocab where term is not null group by 1, 2) select pipeline, term, stored, coalesce(occurrences, 0) as counted from listed left join counted using (pipeline, term)",
    "p4_found": _CANON + "select * from (select min(page_id) over (partition by u, t) as page_id_a, page_id as page_id_b from canon) where page_id_a <> page_id_b",
    "p5_found": _SCORES + "select doc_id, term from (select doc_id, term, row_number() over (partition by doc_id order by weight desc, term) as place from x where df >= 2) where place <= 3",
    "p5_distinctive": _SCORES + "select doc_id, term, place::int as place from (select doc_id, term, row_number() over (partition by doc_id order by round(case when a * (b + d) < b * (a + c) then -g else g end, 4) desc, term) as place from x where df >= 2) where place <= 3",
    "p7_found": r"""
with kept as (
  select page_id, regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '') as site, string_split(article_text, chr(10)) as lines
  from crawled_pages where url is not null and """ + _TEXT + r"""),
each as (select page_id, site, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as line_no from kept where site <> ''),
keyed as (select page_id, site, line_no, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) as own from each),
often as (select site, own from keyed where own <> '' group by 1, 2 having count(distinct page_id) >= 8)
select page_id, line_no::int as line_no from keyed semi join often using (site, own)""",
    "p8_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p2_found": r"""
with w as materialized (select page_id, regexp_extract_all(lower(article_text), '[\p{L}\p{N}]+') as w from crawled_pages where """ + _TEXT + r"""),
s as materialized (select page_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) as x from w where len(w) >= 60),
n as materialized (select page_id, count(*) as n from s group by 1),
overlap as (select a.page_id as page_id_a, b.page_id as page_id_b, count(*) as k from s a join s b on a.x = b.x and a.page_id < b.page_id group by 1, 2)
select page_id_a, page_id_b from overlap join n a on a.page_id = page_id_a join n b on b.page_id = page_id_b where 2 * k >= a.n + b.n - k""",
    "p4_records": _CANON
    + "select min(page_id) as page_id, count(*) as copies, count(distinct raw) as spellings from (select page_id, u, t, url || chr(0) || article_text as raw from canon join crawled_pages using (page_id)) group by u, t",
    "p5_scores": _SCORES + "select doc_id, term, tf, df, cf, round(case when a * (b + d) < b * (a + c) then -g else g end, 4) + 0.0 as llr, round(weight, 6) as weight from x",
}

SQL["p2_groups"] = (
    SQL["p2_found"].replace("with w as", "with recursive w as")
    .replace("select page_id_a, page_id_b from overlap", """, links as (select page_id_a as p, page_id_b as q from overlap""")
    + """), member as (select page_id, w as text from w where len(w) >= 60),
twoway as (select p, q from links union all select q, p from links),
reach as (select page_id as p, page_id as q from member union select r.p, b.q from reach r join twoway b on r.q = b.p),
others as (select b.p, count(distinct m.text) filter (where m.text <> o.text) as links from twoway b join member m on m.page_id = b.q join member o on o.page_id = b.p group by 1)
select m.page_id, (select min(q) from reach r where r.p = m.page_id) as group_id, coalesce(links, 0) as links from member m left join others on others.p = m.page_id"""
)

_LINES = SQL["p7_found"].rpartition("often as")[0]
SQL["p7_blocks"] = (
    _LINES
    + """lettered as (select page_id, site, list(own order by line_no) as own, list(line_no order by line_no) as nos from keyed where own <> '' group by 1, 2),
starts as (select page_id, site, own, nos, unnest(range(1, len(own) + 1)) as p from lettered),
parts as (select page_id, site, nos, p, n, list_slice(own, p, p + n - 1) as block from (select *, unnest(range(1, len(own) - p + 2)) as n from starts)),
often as (select site, block from parts group by 1, 2 having count(distinct page_id) >= 8),
longest as (select page_id, p, any_value(nos)[p] as first, max(n) as length from parts semi join often using (site, block) group by 1, 2),
placed as (select *, lag(p) over w as before, lag(length) over w as length_before from longest window w as (partition by page_id order by p))
select page_id, first::int as first, length::int as length from placed where before is null or before <> p - 1 or length_before <= length"""
)
SQL["p7_clean"] = f"""with found as ({SQL["p7_found"]}), gone as (select page_id, list(distinct line_no) as g from found group by 1)
select page_id, case when g is null then article_text else array_to_string([x for x, i in string_split(article_text, chr(10)) if not list_contains(g, i)], chr(10)) end as article_text, coalesce(len(g), 0)::int as removed from crawled_pages left join gone using (page_id)"""
