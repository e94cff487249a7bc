"""SQL counterparts of the corpus queries."""

from checks.board_sql import BOARD

EMAIL = r"[a-z0-9._%+-]+(?:@|%40)[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"(?:^|[^a-z0-9])(?:(?:\+|%2b)86[ -]?)?1[3-9][0-9][ -]?[0-9]{4}[ -]?[0-9]{4}(?:[^a-z0-9]|$)"
FILE_URI = r"\bfile:/+\S*"
USER_PATH = (r"(?:^|[^a-z0-9.])/(?:Users|home)/[a-z0-9_.-]+(?:[\\/]|$)|\b[a-z]:[\\/]+Users[\\/]+[^\\/\s]+"
             r"|(?:^|[\s\"''(])~[\\/]+")
MARKER = "submittedProjectIds|welfareScore|cityPlatformValue|socialValue|recommendationTier"
MARKERS = rf"(?:^|[^a-z0-9_$])(?:{MARKER})(?:[^a-z0-9_$]|$)|targets[\\/]submitted(?:[\\/]|$)|profile_space[\\/]targets(?:[\\/]|$)"
CORPUS_PRIVATE = (rf"(^|[^a-z0-9_$])({MARKER})([^a-z0-9_$]|$)|targets[/\\]submitted|profile_space[/\\]targets|(^|[^a-z0-9.:/])/(Users|home)/[a-z0-9_.-]+"
                  r"|file:/+([^/\s]+/)?(Users|home)/[a-z0-9_.-]+|[a-z]:[/\\][Uu]sers[/\\][a-z0-9_.-]+")
CONTACT = (r"[a-z0-9._%+-]+(@|%40)[a-z0-9.-]+\.[a-z]{2,}"
           r"|(^|[^a-z0-9])((\+|%2B)86[ -]?)?1[3-9][0-9][ -]?[0-9]{4}[ -]?[0-9]{4}([^a-z0-9]|$)")


def _hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){pattern}')"


_LINES = "(select doc_id, unnest(string_split({t}, chr(10))) as line, generate_subscripts(string_split({t}, chr(10)), 1) as line_no from {f})"


def _corpus(lines: str, cleaned: str) -> str:
    return f"""select doc_id, line_no, 'private' as kind from {lines} where {_hit('line', CORPUS_PRIVATE)}
union all select doc_id, line_no, 'contact' from {lines} where {_hit('line', CONTACT)} and {_hit(cleaned, CONTACT)}"""


_EVENT_DOCS = """with ev as (select event_id as id, event_id % 5 as m, cast(json_extract_string(props, '$.k') as varchar) as v from events)
"""

LEGACY = """, legacy as (
  select s_suppkey as k, case s_suppkey % 4 when 0 then 'camp1998' when 1 then 'camp2099' when 2 then 'yutuimian2098' else 'misc' end as feed,
    case when s_suppkey % 9 = 0 then s_name || '研究所' else n_name end as name, 'inst' || (s_suppkey % 3) as inst,
    s_suppkey % 9 = 0 as institute_name, s_suppkey % 6 as t, case when s_suppkey % 7 = 0 then 'P' end as prov
  from supplier join nation on s_nationkey = n_nationkey
)"""

SQL = {
    "url_normalize": """with p as (select page_id, url, regexp_extract(url, '^(https?)', 1) as scheme, regexp_extract(url, '^https?://([^/]*)', 1) as host,
   regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/+$', ''), '^$', '/') as path,
   regexp_extract(url, '\\?([^#]*)', 1) as q from pages)
select page_id, case when page_id % 11 = 0 or page_id % 13 = 0 then null else scheme || '://' || lower(host) || case when page_id % 3 = 2 then ':8080' else '' end
  || path || case when q = '' then '' else '?' || array_to_string(list_sort(string_split(q, '&')), '&') end end as url_norm from p""",
    "url_identity": """with p as (select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as u from pages)
select u as url_norm, count(*) as n_rows, count(distinct page_id) as n_ids, min(page_id) as first_id from p group by 1""",
    "denied_hosts": """with p as (select page_id, lower(regexp_extract(url, '^https?://([^/]*)', 1)) as h from pages),
 d(denied) as (values ('example.org'), ('cheap-pills.example.com'), ('ample.net'))
select page_id, denied from p join d on h = denied or ends_with(h, '.' || denied)""",
    "url_rules": """select page_id, case page_id % 5 when 1 then false when 2 then false when 0 then true else true end as is_http,
  page_id % 5 = 0 as has_credentials, page_id % 5 = 3 as is_denied from pages""",
    "collapsed_texts": """select doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h,
  length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) as n from documents""",
    "diagnostic_texts": "select doc_id, substr(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), 1, 500) as message from documents",
    "private_free_text": "select conv_id, turn, conv_id % 10 in (0, 4, 5, 6, 7, 8, 9) as is_private from conversations",
    "evidence_phrases": "select conv_id, turn, conv_id % 6 in (0, 5) as unverified, conv_id % 6 in (2, 3) as not_published from conversations",
    "child_paths": """select p_partkey, case p_partkey % 3 when 0 then 'snapshot.' || p_type when 1 then 'snapshot["' || p_name || '"]'
  else 'snapshot["say \\"' || p_brand || '\\""]' end as path from part""",
    "privacy_findings": _corpus(_LINES.format(t="text", f="documents"), "line"),
    "reviewed_contacts": "with docs as (select doc_id, regexp_replace(regexp_replace(text, '@mail[0-3]', '@mail0', 'g'), '[A-Za-z0-9._%+-]+@mail0\\.example\\.com', 'team@mail0.example.com', 'g') as text from documents) "
    + _corpus(_LINES.format(t="text", f="docs"),
              "regexp_replace(line, '(^|[^A-Za-z0-9._%+-])team@mail0\\.example\\.com([^A-Za-z0-9.-]|$)', '\\1\\2', 'g')"),
    "private_texts": "select * from (select doc_id, case when " + _hit("text", EMAIL) + " then 'email address' when " + _hit("text", PHONE)
    + " then 'Chinese mainland mobile number' when " + _hit("text", FILE_URI) + " then 'file URI' when " + _hit("text", USER_PATH)
    + " then 'user-local path' when " + _hit("text", MARKERS) + " then 'private publication marker' end as kind from documents) where kind is not null",
    "benchmark_leaks": "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)",
    "short_marker_leaks": """with h as (select distinct lower(regexp_extract(url, '^https?://([^/]*)', 1)) as host from pages)
select 'page ' || page_id as place, host from pages join h on contains(url, host)
union all select 'document ' || doc_id, host from documents join h on contains(text, host)""",
    "corpus_isolation": """with hit as (select distinct lang, item_id from documents d join benchmark b on contains(d.text, b.text)),
 m as (select item_id, case when item_id % 2 = 0 then 'en' else 'de' end as home from benchmark)
select lang as corpus, item_id, 'leaked' as problem from hit join m using (item_id) where lang <> home
union all select home, item_id, 'missing' from m where not exists (select 1 from hit where hit.item_id = m.item_id and hit.lang = m.home)""",
    "json_leaves": """select event_id as doc_id, '$' as path, cast(null as varchar) as value, 0 as depth, 2 as nodes from events
union all select event_id, '$.k', json_extract_string(props, '$.k'), 1, 2 from events""",
    "loose_json": _EVENT_DOCS + "select id as doc_id, 'not strict JSON' as message from ev where m in (1, 2, 3)",
    "private_json": _EVENT_DOCS + """select id as doc_id, '$["a b"].welfareScore' as path, 'contains a private publication marker' as message from ev where m = 4
union all select id, '$["a b"].to', 'contains a email address' from ev where m = 4""",
    "json_budgets": _EVENT_DOCS + """select id as doc_id, 'privacy scan exceeded node budget' as message from ev where m = 4
union all select id, 'privacy scan exceeded depth budget' from ev where m = 4""",
    "exact_keys": _EVENT_DOCS + """select id as doc_id, 'event.v' as path, 'missing property' as message from ev
union all select id, 'event.a b', 'unknown property' from ev where m = 4""",
    "field_types": """select o_orderkey as id, 'row.name' as path, 'expected a string' as message from orders where o_orderkey % 4 in (0, 1)
union all select o_orderkey, 'row.deadlineEpochMs', 'expected a finite number or null' from orders where o_orderkey % 3 = 1
union all select o_orderkey, 'row.tags', 'expected an array' from orders where o_orderkey % 5 = 0""",
    "catalog_feeds": BOARD + LEGACY + """select distinct 'camp' || cycle as id, '推免活动 ' || cycle as label, cycle as admission_cycle, 1998 as event_year from board
union all select distinct feed, case feed when 'camp2099' then '夏令营 2099' when 'yutuimian2098' then '预推免 2098' else 'misc' end || '（历史归档）',
  case feed when 'camp2099' then '2099' when 'yutuimian2098' then '2098' else '0000' end,
  case feed when 'camp2099' then 2099 when 'yutuimian2098' then 2098 else 0 end from legacy where feed <> 'camp1998'""",
    "legacy_board": BOARD + LEGACY + """select concat_ws('|', 'legacy', feed, name, inst, k) as project_id,
  case k % 5 when 0 then '1997-03-01T12:00:00+08:00' when 1 then '1997-03-02' when 2 then 'soon' else '历史数据未提供' end as original,
  case k % 5 when 0 then '1997-03-01T12:00:00+08:00' when 1 then '1997-03-02' end as deadline,
  case k % 5 when 0 then epoch_ms(timestamp '1997-03-01 04:00:00') when 1 then epoch_ms(timestamp '1997-03-02 00:00:00') end as ms,
  case when t = 0 then '985' when t = 1 then '211' when institute_name then '研究院' else '' end as tags,
  case when k % 2 = 0 then 1 else 0 end as n_sources, prov as province from legacy""",
    "school_tiers": BOARD + LEGACY + """, hist as (select name, min(case when t = 0 then 1 when t = 1 then 2 end) as best from legacy where t in (0, 1) group by name),
 pr as (select ['TOP2','港三','华五','C9','985','211','研究院','联培','双非','四非'] as p)
select project_id, coalesce(case when institute <> 'MACHINERY' and len(tags) > 0 then list_filter(p, lambda x: list_contains(tags, x))[1] end,
  case best when 1 then '985' when 2 then '211' end, '') as tier
from board left join hist using (name), pr""",
    "catalog_counts": BOARD + LEGACY + """select feed_id, count(*) as n from board group by 1
union all select feed, count(*) from legacy where feed <> 'camp1998' group by 1""",
    "version_adapter": BOARD + """select project_id, case when k % 2 = 0 then 'unknown' else mode end as mode,
  case when k % 2 = 0 then '旧版快照未记录' else '待官方公布' end as summary from board""",
    "logo_dimension": """with n as (select p_partkey as k, case p_partkey % 5 when 0 then '清华大学' when 1 then '北京大学（深圳）' when 2 then '复旦大学·医学院' when 3 then '南京大学'
   else p_brand || '/985' end as name from part where p_partkey % 7 <> 0)
select name, '/logo/' || min(k) || '.png' as logo_url from n group by 1""",
    "logos_resolved": """with n as (select p_partkey as k, p_partkey % 5 as m from part where p_partkey % 7 <> 0),
 l as (select min(k) filter (m = 0) as a, min(k) filter (m = 1) as b, min(k) filter (m = 2) as c from n)
select s_suppkey, case s_suppkey % 5 when 0 then '/logo/' || a || '.png' when 1 then '/logo/' || a || '.png' when 2 then '/logo/' || b || '.png'
  when 3 then '/fixed.png' else '/logo/' || c || '.png' end as logo_url from supplier, l""",
    "deadline_changes": """with e as (select event_id, user_id, cast(floor(value / 50) as bigint) as deadline_h,
   lag(cast(floor(value / 50) as bigint)) over (partition by user_id order by event_id) as last_h from events)
select event_id, user_id, deadline_h, last_h from e where deadline_h is distinct from last_h""",
    "expiry_stream": """with e as (select event_id, epoch_us(ts) // 1000 + cast(floor(value * 360000) as bigint) as at_ms, epoch_us(max(ts) over ()) // 1000 as last_ms from events)
select event_id, 'ended' as label, at_ms from e where at_ms <= last_ms""",
}
