"""SQL counterparts of the publication queries."""

from checks.board_sql import BOARD

# Board rows with all texts of the opportunity schema, as of version ``v``.
FULL = BOARD + """, full_board as (
  select *, strftime(d, '%Y-%m-%d') || printf('T%02d:%02d:00Z', mins // 60, mins % 60) as dl0,
    case k % 7 when 0 then printf('截止 %02d:%02d', mins // 60, mins % 60)
      when 1 then case when mins // 60 >= 13 then printf('下午%d点%d分', mins // 60 - 12, mins % 60)
                       else printf('上午%d点%d分', mins // 60, mins % 60) end
      when 2 then printf('%d时截止', mins // 60) when 3 then printf('截止 %02d:%02d', mins // 60, mins % 60) || '；官方未公布具体时刻'
      when 4 then '' when 5 then '当日 23:59' else '当日 24:00' end as original,
    {'status': 'confirmed', 'summary': 'yes'} as yes, {'status': 'not-published', 'summary': '未公布'} as np,
    {'status': 'unverified', 'summary': '待官方公布'} as uv
  from board
)"""


def row_json(project_id="project_id", website="website", description="description", verified="'1998-06-30T00:00:00Z'",
             deadline="case when ms is not null then dl0 end"):
    """Canonical JSON of a row; a NULL province is absent."""
    head = f"""'deadline': {deadline}, 'deadlineEpochMs': ms, 'deadlineOriginal': original, 'description': {description},
  'discoverySources': case when has_official then [{{'kind': 'baoyan-notice', 'label': '保研通知网', 'url': site}},
     {{'kind': 'official', 'label': '官方链接', 'url': site}}] else [{{'kind': 'baoyan-notice', 'label': '保研通知网', 'url': site}}] end,
  'eventArrangement': {{'formatLocation': uv, 'mode': mode, 'time': uv}}, 'eventType': event_type, 'feedId': feed_id,
  'institute': institute, 'logistics': yes, 'materials': uv, 'name': name, 'project': project, 'projectId': {project_id}"""
    tail = f"""'recommendation': np, 'tags': tags, 'verificationStatus': status{", 'verifiedAt': " + verified if verified else ""}, 'website': {website}"""
    return (f"cast(case when province is null then to_json({{{head}, {tail}}}) "
            f"else to_json({{{head}, 'province': province, {tail}}}) end as varchar)")


FULL = FULL.replace("select *, strftime(d", "select *, website as site, strftime(d")

PAIR = BOARD + """, old as (select project_id, k, status, project, ms, website from board where k % 10 <> 0),
new as (select project_id, k, case when k % 11 = 5 then 'expired' else status end as status,
  case when k % 7 = 3 then project || ' v2' else project end as project,
  case when k % 11 = 5 and status = 'confirmed-unknown-deadline' then epoch_ms(d) + mins * 60000 else ms end as ms, website
  from board where k % 10 <> 1),
cmp as (
  select coalesce(o.project_id, n.project_id) as project_id, o.k is null as is_added, n.k is null as is_removed,
    o.status as old_status, n.status as new_status, n.ms as new_ms, coalesce(n.ms, o.ms) as ms, n.ms is distinct from o.ms as ms_differs,
    n.project is distinct from o.project or n.ms is distinct from o.ms or n.status is distinct from o.status as differs,
    coalesce(n.website, o.website) as website
  from old o full outer join new n on o.project_id = n.project_id
), cls as (select *, case when is_removed then 'removed' when is_added then 'added'
    when old_status <> 'expired' and new_status = 'expired' then 'expired' when differs then 'changed' end as change_type from cmp)
"""

MONTHLY = FULL + """, mon as (
  select *, strftime(d, '%Y-%m') as key, month(d) as mo, k as pos,
    case when k % 97 = 0 then 'https://sub.GitHub.com./x' when k % 89 = 0 then 'https://u:p@h.example/'
         when k % 83 = 0 then 'ftp://files.example/' else website end as web,
    case when k % 73 = 0 then 'yesterday' when k % 71 = 0 then strftime(d, '%Y-%m') || '-01T06:00:00Z'
         when k % 67 = 0 then strftime(d, '%Y-%m') || '-02T00:00:00Z' else strftime(d, '%Y-%m') || '-01T00:00:00Z' end as ver,
    case when k % 79 <> 0 and ms is not null then dl0 end as dl,
    case when k % 61 = 0 then '1998| |x|y' when k % 59 = 0 then '19x8|a|b|' || k when k % 53 = 0 then '1998|dup|dup|dup'
         else project_id end as pid
  from full_board
), heads as (
  select key, mo, substr(key, 1, 4) as cyc, count(*) filter (status = 'confirmed-open') + case when mo = 9 then 1 else 0 end as c_open,
    count(*) filter (status = 'confirmed-unknown-deadline') as c_unknown, count(*) filter (status = 'expired') as c_expired,
    case when mo = 10 then -1 else count(*) end as c_pending,
    case when mo = 3 then 3 else 2 end as version,
    case when mo = 4 then key || '-01 00:00' else key || '-01T00:00:00Z' end as scan_at,
    epoch_ms(cast(key || '-01' as timestamp)) as first_ms,
    strftime(cast(key || '-01' as date) - interval 1 month, '%Y-%m') as before,
    strftime(cast(key || '-01' as date) + interval 1 month, '%Y-%m') as later
  from mon group by key, mo
), head as (
  select *, case when mo <> 4 then first_ms end as scan_ms,
    case when mo = 2 then epoch_ms(cast(before || '-01' as timestamp)) else first_ms + 43200000 end as approved_ms,
    key || '-01T12:00:00.000Z-' || substr(sha256(key), 1, 12) as snapshot_id,
    case when mo = 11 then 'first' else before || '-01T12:00:00.000Z-' || substr(sha256(before), 1, 12) end as previous_id,
    case when mo = 5 then 'xyz' else sha256(key) end as data_hash
  from heads
)"""

_SEAL = MONTHLY + ", rows as (select key, string_agg(" + row_json(
    project_id="pid", website="web", verified="ver", deadline="dl") + """, ',' order by pos) as body from mon group by key),
seal as (select head.*, case when octet_length(encode(body)) <= 16777216 then sha256('{"counts":{"confirmedOpen":' || c_open || ',"confirmedUnknownDeadline":' || c_unknown || ',"expired":' || c_expired
  || ',"pendingExcluded":' || c_pending || '},"defaultFeedId":"camp' || cyc || '","feeds":['
  || case when mo = 6 then '' else f || case when mo = 8 then ',' || f else '' end end
  || '],"opportunities":[' || body || '],"scanAt":"' || scan_at || '","schemaVersion":' || version || '}') end as computed
  from head join rows using (key),
  lateral (select '{"admissionCycle":"' || case when mo = 7 then substr(cyc, 1, 3) || 'X' else cyc end || '","eventYear":' || cyc
    || ',"id":"camp' || cyc || '","label":"label"}' as f) q)
"""



def _states(name: str, rows: str) -> str:
    """Common table expressions for the multiset state of ``rows`` (g, body): sums of 24-bit lanes of four blocks."""
    return f"""{name}_b as (select g, i, sha256(sha256(body) || ':' || i) as b from {rows}, range(4) t(i)),
{name}_l as (select g, i * 10 + j as lane, sum(cast('0x' || substr(b, 1 + 6 * j, 6) as bigint)) % 16777216 as s, count(*) as n from {name}_b, range(10) u(j) group by g, i, j),
{name} as (select g, cast(max(n) as bigint) as n, string_agg(printf('%06x', s), '' order by lane) as state from {name}_l group by g)"""


_SEALS = MONTHLY + ", row_texts as (select key as g, " + row_json(project_id="pid", website="web", verified="ver", deadline="dl") + """ as body from mon),
feed_texts as (select key as g, p || ':{"admissionCycle":"' || case when mo = 7 then substr(cyc, 1, 3) || 'X' else cyc end || '","eventYear":' || cyc
    || ',"id":"camp' || cyc || '","label":"label"}' as body from head, range(2) t(p) where mo <> 6 and (p = 0 or mo = 8)),
""" + _states("row_state", "row_texts") + ", " + _states("feed_state", "feed_texts") + """
select key as snapshot_key, r.n as n_rows, r.state as row_state,
  sha256('{"counts":{"confirmedOpen":' || c_open || ',"confirmedUnknownDeadline":' || c_unknown || ',"expired":' || c_expired || ',"pendingExcluded":' || c_pending
  || '},"defaultFeedId":"camp' || cyc || '","feeds":{"n":' || coalesce(f.n, 0) || ',"state":"' || coalesce(f.state, repeat('0', 240)) || '"},"opportunities":{"n":' || r.n
  || ',"state":"' || r.state || '"},"scanAt":"' || scan_at || '","schemaVersion":' || version || ',"scheme":"multiset-sha256"}') as seal
from head join row_state r on r.g = key left join feed_state f on f.g = key"""

_FOLLOWING = FULL + """, following as (select * replace (case when k % 11 = 5 then 'expired' else status end as status,
    case when k % 7 = 3 then project || ' v2' else project end as project, case when k % 7 = 3 and k % 4 > 1 then description || ' v2' else description end as description,
    case when k % 11 = 5 and ms is null then epoch_ms(d) + mins * 60000 else ms end as ms) from full_board where k % 10 <> 1),
texts as (select feed_id as g, """ + row_json(verified="''") + """ as body from following),
""" + _states("following_state", "texts") + " select g as feed_id, n as n_rows, state from following_state"

_PATH = "'snapshot.opportunities[' || pos || ']"

# (path suffix, rule, condition) over rows ``m`` of a month joined to their header.
_ROW_RULES = [
    (".website", "website-url", "k % 83 = 0 and k % 97 <> 0 and k % 89 <> 0"),
    (".website", "website-credentials", "k % 89 = 0 and k % 97 <> 0"),
    (".website", "website-denied", "k % 97 = 0"),
    (".verifiedAt", "verified-at-iso", "k % 73 = 0"),
    (".discoverySources", "official-source", "not has_official"),
    ("", "open-deadline", "status = 'confirmed-open' and dl is null"),
    ("", "open-future", "status = 'confirmed-open' and dl is not null and ms <= approved_ms"),
    ("", "expired-deadline", "status = 'expired' and dl is null"),
    ("", "expired-past", "status = 'expired' and dl is not null and ms > approved_ms"),
    (".projectId", "key-parts", "k % 61 = 0"),
    (".projectId", "key-cycle", "k % 61 <> 0 and k % 59 = 0"),
    (".feedId", "feed-known", "mo = 6"),
    (".projectId", "key-feed-cycle", "k % 61 <> 0 and mo <> 6 and substr(pid, 1, 4) <> case when mo = 7 then substr(cyc, 1, 3) || 'X' else cyc end"),
    (".verifiedAt", "verified-scan", "k % 73 <> 0 and epoch_ms(cast(replace(replace(ver, 'T', ' '), 'Z', '') as timestamp)) > scan_ms"),
    (".verifiedAt", "verified-approval", "k % 73 <> 0 and epoch_ms(cast(replace(replace(ver, 'T', ' '), 'Z', '') as timestamp)) > approved_ms"),
]
_ROWS = " union all ".join(
    f"select key as snapshot_key, {_PATH}{suffix}' as path, '{rule}' as rule from mon join head using (key, mo) where {cond}"
    for suffix, rule, cond in _ROW_RULES)
# The cast must not see the malformed text.
_ROWS = _ROWS.replace("cast(replace(", "try_cast(replace(")

_HEADS = " union all ".join(
    f"select key as snapshot_key, 'snapshot.{path}' as path, '{rule}' as rule from head where {cond}" for path, rule, cond in [
        ("schemaVersion", "schema-version", "mo = 3"), ("scanAt", "scan-iso", "mo = 4"), ("defaultFeedId", "default-feed", "mo = 6"),
        ("approvedAt", "approval-after-scan", "approved_ms < scan_ms"), ("dataHash", "hash-format", "mo = 5"),
        ("previousSnapshotId", "previous-format", "mo = 11")])
_COUNTS = " union all ".join(
    f"select key as snapshot_key, 'snapshot.counts.{path}' as path, '{rule}' as rule from head where {cond}" for path, rule, cond in [
        ("confirmedOpen", "count-match", "mo = 9"), ("pendingExcluded", "count-integer", "mo = 10")])
_ORDER = f""", o as (select *, coalesce(bool_or(status = 'expired') over w, false) as se, coalesce(bool_or(status = 'confirmed-unknown-deadline') over w, false) as su,
  max(case when status = 'confirmed-open' then pos end) over w as last_pos from mon
  window w as (partition by key order by pos rows between unbounded preceding and 1 preceding)),
 o2 as (select o.*, p.ms as last_ms from o left join mon p on p.key = o.key and p.pos = o.last_pos)
select key as snapshot_key, {_PATH}' as path, 'order-expired' as rule from o2 where status <> 'expired' and se
union all select key, {_PATH}', 'order-unknown' from o2 where status = 'confirmed-open' and su
union all select key, {_PATH}', 'order-deadline' from o2 where status = 'confirmed-open' and ms < last_ms"""
_DUPS = f"select key as snapshot_key, {_PATH}.projectId' as path, 'key-unique' as rule from (select *, row_number() over (partition by key, pid order by pos) as rn from mon) where rn > 1"
_FEEDS = """select key as snapshot_key, 'snapshot.feeds[0].admissionCycle' as path, 'feed-cycle' as rule, 'expected exactly four digits' as message from head where mo = 7
union all select key, 'snapshot.feeds[1].id', 'feed-unique', 'duplicate feed ID' from head where mo = 8"""

_APPROVED = FULL + """, clean as (select * replace (true as has_official,
    case when ms is null then 'confirmed-unknown-deadline' when ms > 899251200000 then 'confirmed-open' else 'expired' end as status) from full_board),
placed as (select *, row_number() over (order by case status when 'confirmed-open' then 0 when 'confirmed-unknown-deadline' then 1 else 2 end,
    case when status = 'confirmed-open' then ms end nulls last, project_id) - 1 as pos from clean),
row_texts as (select 1 as g, """ + row_json() + """ as body from placed),
cycles as (select cycle, row_number() over (order by cycle) - 1 as p from (select distinct cycle from placed) z),
feed_texts as (select 1 as g, p || ':{"admissionCycle":"' || cycle || '","eventYear":' || cycle || ',"id":"camp' || cycle || '","label":"label"}' as body from cycles),
""" + _states("row_state", "row_texts") + ", " + _states("feed_state", "feed_texts") + """,
n as (select count(*) as n_rows, max(pos) as last_pos, arg_min(project_id, pos) as first_id, arg_max(project_id, pos) as last_id, count(*) filter (status = 'confirmed-open') as n_open,
    count(*) filter (status = 'confirmed-unknown-deadline') as n_unknown, count(*) filter (status = 'expired') as n_expired from placed),
sealed as (select n.*, sha256('{"counts":{"confirmedOpen":' || n_open || ',"confirmedUnknownDeadline":' || n_unknown || ',"expired":' || n_expired
  || ',"pendingExcluded":0},"defaultFeedId":"camp' || (select min(cycle) from cycles) || '","feeds":{"n":' || f.n || ',"state":"' || f.state || '"},"opportunities":{"n":' || r.n
  || ',"state":"' || r.state || '"},"scanAt":"1998-07-01T00:00:00Z","schemaVersion":2,"scheme":"multiset-sha256"}') as data_hash
  from n, row_state r, feed_state f)
select '1998-07-01T00:00:00.000Z-' || substr(data_hash, 1, 12) as snapshot_id, data_hash, cast(null as varchar) as previous_id, n_rows, last_pos, first_id, last_id, n_open, n_unknown, n_expired
from sealed"""

# Candidate documents of 64 neighbouring order keys with planted faults: (path suffix, rule, condition) over their rows.
_DOCUMENTS = BOARD + """, mon as (select *, 'b' || (k // 64) as key, k // 64 as b, row_number() over (partition by k // 64 order by k) - 1 as pos from board),
doc as (select key, b, count(distinct feed_id) as n_feeds from mon group by key, b)"""
_DOCUMENT_ROWS = " union all ".join(
    f"select key as snapshot_key, {_PATH}{suffix}' as path, '{rule}' as rule from mon where {cond}" for suffix, rule, cond in [
        (".extra", "exact-keys", "k % 31 = 0"), (".name", "field-type", "k % 37 = 0"), (".name", "required", "k % 37 = 0"),
        (".tags", "field-type", "k % 41 = 0"), (".tags", "required", "k % 41 = 0"), (".logistics.summary", "exact-keys", "k % 43 = 0"),
        (".website", "exact-keys", "k % 47 = 0 and k % 31 <> 0"), (".website", "required", "k % 47 = 0 and k % 31 <> 0"), (".website", "website-url", "k % 47 = 0 and k % 31 <> 0"), (".description", "private-value", "k % 53 = 0"),
        (".discoverySources", "official-source", "not has_official"), ("", "open-future", "status = 'confirmed-open' and ms <= 899251200000"),
        ("", "expired-past", "status = 'expired' and ms > 899251200000")])
_DOCUMENT_HEADS = " union all ".join(
    f"select key, 'snapshot.{path}', '{rule}' from doc where {cond}" for path, rule, cond in [
        ("note", "exact-keys", "b % 11 = 0"), ("scanAt", "field-type", "b % 13 = 0"), ("scanAt", "required", "b % 13 = 0"), ("counts.confirmedOpen", "count-match", "b % 7 = 0")])
_DOCUMENT_FEEDS = " union all ".join(
    f"select key, 'snapshot.feeds[' || i || '].eventYear', '{rule}' from doc, lateral (select unnest(range(n_feeds)) as i) where b % 17 = 0" for rule in ("field-type", "required"))

# Scouting rows: fields of the import and their expected meaning.
SCOUT = BOARD + """, sc as (
  select s.k, s.st, s.cycle, s.n_name, s.seg, s.pri, o.o_custkey as c, s.d,
    concat_ws('|', s.cycle, n_name, seg, 'o' || s.k) as id, concat_ws('|', s.cycle, n_name, seg, 'r' || s.k) as rid,
    concat_ws('|', s.cycle, n_name, seg, 's' || s.k) as sid,
    case when s.k % 29 = 0 then 'pendingRows' when st <> 'F' then 'mainRows' else 'expiredRows' end as section,
    st <> 'F' as active,
    case when st = 'P' then null when s.k % 4 = 0 then epoch_ms(cast(s.d as timestamp)) + 86340000 - 28800000
         when s.k % 4 = 1 then epoch_ms(cast(s.d as timestamp)) + 63000000 - 28800000
         when s.k % 4 = 2 then epoch_ms(cast(s.d as timestamp)) + 36920000
         else epoch_ms(cast(s.d as timestamp)) + 82800000 + 19800000 end as due_ms
  from src s join orders o on s.k = o.o_orderkey
), due as (select *, case when due_ms is not null then strftime(make_timestamp((due_ms + 28800000) * 1000), '%Y-%m-%dT%H:%M:%S') || '+08:00' end as due
  from sc)"""

IDENT = SCOUT + """, cur as (select *, 'u' || c as url from sc where section <> 'pendingRows'),
prev as (select 'u' || c as url, case when k % 9 = 4 then rid else id end as pid, cycle from sc where k % 10 <> 0),
al as (select 'u' || c as url, id, case when k % 900 = 4 then rid || 'x' else rid end as target from sc where k % 18 = 4 and k % 10 <> 0),
sim as (select 'u' || c as url, arg_min(sid, k) as target from sc where k % 10 = 0 group by c),
bycyc as (select url, cycle, count(*) as n_prev, min(pid) as only_prev, count(*) filter (exists (select 1 from cur x where x.url = prev.url and x.id = prev.pid)) as kept
  from prev group by url, cycle),
byurl as (select url, count(*) as n_rows, count(*) filter (exists (select 1 from al where al.url = cur.url and al.id = cur.id)) > 0 as assigned from cur group by url),
dec as (
  select cur.id, cur.url, cur.cycle, n_prev, only_prev, kept, n_rows, assigned, al.target as alias, sim.target as simple,
    exists (select 1 from prev where prev.url = cur.url and prev.cycle = cur.cycle and prev.pid = cur.id) as in_prev,
    exists (select 1 from prev where prev.url = cur.url and prev.cycle = cur.cycle and prev.pid = al.target) as alias_prev
  from cur left join bycyc on bycyc.url = cur.url and bycyc.cycle = cur.cycle join byurl on byurl.url = cur.url
    left join al on al.url = cur.url and al.id = cur.id left join sim on sim.url = cur.url
)"""

SQL = {
    "snapshot_diff": PAIR + "select project_id, change_type from cls where change_type is not null",
    "diff_counts": PAIR + """select count(*) filter (change_type = 'added') as added, count(*) filter (change_type = 'changed') as changed,
  count(*) filter (change_type = 'expired') as expired, count(*) filter (change_type = 'removed') as removed from cls""",
    "removed_ids": PAIR + "select project_id from old where project_id not in (select project_id from new)",
    "identity_sets": PAIR + """select (select count(*) from old where project_id not in (select project_id from new)) as only_left,
  (select count(*) from new where project_id not in (select project_id from old)) as only_right, false as equal""",
    "review_queue": PAIR + """select project_id, 'urgent-deadline' as reason, ms as deadline_ms from cls
  where change_type in ('added', 'changed') and new_ms > 899251200000 and new_ms < 899251200000 + 72 * 3600000
union all select project_id, 'removed', ms from cls where change_type = 'removed'
union all select project_id, 'promoted-from-pending', ms from cls join (select project_id from board where status = 'confirmed-unknown-deadline') using (project_id) where not is_removed
union all select project_id, 'field-conflict', ms from cls where not is_added and not is_removed and ms_differs
union all select c.project_id, 'shared-url-rename', c.ms from cls c join (select website from cls where is_added or is_removed group by website
   having count(*) filter (is_added) > 0 and count(*) filter (is_removed) > 0) w using (website) where c.is_added or c.is_removed""",
    "canonical_rows": FULL + "select project_id, " + row_json() + " as json from full_board",
    "row_fingerprint": FULL + "select project_id, sha256(" + row_json(
        description="trim(regexp_replace(description, '\\s+', ' ', 'g'))", verified="") + ") as fingerprint from full_board",
    "table_digest": FULL + ", r as (select feed_id, sha256(" + row_json() + """) as d from full_board),
 e as (select feed_id, d, count(*) as n from r group by 1, 2),
 l as (select feed_id, substr(d, 1, 6) as leaf, sha256(string_agg(d || 'x' || n, ',' order by d || 'x' || n)) as h, sum(n) as n from e group by 1, 2),
 m as (select feed_id, substr(leaf, 1, 3) as node, sha256(string_agg(leaf || ':' || h, ',' order by leaf || ':' || h)) as h, sum(n) as n from l group by 1, 2)
select feed_id, sha256(string_agg(node || ':' || h, ',' order by node || ':' || h)) as digest, cast(sum(n) as bigint) as n_rows from m group by 1""",
    "copy_digest": """with e as (select sha256(l_returnflag || '|' || l_linestatus) as d, count(*) as n from lineitem group by 1),
 l as (select substr(d, 1, 6) as leaf, sha256(string_agg(d || 'x' || n, ',' order by d || 'x' || n)) as h, sum(n) as n from e group by 1),
 m as (select substr(leaf, 1, 3) as node, sha256(string_agg(leaf || ':' || h, ',' order by leaf || ':' || h)) as h, sum(n) as n from l group by 1)
select sha256(string_agg(node || ':' || h, ',' order by node || ':' || h)) as digest, cast(sum(n) as bigint) as n_rows from m""",
    "snapshot_hashes": _SEAL + """select key as snapshot_key, computed as data_hash,
  strftime(make_timestamp(approved_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z-') || substr(computed, 1, 12) as snapshot_id from seal""",
    "snapshot_seals": _SEALS,
    "seal_after_changes": _FOLLOWING,
    "approved_snapshot": _APPROVED,
    "row_violations": MONTHLY + _ROWS,
    "feed_violations": MONTHLY + _FEEDS,
    "header_violations": MONTHLY + _HEADS,
    "count_violations": MONTHLY + _COUNTS,
    "order_violations": MONTHLY + _ORDER,
    "duplicate_ids": MONTHLY + _DUPS,
    "stored_snapshot_gate": _SEAL + ", rule_rows as (" + _ROWS + " union all " + _HEADS + " union all " + _COUNTS + " union all " + _DUPS
    + " union all select snapshot_key, path, rule from (" + _FEEDS + ")"
    + f""" union all select key, '', 'hash-match' from seal where data_hash <> computed
  union all select key, '', 'id-derived' from seal where snapshot_id <> strftime(make_timestamp(approved_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z-') || substr(computed, 1, 12)
  union all select key, '', 'private-value' from mon where k % 89 = 0 and k % 97 <> 0
  union all select snapshot_key, path, rule from (with x as (select 1) select * from ({{ORDER}}))
), g as (select snapshot_key, rule, count(*) as n from rule_rows group by 1, 2) select * from g""",
    "freshness": MONTHLY + """, f as (select snapshot_id, 899251200000 - scan_ms as sa, 899251200000 - approved_ms as aa, mo = 4 as bad,
   approved_ms < scan_ms as before from head)
select snapshot_id, sa as scan_age_ms, aa as approval_age_ms,
  bad or sa < 0 or aa < 0 or before or sa > 2592000000 or aa > 2592000000 as warn,
  bad or sa < 0 or aa < 0 or before or sa > 31536000000 or aa > 31536000000 as fail,
  case when bad then 'scanAt: expected a valid ISO timestamp' else concat_ws('; ',
    case when sa < 0 then 'scanAt: must not be in the future' end, case when aa < 0 then 'approvedAt: must not be in the future' end,
    case when before then 'approvedAt: must not be before scanAt' end,
    case when sa > 31536000000 then 'scanAt: is older than the maximum age' end,
    case when aa > 31536000000 then 'approvedAt: is older than the maximum age' end) end as errors from f""",
    "release_violations": MONTHLY + """select key as release_key, 'releaseSha' as path, 'has an invalid format' as message from head where mo = 1
  union all select key, 'snapshotId', 'has an invalid format' from head where mo = 12""",
    "release_identity": MONTHLY + """select key as release_key, 'error' as severity, 'snapshotId does not match the current snapshot' as message from head where mo = 12
  union all select key, 'error', 'dataHash does not match the current snapshot' from head where mo in (5, 6)
  union all select key, 'warning', 'release parity needs review' from head""",
    "lineage_orphans": MONTHLY + "select snapshot_id, previous_id from head where previous_id not in (select snapshot_id from head)",
    "publication_plan": MONTHLY + """, p as (select h.key, b.snapshot_id as base_id, b.data_hash as base_hash, h.snapshot_id, h.previous_id, h.data_hash, h.scan_at, h.mo, h.first_ms
  from head h join head b on h.key = case when b.mo % 4 = 0 then b.key else b.later end),
 s as (select *, case when data_hash = base_hash then 'no-change' when previous_id = base_id then 'ready' else 'broken-lineage' end as status from p)
select key as pair_key, status, snapshot_id, case when status = 'ready' then previous_id end as previous_id,
  case when status = 'ready' and mo <> 4 then key || '-01' end as scan_date, case when status = 'ready' then '19980701-000000' end as plan_stamp from s""",
    "disallowed_datasets": "select distinct source as name from documents where source not in ('src0', 'src1')",
    "iso_checks": """with p as (select o_orderkey as id, 1900 + o_orderkey % 200 as y, o_orderkey % 14 as mo, o_orderkey % 33 as d, o_orderkey % 26 as h,
   o_orderkey % 62 as mi, o_orderkey % 61 as s, case o_orderkey % 3 when 0 then 500 when 1 then 123 else 0 end as f, o_orderkey % 4 as z, o_orderkey % 19 = 0 as blank from orders),
 v as (select *, try_cast(y || '-' || printf('%02d', mo) || '-' || printf('%02d', d) as date) as dt from p),
 w as (select *, dt is not null and h <= 23 and mi <= 59 and s <= 59 and z <> 3 and not blank as ok from v)
select id, ok as valid, case when ok then epoch_ms(cast(dt as timestamp)) + h * 3600000 + mi * 60000 + s * 1000 + f
  - case z when 1 then 28800000 when 2 then -(23 * 60 + 59) * 60000 else 0 end end as ms from w""",
    "deadline_normalised": SCOUT + """select k as id, due as deadline,
  case when k % 6 <> 0 then '见官网' when st <> 'F' then '官方未公布具体时刻' else '未公布' end
   || case when k % 4 = 0 and st <> 'P' and not (k % 6 = 0 and st <> 'F') then '；官方未公布具体时刻' else '' end as original,
  due_ms as ms, true as valid from due where section <> 'pendingRows'""",
    "key_parts": BOARD + """select project_id, name not in ('NATION_4', 'NATION_5') as valid,
  case when name = 'NATION_5' then 'x' || substr(cycle, 2) else cycle end as cycle, institute from board""",
    "cycle_texts": """with y as (select o_orderkey as id, cast(year(o_orderdate) as varchar) as y, o_orderstatus = 'F' as e, o_orderkey % 6 as m from orders)
select id, case when m = 0 then y when m in (3, 5) and e then y end as cycle from y""",
    "fact_groups": SCOUT + """select k as id, case k % 5 when 0 then '2' when 1 then '一封、两封' when 2 then '两封' when 4 then '1.5' end as letters,
  case k % 8 when 0 then 'confirmed' when 1 then 'not-published' when 2 then 'unverified' when 3 then 'unverified' else 'not-published' end as logistics_status,
  case k % 8 when 0 then '住宿：统一安排住宿；餐食：提供午餐' when 2 then '待官方公布' when 3 then '待官方公布' else '未公布' end as logistics_summary,
  case when k % 5 = 3 then 'not-published' else 'confirmed' end as letters_status,
  case k % 5 when 0 then '推荐信数量：2' when 1 then '推荐信数量：一封、两封' when 2 then '推荐信数量：两封' when 4 then '推荐信数量：1.5' else '未公布' end as letters_summary
  from sc where section <> 'pendingRows'""",
    "identity_resolution": IDENT + """select id as input_id,
  case when n_prev is null then case when simple is null then id when substr(simple, 1, 4) = cycle then simple end
       when in_prev then id when n_rows > 1 and kept = n_prev then id
       when n_rows > 1 and not assigned then null when n_rows > 1 and alias is null then id
       when alias is null and n_prev = 1 then only_prev when alias is null then null
       when alias_prev then alias end as resolved_id,
  case when n_prev is null then case when simple is not null and substr(simple, 1, 4) <> cycle then 'simple alias target cycle must match the current row cycle' end
       when in_prev then null when n_rows > 1 and kept = n_prev then null
       when n_rows > 1 and not assigned then 'officialUrl has ambiguous previous IDs in a one-to-many rename; an explicit compound alias is required'
       when n_rows > 1 and alias is null then null when alias is null and n_prev = 1 then null
       when alias is null then 'officialUrl has ambiguous previous IDs; an explicit compound alias is required'
       when not alias_prev then 'compound alias must resolve to an approved ID for the shared URL' end as error from dec""",
    "alias_coverage": IDENT + """, cc as (select url, cycle, count(distinct id) as n_cur from cur group by url, cycle),
 miss as (select p.url, p.cycle, p.pid, n_cur, n_prev from prev p join cc using (url, cycle) join bycyc using (url, cycle)
   where not exists (select 1 from cur x where x.url = p.url and x.id = p.pid))
select pid as missing_id, (select count(distinct c.id) from cur c join al on al.url = c.url and al.id = c.id where c.url = miss.url and c.cycle = miss.cycle and al.target = miss.pid) as hits
from miss where not (n_prev = 1 and n_cur = 1)
  and (select count(distinct c.id) from cur c join al on al.url = c.url and al.id = c.id where c.url = miss.url and c.cycle = miss.cycle and al.target = miss.pid) <> 1""",
    "alias_violations": IDENT + """, n as (select (select count(*) from al) + (select count(*) from sim) + (select count(*) from sc where k % 500 = 7) as n)
select 'malformed compound alias' as message, count(*) as n from sc where k % 1000 = 7 having count(*) > 0
union all select 'alias URL must be a valid HTTP(S) URL', count(*) from sc where k % 500 = 7 and k % 1000 <> 7 having count(*) > 0
union all select 'compound alias target must be an approved ID in the validated previous snapshot', count(*) from al where target not in (select pid from prev) having count(*) > 0
union all select 'simple alias target must be an approved ID in the validated previous snapshot', count(*) from sim where target not in (select pid from prev) having count(*) > 0
union all select 'aliases exceed the entry limit', 1 from n where n > 10000""",
    "import_candidate": SCOUT + """, cand as (select *,
  case when not active then 'expired' when k % 47 = 0 then 'pending' when st = 'O' then 'confirmed-open' else 'confirmed-unknown-deadline' end as vs,
  case when k % 43 = 0 then null else cycle end as cyc from due where section <> 'pendingRows')
select row_number() over (order by case vs when 'confirmed-open' then 0 when 'confirmed-unknown-deadline' then 1 else 2 end,
    case when vs = 'confirmed-open' then due_ms end nulls last, id) - 1 as pos,
  id as project_id, 'camp' || cyc as feed_id, n_name as name, seg as institute,
  case when active then 'type ' || (k % 5) else '已过期活动' end as event_type, vs as status, due as deadline, due_ms as deadline_ms,
  '1998-06-30T00:00:00Z' as verified_at, case when k % 3 = 0 then 2 else 1 end as n_sources,
  case when not active then 'unknown' when k % 41 = 0 then null when k % 4 = 0 then 'online' when k % 4 = 1 then 'offline' when k % 4 = 2 then 'hybrid' else 'unknown' end as mode,
  case k % 8 when 0 then 'confirmed' when 1 then 'not-published' when 2 then 'unverified' when 3 then 'unverified' else 'not-published' end as logistics_status
from cand""",
    "import_header": SCOUT + """select 'camp' || max(case when active and k % 43 <> 0 and section <> 'pendingRows' then cast(cycle as integer) end) as default_feed,
  count(*) filter (section = 'mainRows' and k % 47 <> 0 and st = 'O') as confirmed_open,
  count(*) filter (section = 'mainRows' and k % 47 <> 0 and st = 'P') as confirmed_unknown_deadline,
  count(*) filter (section = 'pendingRows') as pending_excluded, count(*) filter (section = 'expiredRows') as expired from sc""",
    "import_feeds": SCOUT + """, c as (select distinct cycle from sc where k % 43 <> 0 and section <> 'pendingRows')
select row_number() over (order by cycle) - 1 as pos, 'camp' || cycle as id, '推免活动 ' || cycle as label, cycle as admission_cycle, 1998 as event_year from c""",
    "import_row_violations": SCOUT + """, r as (select *, section || '[' || k || ']' as p from sc where section <> 'pendingRows')
select p || '.eventMode' as path, 'mode' as rule from r where active and k % 41 = 0
union all select p || '.cycle', 'cycle' from r where k % 43 = 0
union all select p || '.verificationStatus', 'status' from r where k % 47 = 0""",
    "repeated_documents": """with h as (select doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h from documents)
select doc_id, h from (select *, row_number() over (partition by h order by doc_id) as rn from h) where rn > 1""",
    "private_rows": BOARD + """select 'snapshot.opportunities[' || k || '].description' as path, 'contains a email address' as message from board where k % 101 = 0
union all select 'snapshot.opportunities[' || k || '].description', 'contains a Chinese mainland mobile number' from board where k % 103 = 0 and k % 101 <> 0
union all select 'snapshot.opportunities[' || k || '].description', 'contains a file URI' from board where k % 107 = 0 and k % 103 <> 0 and k % 101 <> 0
union all select 'snapshot.opportunities[' || k || '].tags[0]', 'contains a user-local path' from board where k % 109 = 0""",
}
_ORDERED = _ORDER.split("\nselect key as snapshot_key", 1)
SQL["document_gate"] = _DOCUMENTS + _ORDERED[0] + "\n" + _DOCUMENT_ROWS + " union all " + _DOCUMENT_HEADS + " union all " + _DOCUMENT_FEEDS + " union all select key as snapshot_key" + _ORDERED[1]
_O = _ORDER.split("\nselect key as snapshot_key", 1)
SQL["stored_snapshot_gate"] = (
    _SEAL.replace(", rows as (", _O[0] + ", rows as (", 1)
    + SQL["stored_snapshot_gate"].split(_SEAL, 1)[1].replace(
        "(with x as (select 1) select * from ({ORDER}))", "(select key as snapshot_key" + _O[1] + ")"))


def _import_gate() -> str:
    """Numbers of violations of a whole import by rule, from the SQL of its parts."""
    identity = SQL["identity_resolution"].removeprefix(IDENT)
    cover, missing = SQL["alias_coverage"].removeprefix(IDENT).split("\nselect pid as missing_id", 1)
    aliases = "select 'malformed" + SQL["alias_violations"].split("\nselect 'malformed", 1)[1].split("\nunion all select 'aliases exceed", 1)[0]
    rows = SQL["import_row_violations"].removeprefix(SCOUT)
    return IDENT + cover + f""", found as (select resolved_id, error from ({identity}) z),
 r as (select *, section || '[' || k || ']' as p from cur), by_row as ({"select" + rows.split("select", 2)[2]}),
 missed as (select pid as missing_id{missing}), named as ({aliases}), gate as (
  select rule, count(*) as n from by_row group by rule
  union all select 'alias', cast(sum(n) as bigint) from named union all select 'alias-coverage', count(*) from missed
  union all select 'identity', count(*) from found where error is not null
  union all select 'key-unique', count(resolved_id) - count(distinct resolved_id) from found
  union all select 'required', (select count(*) from found where resolved_id is null) + (select count(*) from cur where k % 43 = 0)
  union all select 'arrangement-mode', count(*) from cur where active and k % 41 = 0
  union all select 'status-enum', count(*) from cur where active and k % 47 = 0
  union all select 'expired-past', count(*) from cur where not active and due_ms > 899251200000
  union all select 'open-future', count(*) from cur where st = 'O' and k % 47 <> 0 and due_ms <= 899251200000)
select rule, n from gate where n > 0"""


SQL["import_gate"] = _import_gate()
SQL["diff_files"] = SQL["snapshot_diff"]
SQL["snapshot_files"] = _DOCUMENTS + """, held as (select key, count(*) as n_rows, count(*) filter (k % 37 <> 0) as n_names, count(*) filter (k % 47 <> 0 or k % 31 = 0) as n_websites,
  sum(len(tags)) filter (k % 41 <> 0) as n_tags, count(*) filter (status = 'expired') as n_expired from mon group by key)
select key as snapshot_key, case when b % 13 <> 0 then '1998-07-01T00:00:00Z' end as scan_at, n_expired, n_rows, n_names, n_websites, cast(n_tags as bigint) as n_tags,
  n_feeds, case when b % 17 = 0 then 0 else n_feeds end as n_years from doc join held using (key)"""
