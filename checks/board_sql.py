"""SQL counterparts of the board queries."""

AS_OF = 899251200000

BOARD = """
with src as (
  select o_orderkey as k, o_orderstatus as st, o_orderpriority as pri, c_mktsegment as seg, n_name, r_name,
         cast(year(o_orderdate) as varchar) as cycle, epoch_ms(date_trunc('day', o_orderdate)) as day_ms,
         cast(o_orderdate as date) as d, o_orderkey % 1440 as mins
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey
), board0 as (
  select k, mins, d, cycle, concat_ws('|', cycle, n_name, seg, 'o' || k) as project_id, 'camp' || cycle as feed_id,
         n_name as name, seg as institute, pri as project, 'type ' || (k % 5) as event_type,
         case st when 'F' then 'expired' when 'O' then 'confirmed-open' else 'confirmed-unknown-deadline' end as status,
         case when st <> 'P' then day_ms + mins * 60000 end as ms,
         case when k % 4 = 0 then '  note ' || k when k % 4 = 1 then ' ' else pri end as description,
         'https://' || lower(n_name) || '.example.edu/p/' || (k % 1000) as website,
         case when k % 17 <> 0 then r_name end as province, r_name,
         case k % 4 when 0 then 'online' when 1 then 'offline' when 2 then 'hybrid' else 'unknown' end as mode,
         k % 3 <> 0 as has_official,
         case when k % 13 = 0 then cast([] as varchar[])
              when k % 3 = 0 then [tier[k % 10 + 1], tier[(k + 3) % 10 + 1]] else [tier[k % 10 + 1]] end as tags
  from src, (select ['TOP2','港三','华五','C9','985','211','双非','四非','研究院','联培'] as tier)
), board1 as (
  select *, ms - 899251200000 as rem,
         case when status = 'expired' or (status = 'confirmed-open' and ms <= 899251200000) then 'expired'
              when status = 'confirmed-unknown-deadline' or ms is null then 'active-unknown'
              else 'active-timed' end as row_group
  from board0
), board as (
  select *, case when row_group = 'expired' then 'expired' when row_group = 'active-unknown' then 'unknown'
                 when rem < 86400000 then 'critical' when rem < 604800000 then 'soon'
                 when rem < 2592000000 then 'near' else 'far' end as urgency,
         case when row_group = 'expired' then '已结束' else '开放' end as label,
         lower(name || ' ' || institute || ' ' || project || ' ' || event_type) as hay
  from board1
)
"""

ORDER = """case row_group when 'active-timed' then 0 when 'active-unknown' then 1 else 2 end,
 case when row_group = 'active-timed' then ms end asc nulls last,
 case when row_group = 'expired' then ms end desc nulls last, project_id"""

TAGS = "(values " + ",".join(f"('{t}')" for t in
                             ("TOP2", "港三", "华五", "C9", "985", "211", "双非", "四非", "研究院", "联培")) + ") e(v)"
REGIONS = "(values " + ",".join(f"('{t}')" for t in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + ") e(v)"
_PROV = ("北京 浙江 上海 江苏 湖北 陕西 广东 四川 黑龙江 天津 山东 湖南 福建 安徽 江西 河南 辽宁 河北 山西 甘肃 "
         "云南 广西 贵州 新疆 海南 内蒙古 吉林 重庆 青海 宁夏 西藏").split()
PROVS = "(values " + ",".join(f"('{t}')" for t in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", *_PROV]) + ") e(v)"
MODES = "(values ('online'),('offline'),('hybrid'),('unknown')) e(v)"
STATUSES = "(values ('开放'),('已结束')) e(v)"


def _facet(name: str, enum: str, value: str, source: str = "board") -> str:
    return (f"select v as {name}, coalesce(n, 0) as n from {enum} left join "
            f"(select {value} as x, count(*) as n from {source} group by 1) c on c.x = e.v")


def _links(table: str, key: str, words: str) -> str:
    return f""", links as (
  select cast({key} as bigint) as filter_id, 'camp' || (1990 + {key} % 14) as src,
    case {key} % 3 when 0 then 'calendar' else 'list' end as view,
    case when {key} % 2 = 0 then ' ' || {words} else '' end as query,
    case {key} % 5 when 0 then ['985','211'] when 1 then ['C9'] else cast([] as varchar[]) end as tags,
    case {key} % 4 when 0 then ['开放'] when 1 then ['已结束'] else cast([] as varchar[]) end as status,
    case {key} % 3 when 0 then ['online','hybrid'] else cast([] as varchar[]) end as modes,
    case {key} % 7 when 0 then ['ASIA','EUROPE'] when 1 then ['AFRICA'] else cast([] as varchar[]) end as provinces
  from {table}
), filters as (
  select links.*, case when src in (select distinct feed_id from board) then src else 'camp1998' end as source from links
)"""


_MONTH = """, picked as (
  select date_trunc('month', make_timestamp(coalesce(min(case when row_group = 'active-timed' then ms end),
    min(case when row_group <> 'active-timed' then ms end), 899251200000) * 1000)) as first from board
), cells as (
  select i as cell, cast(first as date) - cast(isodow(first) - 1 as integer) + cast(i as integer) as day, first
  from picked, range(42) t(i)
)"""

SQL = {
    "board_ranked": BOARD + f"select project_id, row_group, ms as deadline_ms, row_number() over (order by {ORDER}) as pos from board",
    "board_next_k": BOARD + f"select project_id, row_group, rem as remaining_ms, urgency from board order by {ORDER} limit 100",
    "board_urgency": BOARD + "select urgency, row_group, count(*) as n, min(rem) as min_remaining, max(rem) as max_remaining from board group by 1, 2",
    "board_labels": BOARD + """select project_id, label as status_label,
  case when row_group = 'expired' then '已结束' end as expired_text,
  case mode when 'online' then '线上' when 'offline' then '线下' when 'hybrid' then '混合' else '未核验' end as mode_label,
  '未核验' as materials_label, case when has_official then '官方来源' else '历史来源（未核验）' end as source_label from board""",
    "deadline_texts": BOARD + """, t as (select *, case when ms is null then false else case k % 7
    when 0 then true when 1 then mins // 60 <> 12 when 2 then mins % 60 = 0 when 5 then mins = 1439
    when 6 then mins = 0 else false end end as states_time from board)
select project_id, states_time,
  case when ms is null then '未公布'
       when not states_time then year(d) || '年' || month(d) || '月' || day(d) || '日（官网未公布具体时刻）'
       when k % 7 = 6 then year(d - 1) || '年' || month(d - 1) || '月' || day(d - 1) || '日 24:00'
       else year(d) || '年' || month(d) || '月' || day(d) || '日 ' || printf('%02d:%02d', mins // 60, mins % 60) end as shown
from t""",
    "countdown_parts": BOARD + """, c as (select project_id, rem, greatest(rem, 0) as r from board),
 p as (select project_id, rem, case when rem is null then 0 else r // 86400000 end as days,
   case when rem is null then 0 else r % 86400000 // 3600000 end as hours,
   case when rem is null then 0 else r % 3600000 // 60000 end as minutes,
   case when rem is null then 0 else r % 60000 // 1000 end as seconds from c)
select project_id, days, hours, minutes, seconds,
  case when rem is null then 'N/A' when rem < 0 then '已结束'
       when days > 0 then days || '天 ' || printf('%02d:%02d:%02d', hours, minutes, seconds)
       else printf('%02d:%02d:%02d', hours, minutes, seconds) end as countdown,
  case when rem is null then '—' when rem < 0 then '已结束' when days > 0 then days || 'd ' || hours || 'h'
       when hours > 0 then hours || 'h ' || minutes || 'm' when minutes > 0 then minutes || 'm ' || seconds || 's'
       else seconds || 's' end as short,
  round(case when rem is null then 0.0 when rem < 0 then 1.0
        else greatest(0.0, least(1.0, 1 - rem / 7776000000.0)) end, 6) as progress from p""",
    "date_texts": BOARD + """, t as (select project_id, ms, make_timestamp((ms + 28800000) * 1000) as w from board)
select project_id, strftime(w, '%Y-%m-%d') as day_key,
  case when ms is null then '未公布' else year(w) || ' 年 ' || month(w) || '月 ' || day(w) || ' 日' end as long_text,
  case when ms is null then '—' else month(w) || '/' || day(w) end as short_text,
  case when ms is null then '—' else strftime(w, '%Y-%m-%d %H:%M') end as time_text,
  epoch_ms(date_trunc('day', w)) - 28800000 as day_start_ms, strftime(w, '%Y-%m-%d') as publication_day,
  year(w) as publication_year, strftime(make_timestamp(ms * 1000), '%Y%m%d-%H%M%S') as compact_utc from t""",
    "province_resolved": BOARD + "select project_id, coalesce(province, r_name) as province from board",
    "facet_status": BOARD + _facet("status", STATUSES, "label"),
    "facet_mode": BOARD + _facet("mode", MODES, "mode"),
    "facet_tags": BOARD + _facet("tag", TAGS, "t", "(select unnest(tags) as t from board)"),
    "facet_province": BOARD + _facet("province", PROVS, "r_name"),
    "facets_all": BOARD + " union all ".join([
        "select 'status' as facet, status as value, n from (" + _facet("status", STATUSES, "label") + ")",
        "select 'mode', mode, n from (" + _facet("mode", MODES, "mode") + ")",
        "select 'province', province, n from (" + _facet("province", REGIONS, "r_name") + ")",
        "select 'tag', tag, n from (" + _facet("tag", TAGS, "t", "(select unnest(tags) as t from board)") + ")",
    ]),
    "upcoming_counts": BOARD + """select count(*) filter (rem > 0 and rem < 604800000) as week,
  count(*) filter (rem > 0 and rem < 2592000000) as month, count(*) filter (rem > 0) as all_ahead from board""",
    "feed_counts": BOARD + "select feed_id, count(*) as n from board group by 1 union all select 'camp1990', 0",
    "snapshot_counts": BOARD + """select feed_id, count(*) filter (status = 'confirmed-open') as confirmed_open,
  count(*) filter (status = 'confirmed-unknown-deadline') as confirmed_unknown_deadline,
  count(*) filter (status = 'expired') as expired from board group by 1""",
    "group_sizes": BOARD + ", s as (" + _facet("row_group", "(values ('active-timed'),('active-unknown'),('expired')) e(v)", "row_group")
    + ") select row_group, n, (select count(*) > 1 from s where n > 0) as has_multiple from s",
    "visible_counts": BOARD + """select count(*) as total,
  count(*) filter (label = '开放' and mode in ('online','hybrid') and contains(hay, 'high')) as visible from board""",
    "tag_presence": BOARD + "select feed_id, max(len(tags)) > 0 as has_tags from board group by 1",
    "newest_active_cycle": BOARD + """select max(cast(cycle as bigint)) as cycle, 'camp' || max(cast(cycle as bigint)) as default_feed
  from board where status <> 'expired'""",
    "cycle_feeds": BOARD + """select distinct 'camp' || cycle as id, '推免活动 ' || cycle as label, cycle as admission_cycle,
  1998 as event_year from board""",
    "board_filtered": BOARD + """select project_id, urgency from board where contains(hay, 'machinery 2')
  and list_has_any(tags, ['985','211','C9']) and mode in ('online','offline') and r_name in ('ASIA','EUROPE')""",
    "board_search": BOARD + "select project_id from board where contains(hay, 'building 1-ur')",
    "board_by_tag": BOARD + "select project_id from board where list_contains(tags, 'TOP2')",
    "board_by_status": BOARD + "select project_id from board where label = '开放'",
    "board_by_mode": BOARD + "select project_id from board where mode = 'unknown'",
    "board_by_province": BOARD + "select project_id from board where r_name = 'AFRICA'",
    "feed_board": BOARD + "select project_id, row_group from board where feed_id = 'camp1998'",
    "point_lookup": BOARD + "select project_id, urgency from board where project_id = (select min(project_id) from board)",
    "publication_order": BOARD + """select feed_id, project_id, row_number() over (partition by feed_id order by
  case status when 'confirmed-open' then 0 when 'confirmed-unknown-deadline' then 1 else 2 end,
  case when status = 'confirmed-open' then ms end nulls last, project_id) as pos from board""",
    "board_detail": BOARD + """, t as (select *, case when ms is null then false else case k % 7
    when 0 then true when 1 then mins // 60 <> 12 when 2 then mins % 60 = 0 when 5 then mins = 1439
    when 6 then mins = 0 else false end end as states_time from board)
select project_id, case when k % 4 = 0 then 'note ' || k else '暂无补充说明' end as description,
  case when has_official then website end as official_url,
  case when ms is null then '未公布'
       when not states_time then year(d) || '年' || month(d) || '月' || day(d) || '日（官网未公布具体时刻）'
       when k % 7 = 6 then year(d - 1) || '年' || month(d - 1) || '月' || day(d - 1) || '日 24:00'
       else year(d) || '年' || month(d) || '月' || day(d) || '日 ' || printf('%02d:%02d', mins // 60, mins % 60) end as deadline_text,
  '已核验' as logistics_label from t""",
    "filter_params": BOARD + _links("customer", "c_custkey", "c_mktsegment") + """
select filter_id, source, view, query, array_to_string(tags, ',') as tags, array_to_string(status, ',') as status,
  array_to_string(modes, ',') as modes, array_to_string(provinces, ',') as provinces from filters""",
    "saved_filter_matches": BOARD + _links("nation", "n_nationkey", "n_name") + """
select filter_id, project_id from filters f join board b on f.source = b.feed_id
  and (len(f.tags) = 0 or list_has_any(b.tags, f.tags)) and (len(f.status) = 0 or list_contains(f.status, b.label))
  and (len(f.modes) = 0 or list_contains(f.modes, b.mode)) and (len(f.provinces) = 0 or list_contains(f.provinces, b.r_name))
  and contains(b.hay, lower(trim(f.query)))""",
    "calendar_pick": BOARD + _MONTH + """select 'shown' as which, strftime(first, '%Y-%m-%d') as first_day from picked
  union all select 'previous', strftime(first - interval 1 month, '%Y-%m-%d') from picked
  union all select 'next', strftime(first + interval 1 month, '%Y-%m-%d') from picked""",
    "calendar_month": BOARD + _MONTH + """, n as (select strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as dk, count(*) as n from board where ms is not null group by 1)
select cell, strftime(day, '%Y-%m-%d') as date_key, month(day) = month(first) as in_month,
  strftime(day, '%Y-%m-%d') = '1998-07-01' as is_today, coalesce(n, 0) as n, greatest(coalesce(n, 0) - 3, 0) as overflow
from cells left join n on dk = strftime(day, '%Y-%m-%d')""",
    "calendar_preview": BOARD + _MONTH + """, r as (select strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as date_key, project_id, urgency,
  row_number() over (partition by strftime(make_timestamp(ms * 1000), '%Y-%m-%d') order by ms,
    case row_group when 'active-timed' then 0 when 'active-unknown' then 1 else 2 end, project_id) as rank
  from board where ms is not null)
select date_key, rank, project_id, urgency from r where rank <= 3 and date_key in (select strftime(day, '%Y-%m-%d') from cells)""",
}
