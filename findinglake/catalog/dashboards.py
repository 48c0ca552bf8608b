"""Registered history queries over the star schema, with their SQL oracles."""

from __future__ import annotations

from datetime import datetime

from ..plans import dashboard as d
from ..sources.tables import PART_CATEGORIES, star_store

AS_OF = datetime(2001, 12, 1)
MONTH = d.StatsFilter(as_of=AS_OF, days=30)
QUARTER = d.StatsFilter(as_of=datetime(2001, 5, 29), days=90)
YEAR = d.StatsFilter(as_of=datetime(2001, 8, 1), days=365)
ONE_REPO = d.StatsFilter(as_of=datetime(2001, 8, 1), days=180, repository="NATION_3")


def _q(fn, *args, **kwargs):
    return lambda spark, sf_dir: fn(star_store(spark, sf_dir), *args, **kwargs)


QUERIES = {
    "open_by_group": _q(d.open_by_group, MONTH),
    "open_by_group_one_repository": _q(d.open_by_group, ONE_REPO),
    "open_marginals": _q(d.open_marginals, MONTH),
    "overview": _q(d.overview, YEAR),
    "overview_one_repository": _q(d.overview, ONE_REPO),
    "trend_daily": _q(d.trend, QUARTER),
    "trend_daily_by_severity": _q(d.trend, ONE_REPO, by_severity=True),
    "category_trend": _q(d.category_trend, QUARTER),
    "top_rules": _q(d.top_rules, MONTH, limit=25),
    "repository_summaries": lambda spark, sf: d.repository_summaries(star_store(spark, sf), limit=20),
    "recent_scans": _q(d.recent_scans, MONTH, limit=15),
    "open_findings": _q(d.open_findings, MONTH, limit=50),
    "triage_by_verdict": _q(d.triage_by_verdict, YEAR),
    "triage_accuracy": _q(d.triage_accuracy, YEAR),
    "noisiest_rules": _q(d.noisiest_rules, YEAR, limit=50),
    "known_repositories": lambda spark, sf: d.known_repositories(star_store(spark, sf)),
}

#: Single figures of the overview, each a query of its own.
_FIGURES = (
    "total_resolved", "introduced_in_window", "resolved_in_window", "scans_in_window", "repositories_tracked",
    "mean_time_to_resolve_hours", "median_open_age_days",
)


def _figure(column):
    return lambda spark, sf_dir: d.overview(star_store(spark, sf_dir), QUARTER).select(column)


QUERIES |= {f"figure_{column}": _figure(column) for column in _FIGURES}

OBSERVATIONS_SQL = """
obs as (
  select cast(c.c_nationkey as bigint) repository_id, concat(p.p_type,'/',p.p_brand) rule_id, p.p_type category,
         case substr(o.o_orderpriority,1,1) when '1' then 'critical' when '2' then 'high'
              when '3' then 'medium' when '4' then 'low' else 'info' end severity,
         concat('f',cast(l.l_suppkey % 5 as varchar)) file_path, l.l_linenumber line,
         substr(sha256(concat(p.p_type,'/',p.p_brand,' f',cast(l.l_suppkey % 5 as varchar))),1,20) fingerprint,
         o.o_orderdate observed_at, l.l_shipdate shipdate, l.l_linestatus st, l.l_returnflag rf,
         o.o_orderkey okey, l.l_partkey pkey, l.l_suppkey skey, l.l_extendedprice price
  from lineitem l join orders o on l.l_orderkey=o.o_orderkey
       join customer c on o.o_custkey=c.c_custkey join part p on l.l_partkey=p.p_partkey)"""

STATE_SQL = f"""with {OBSERVATIONS_SQL},
latest as (
  select *, row_number() over (partition by repository_id,fingerprint
              order by observed_at desc,okey desc,line desc,pkey desc,skey desc,price desc) rn,
         min(observed_at) over (partition by repository_id,fingerprint) first_seen_at,
         max(observed_at) over (partition by repository_id,fingerprint) last_seen_at from obs),
finding_state as (
  select repository_id,fingerprint,rule_id,category,severity,file_path,line,rule_id title,
         case st when 'O' then 'open' else 'resolved' end status,
         case rf when 'A' then 'confirmed' when 'R' then 'refuted' end verdict,
         first_seen_at,last_seen_at,
         case when st='F' then greatest(last_seen_at,shipdate) end resolved_at
  from latest where rn=1),
repositories as (select cast(n_nationkey as bigint) id, n_name full_name from nation),
scans as (
  select o_orderkey id, cast(c_nationkey as bigint) repository_id, o_custkey pull_request_number,
         substr(sha256(cast(o_orderkey as varchar)),1,12) head_sha, concat('review ',o_orderstatus) title,
         c_name author, o_custkey%30 files_scanned, o_orderkey%40 findings_count,
         o_orderkey%7 new_findings_count, o_orderkey%5 resolved_findings_count,
         o_orderkey%9000 duration_ms, o_orderdate created_at
  from orders join customer on o_custkey=c_custkey),
s as (select fs.*, r.full_name from finding_state fs join repositories r on r.id=fs.repository_id)
"""


def _overview_sql(as_of: str, days: int, where: str) -> str:
    severities = ",\n".join(
        f"count(*) filter (where status='open' and severity='{s}') open_severity_{s}"
        for s in ("critical", "high", "medium", "low", "info")
    )
    categories = ",\n".join(
        f"count(*) filter (where status='open' and category='{c}') open_category_{c.lower()}" for c in PART_CATEGORIES
    )
    since = f"timestamp '{as_of}' - interval {days} day"
    return f"""{STATE_SQL},
t as (select * from s where {where}),
ages as (select (epoch(timestamp '{as_of}')-epoch(first_seen_at))/86400.0 age from t where status='open')
select count(*) filter (where status='open') total_open,
  count(*) filter (where status='resolved') total_resolved,
  {severities}, {categories},
  count(*) filter (where first_seen_at >= {since}) introduced_in_window,
  count(*) filter (where resolved_at >= {since}) resolved_in_window,
  round(avg(epoch(resolved_at)-epoch(first_seen_at))/3600.0,1) mean_time_to_resolve_hours,
  (select count(*) from scans sc join repositories r on r.id=sc.repository_id
     where created_at >= {since} and {where}) scans_in_window,
  count(distinct repository_id) repositories_tracked,
  (select round(median(age),1) from ages) median_open_age_days
from t"""


def _trend_sql(first: str, after: str, where: str, extra: str = "") -> str:
    return f"""{STATE_SQL},
t as (select * from s where {where}),
spine as (select cast(unnest(range(date '{first}', date '{after}', interval 1 day)) as date) d),
i as (select cast(first_seen_at as date) d, count(*) n,
        count(*) filter (where severity='critical') critical, count(*) filter (where severity='high') high,
        count(*) filter (where severity='medium') medium, count(*) filter (where severity='low') low,
        count(*) filter (where severity='info') info
      from t where first_seen_at >= date '{first}' group by 1),
x as (select cast(resolved_at as date) d, count(*) n from t where resolved_at >= date '{first}' group by 1),
c as (select count(*) carried from t where first_seen_at < date '{first}'
        and (resolved_at is null or resolved_at >= date '{first}')),
j as (select spine.d, coalesce(i.n,0) introduced, coalesce(x.n,0) resolved, carried,
        coalesce(critical,0) critical, coalesce(high,0) high, coalesce(medium,0) medium,
        coalesce(low,0) low, coalesce(info,0) info
      from spine left join i on i.d=spine.d left join x on x.d=spine.d, c),
p as (select *, carried+sum(introduced-resolved) over (order by d rows unbounded preceding) pr from j)
select d as date, introduced, resolved,
  cast(pr-least(0,min(pr) over (order by d rows unbounded preceding)) as bigint) as open{extra} from p"""


_SEV_ORDER = """case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2
                 when 'low' then 3 else 4 end"""
_YEAR_SINCE = "timestamp '2001-08-01' - interval 365 day"

ORACLES = {
    "open_by_group": f"{STATE_SQL} select severity, category, count(*) as count from s where status='open' group by 1,2",
    "open_by_group_one_repository": f"""{STATE_SQL} select severity, category, count(*) as count
        from s where status='open' and full_name='NATION_3' group by 1,2""",
    "open_marginals": f"""{STATE_SQL},
        o as (select * from s where status='open')
        select 'total' as dimension, 'all' as value, count(*) as count from o
        union all select 'severity', severity, count(*) from o group by 2
        union all select 'category', category, count(*) from o group by 2""",
    "overview": _overview_sql("2001-08-01", 365, "true"),
    "overview_one_repository": _overview_sql("2001-08-01", 180, "full_name='NATION_3'"),
    "trend_daily": _trend_sql("2001-03-01", "2001-05-30", "true"),
    "trend_daily_by_severity": _trend_sql(
        "2001-02-03", "2001-08-02", "full_name='NATION_3'", ", critical, high, medium, low, info"
    ),
    "category_trend": f"""{STATE_SQL},
        spine as (select cast(unnest(range(date '2001-03-01', date '2001-05-30', interval 1 day)) as date) d),
        i as (select cast(first_seen_at as date) d, {", ".join(
            f"count(*) filter (where category='{c}') {c.lower()}" for c in PART_CATEGORIES)}
          from s where first_seen_at >= date '2001-03-01' group by 1)
        select spine.d as date, {", ".join(f"coalesce({c.lower()},0) as {c.lower()}" for c in PART_CATEGORIES)}
        from spine left join i on i.d=spine.d""",
    "top_rules": f"""{STATE_SQL}
        select rule_id, category, severity, count(*) filter (where status='open') as open, count(*) as total
        from s group by 1,2,3 order by open desc, total desc, rule_id, category, severity limit 25""",
    "repository_summaries": f"""{STATE_SQL}
        select r.full_name,
          coalesce(sum(case when status='open' then 1 else 0 end),0)::bigint as open,
          coalesce(sum(case when status='open' and severity='critical' then 1 else 0 end),0)::bigint as critical,
          coalesce(sum(case when status='open' and severity='high' then 1 else 0 end),0)::bigint as high,
          (select max(created_at) from scans where repository_id=r.id) as last_scan_at,
          (select count(*) from scans where repository_id=r.id) as scans
        from repositories r left join finding_state f on f.repository_id=r.id
        group by r.id, r.full_name order by critical desc, high desc, open desc, full_name limit 20""",
    "recent_scans": f"""{STATE_SQL}
        select sc.id, r.full_name as repository, pull_request_number, head_sha, title, author, findings_count,
          new_findings_count, resolved_findings_count, files_scanned, duration_ms, created_at
        from scans sc join repositories r on r.id=sc.repository_id
        order by created_at desc, sc.id desc limit 15""",
    "open_findings": f"""{STATE_SQL}
        select fingerprint, full_name as repository, rule_id, category, severity, title, file_path,
          first_seen_at, last_seen_at,
          cast(floor((epoch(timestamp '2001-12-01')-epoch(first_seen_at))/86400) as int) as age_days
        from s where status='open'
        order by {_SEV_ORDER}, first_seen_at, repository_id, fingerprint limit 50""",
    "triage_by_verdict": f"""{STATE_SQL} select verdict, count(*) as count from s
        where verdict is not null and first_seen_at >= {_YEAR_SINCE} group by 1""",
    "triage_accuracy": f"""{STATE_SQL} select count(*) as judged,
          count(*) filter (where verdict='refuted') as refuted,
          count(*) filter (where verdict='refuted') / nullif(count(*),0)::double as refutation_rate
        from s where verdict is not null and first_seen_at >= {_YEAR_SINCE}""",
    "noisiest_rules": f"""{STATE_SQL} select rule_id, count(*) as judged,
          count(*) filter (where verdict='refuted') as refuted,
          count(*) filter (where verdict='refuted')::double / count(*) as refutation_rate
        from s where verdict is not null and first_seen_at >= {_YEAR_SINCE}
        group by 1 having count(*) >= 3 and count(*) filter (where verdict='refuted') > 0
        order by refutation_rate desc, refuted desc, rule_id limit 50""",
    "known_repositories": f"{STATE_SQL} select full_name from repositories",
}

ORACLES |= {f"figure_{column}": f"select {column} from ({_overview_sql('2001-05-29', 90, 'true')}) q" for column in _FIGURES}
