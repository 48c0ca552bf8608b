"""Registered lifecycle queries: one month of sightings applied to older state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..sources.tables import IDENTITY, fingerprint, observations
from .dashboards import OBSERVATIONS_SQL

CUT = datetime(2001, 3, 1)
END = datetime(2001, 4, 1)
_ORDER = ("observed_at", "okey", "line", "pkey", "skey", "price")


def _state_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).where(F.col("observed_at") < F.lit(CUT).cast("timestamp_ntz"))
    latest = obs.groupBy(*IDENTITY).agg(
        F.max_by(F.struct("category", "severity", "line", "st", "rf"), F.struct(*_ORDER)).alias("v"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
    )
    return latest.select(
        "repository_id", fingerprint(F.col("rule_id"), F.col("file_path")).alias("fingerprint"), "rule_id",
        "v.category", "v.severity", "file_path", "v.line", F.col("rule_id").alias("title"),
        F.when(F.col("v.st") == "O", "open").otherwise("resolved").alias("status"),
        F.when(F.col("v.rf") == "A", "confirmed").when(F.col("v.rf") == "R", "refuted").alias("verdict"),
        "first_seen_at", "last_seen_at",
        F.when(F.col("v.st") == "F", F.col("last_seen_at")).alias("resolved_at"),
    )


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(
        (F.col("observed_at") >= F.lit(CUT).cast("timestamp_ntz"))
        & (F.col("observed_at") < F.lit(END).cast("timestamp_ntz"))
    )


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines returned as accepted or not returned are reported again."""
    return _month(spark, sf_dir).where(F.col("rf") != "R").select(
        "repository_id", "fingerprint", "rule_id", "category", "severity", "file_path", "line",
        F.col("rule_id").alias("title"),
        F.when((F.col("rf") == "A") & (F.col("line") % 2 == 0), "likely").alias("verdict"),
        F.struct(*_ORDER).alias("seq"),
    )


def _examined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the month was read; line 7 means the whole file was."""
    lines = F.when(F.col("line") < 7, F.array("line"))
    return _month(spark, sf_dir).select("repository_id", F.col("file_path").alias("path"), lines.alias("lines"))


def new_findings(spark, sf_dir):
    rows = lc.new_findings(_state_before(spark, sf_dir), _batch(spark, sf_dir))
    return rows.select("repository_id", "fingerprint", "rule_id", "severity", "file_path", "line", "verdict")


def resolved(spark, sf_dir):
    return lc.resolved_findings(_state_before(spark, sf_dir), _batch(spark, sf_dir), _examined(spark, sf_dir))


def snapshot(spark, sf_dir):
    return lc.apply_scan(
        _state_before(spark, sf_dir), _batch(spark, sf_dir), _examined(spark, sf_dir), F.lit(END)
    )


def counts(spark, sf_dir):
    return lc.scan_counts(_state_before(spark, sf_dir), _batch(spark, sf_dir), _examined(spark, sf_dir))


#: Three months of scans, one for each repository and day.
LATER = datetime(2001, 6, 1)


def _quarter(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    seen = observations(spark, sf_dir).where(
        (F.col("observed_at") >= F.lit(CUT).cast("timestamp_ntz")) & (F.col("observed_at") < F.lit(LATER).cast("timestamp_ntz"))
    ).withColumn("scan", F.datediff(F.col("observed_at").cast("date"), F.lit(CUT.date())).cast("long"))
    day = F.date_add(F.lit(CUT.date()), (F.col("scan") + 1).cast("int")).cast("timestamp_ntz")
    times = seen.select("repository_id", "scan").distinct().withColumn("scanned_at", day)
    findings = seen.where(F.col("rf") != "R").select(
        "repository_id", "scan", "fingerprint", "rule_id", "category", "severity", "file_path", "line", F.col("rule_id").alias("title"),
        F.when((F.col("rf") == "A") & (F.col("line") % 2 == 0), "likely").alias("verdict"), F.struct(*_ORDER).alias("seq"),
    )
    examined = seen.select("repository_id", "scan", F.col("file_path").alias("path"), F.when(F.col("line") < 7, F.array("line")).alias("lines"))
    state = _state_before(spark, sf_dir)
    return {"state": state, "spans": lc.finding_spans(state, lc.fold_sightings(findings, times), examined, times)}


def folded_quarter(spark, sf_dir):
    """The state after all scans of three months, folded in one pass."""
    return lc.fold_state(**_quarter(spark, sf_dir))


def folded_quarter_counts(spark, sf_dir):
    return lc.fold_counts(_quarter(spark, sf_dir)["spans"])


def labels(spark, sf_dir):
    rows = lc.label_new(_batch(spark, sf_dir), _state_before(spark, sf_dir))
    return rows.groupBy("repository_id", "severity", "is_new").agg(F.count("*").alias("n"))


def repository_ids(spark, sf_dir):
    """Names for customers that have no repository row yet; ids are dense, so
    the set of ids is checked through its extent and the names themselves."""
    from ..sources.tables import read, repositories

    known = repositories(spark, sf_dir).withColumn("created_at", F.lit(CUT).cast("timestamp_ntz"))
    names = read(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name"))
    grown = lc.with_new_repositories(known, names, F.lit(END))
    return grown.agg(
        F.count("*").alias("repositories"),
        F.count_distinct("id").alias("ids"),
        F.max("id").alias("top_id"),
        F.count_if(F.col("created_at") == F.lit(END).cast("timestamp_ntz")).alias("created"),
    )


QUERIES = {
    "lifecycle_new": new_findings,
    "lifecycle_resolved": resolved,
    "lifecycle_scan_counts": counts,
    "lifecycle_labels": labels,
    "state_snapshot": snapshot,
    "repository_ids": repository_ids,
    "folded_quarter": folded_quarter,
    "folded_quarter_counts": folded_quarter_counts,
    "open_fingerprints": lambda spark, sf: lc.open_fingerprints(_state_before(spark, sf)),
}

_BASE = f"""with {OBSERVATIONS_SQL},
old as (
  select repository_id, fingerprint, rule_id, category, severity, file_path, line, rule_id title,
         case st when 'O' then 'open' else 'resolved' end status,
         case rf when 'A' then 'confirmed' when 'R' then 'refuted' end verdict,
         first_seen_at, last_seen_at, case when st='F' then last_seen_at end resolved_at
  from (select *, row_number() over (partition by repository_id,fingerprint
              order by observed_at desc,okey desc,line desc,pkey desc,skey desc,price desc) rn,
         min(observed_at) over (partition by repository_id,fingerprint) first_seen_at,
         max(observed_at) over (partition by repository_id,fingerprint) last_seen_at
        from obs where observed_at < date '2001-03-01') q where rn=1),
mon as (select * from obs where observed_at >= date '2001-03-01' and observed_at < date '2001-04-01'),
batch as (select *, rule_id title, case when rf='A' and line%2=0 then 'likely' end verdict from mon where rf<>'R'),
cand as (select * from old o where status='open' and not exists (
           select 1 from batch b where b.repository_id=o.repository_id and b.fingerprint=o.fingerprint)),
closed as (select * from cand o where
     exists (select 1 from mon m where m.repository_id=o.repository_id and m.file_path=o.file_path and m.line>=7)
  or exists (select 1 from mon m where m.repository_id=o.repository_id and m.file_path=o.file_path and m.line=o.line)),
fresh as (select * from batch b where not exists (select 1 from old o where o.status='open'
     and b.repository_id=o.repository_id and b.fingerprint=o.fingerprint))
"""

_QUARTER = f"""{_BASE},
qu as (select *, date_diff('day', date '2001-03-01', cast(observed_at as date)) scan
       from obs where observed_at >= date '2001-03-01' and observed_at < date '2001-06-01'),
told as (select *, row_number() over w_first first_rn, row_number() over w_last last_rn,
         case when rf='A' and line%2=0 then 'likely' end said
         from qu where rf<>'R'
         window w_first as (partition by repository_id,fingerprint,scan order by observed_at,okey,line,pkey,skey,price),
           w_last as (partition by repository_id,fingerprint,scan
             order by observed_at desc,okey desc,line desc,pkey desc,skey desc,price desc)),
sight as (select repository_id, fingerprint, scan, count(*) n,
          max(case when first_rn=1 then rule_id end) f_rule, max(case when first_rn=1 then category end) f_category,
          max(case when last_rn=1 then severity end) severity, max(case when last_rn=1 then file_path end) file_path,
          max(case when last_rn=1 then line end) line, max(case when last_rn=1 then rule_id end) title, max(said) said
          from told group by 1,2,3),
looked as (select distinct repository_id, scan, file_path, case when line>=7 then -1 else line end line from qu
           union select repository_id, scan, file_path, line from told),
stretch as (select *, lead(scan) over k next_scan, lead(n) over k next_n, lag(scan) over k is null leads from (
              select repository_id, fingerprint, scan, n, file_path, line, severity, title from sight
              union all select repository_id, fingerprint, -1, null, file_path, line, severity, title from old
                where status='open' and repository_id in (select repository_id from qu)) q
            window k as (partition by repository_id, fingerprint order by scan)),
ends as (select t.repository_id, t.fingerprint, t.scan, t.n, t.next_scan, t.next_n, t.leads, min(l.scan) closes
         from stretch t left join looked l on l.repository_id=t.repository_id and l.file_path=t.file_path
           and (l.line=-1 or l.line=t.line) and l.scan>t.scan and (t.next_scan is null or l.scan<t.next_scan)
         group by all)
"""

ORACLES = {
    "folded_quarter": f"""{_QUARTER},
        lastly as (select *, row_number() over (partition by repository_id, fingerprint order by scan desc) rn,
            min(scan) over (partition by repository_id, fingerprint) first_scan from sight),
        opening as (select repository_id, fingerprint, f_rule, f_category from (select *, row_number() over (
            partition by repository_id, fingerprint order by scan) rn from sight) q where rn=1),
        judged as (select repository_id, fingerprint, said from (select *, row_number() over (
            partition by repository_id, fingerprint order by scan desc) rn from sight where said is not null) q where rn=1),
        l as (select * from lastly where rn=1),
        e as (select repository_id, fingerprint, closes from (select *, row_number() over (
            partition by repository_id, fingerprint order by scan desc) rn from ends) q where rn=1)
        select repository_id, fingerprint, coalesce(o.rule_id, p.f_rule) rule_id, coalesce(o.category, p.f_category) category,
          coalesce(l.severity, o.severity) severity, coalesce(l.file_path, o.file_path) file_path, coalesce(l.line, o.line) line,
          coalesce(l.title, o.title) title,
          case when e.closes is not null then 'resolved' when l.scan is not null then 'open' else o.status end status,
          coalesce(j.said, o.verdict) verdict,
          coalesce(o.first_seen_at, timestamp '2001-03-02' + to_days(cast(l.first_scan as integer))) first_seen_at,
          coalesce(timestamp '2001-03-02' + to_days(cast(l.scan as integer)), o.last_seen_at) last_seen_at,
          case when e.closes is not null then timestamp '2001-03-02' + to_days(cast(e.closes as integer))
               when l.scan is null then o.resolved_at end resolved_at
        from old o full outer join l using (repository_id, fingerprint) left join opening p using (repository_id, fingerprint)
          left join judged j using (repository_id, fingerprint) left join e using (repository_id, fingerprint)""",
    "folded_quarter_counts": f"""{_QUARTER},
        parts as (
          select repository_id, scan, n reported, case when leads then n else 0 end new, 0 resolved from ends where scan>=0
          union all select repository_id, next_scan, 0, next_n, 0 from ends where closes is not null and next_scan is not null
          union all select repository_id, closes, 0, 0, 1 from ends where closes is not null)
        select repository_id, cast(scan as bigint) scan, cast(sum(reported) as bigint) findings_count,
          cast(sum(new) as bigint) new_findings_count, cast(sum(resolved) as bigint) resolved_findings_count
        from parts group by 1,2""",
    "lifecycle_new": f"{_BASE} select repository_id, fingerprint, rule_id, severity, file_path, line, verdict from fresh",
    "lifecycle_resolved": f"{_BASE} select repository_id, fingerprint, file_path, line from closed",
    "lifecycle_scan_counts": f"""{_BASE},
        b as (select repository_id, count(*) n from batch group by 1),
        f as (select repository_id, count(*) n from fresh group by 1),
        c as (select repository_id, count(*) n from closed group by 1),
        k as (select repository_id from b union select repository_id from c)
        select k.repository_id, coalesce(b.n,0) findings_count, coalesce(f.n,0) new_findings_count,
          coalesce(c.n,0) resolved_findings_count
        from k left join b using (repository_id) left join f using (repository_id) left join c using (repository_id)""",
    "lifecycle_labels": f"""{_BASE}
        select repository_id, severity, is_new, count(*) n from (
          select b.repository_id, b.severity, not exists (select 1 from old o where o.status='open'
             and o.repository_id=b.repository_id and o.fingerprint=b.fingerprint) is_new from batch b) q
        group by 1,2,3""",
    "state_snapshot": f"""{_BASE},
        ranked as (select *, row_number() over (partition by repository_id,fingerprint
             order by observed_at desc,okey desc,line desc,pkey desc,skey desc,price desc) rn from batch),
        latest as (select * from ranked where rn=1),
        judged as (select distinct on (repository_id, fingerprint) repository_id, fingerprint, verdict
             from batch where verdict is not null
             order by repository_id, fingerprint, observed_at desc,okey desc,line desc,pkey desc,skey desc,price desc)
        select repository_id, fingerprint,
          coalesce(o.rule_id, l.rule_id) rule_id, coalesce(o.category, l.category) category,
          coalesce(l.severity, o.severity) severity, coalesce(l.file_path, o.file_path) file_path,
          coalesce(l.line, o.line) line, coalesce(l.title, o.title) title,
          case when l.fingerprint is not null then 'open' when c.fingerprint is not null then 'resolved'
               else o.status end status,
          coalesce(j.verdict, o.verdict) verdict,
          coalesce(o.first_seen_at, timestamp '2001-04-01') first_seen_at,
          case when l.fingerprint is not null then timestamp '2001-04-01' else o.last_seen_at end last_seen_at,
          case when l.fingerprint is not null then null when c.fingerprint is not null then timestamp '2001-04-01'
               else o.resolved_at end resolved_at
        from old o full outer join latest l using (repository_id, fingerprint)
          left join judged j using (repository_id, fingerprint)
          left join closed c using (repository_id, fingerprint)""",
    "repository_ids": """select (select count(*) from nation)+count(*) repositories,
        (select count(*) from nation)+count(*) ids, (select max(n_nationkey) from nation)+count(*) top_id,
        count(*) created from (select distinct c_name from customer)""",
    "open_fingerprints": f"{_BASE} select repository_id, fingerprint from old where status='open'",
}
