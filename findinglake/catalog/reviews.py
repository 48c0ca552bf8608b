"""Registered review-shaping queries: dedup, caps, plans, triage, reports.

One review per repository; its findings are the first sightings of each
fingerprint in the star schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values.enums import CONFIDENCES, SEVERITIES
from ..functions.ranks import confidence_rank, severity_rank
from ..operators import excerpts as ex
from ..operators import planning as pl
from ..plans import report as rp
from ..sources.tables import IDENTITY, fingerprint, observations, read
from .dashboards import OBSERVATIONS_SQL

KEYS = ["repository_id"]
_ORDER = ("observed_at", "okey", "line", "pkey", "skey", "price")
OVERRIDES = {"ECONOMY/Brand#11": "info", "PROMO": "low", "LARGE/Brand#3": "critical"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sighting per (repository, fingerprint), reduced on the map side."""
    obs = observations(spark, sf_dir).withColumn(
        "confidence", F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), (F.col("pkey") % 3 + 1).cast("int"))
    )
    payload = F.struct("category", "severity", "confidence", "line", "rf", "pkey", "okey")
    first = obs.groupBy(*IDENTITY).agg(F.min_by(payload, F.struct(*_ORDER)).alias("f"))
    rows = first.select(
        "repository_id", fingerprint(F.col("rule_id"), F.col("file_path")).alias("fingerprint"), "rule_id", "file_path", "f.*",
        F.when(F.col("f.rf") == "A", "confirmed").when(F.col("f.rf") == "R", "refuted").alias("verdict"),
    )
    order = F.struct(
        severity_rank(F.col("severity")).alias("s"), confidence_rank(F.col("confidence")).alias("c"),
        "file_path", "line", "fingerprint",
    )
    return rows.withColumn("ord", order)


def _full(spark, sf_dir):
    """Findings with the text columns a report needs."""
    return findings(spark, sf_dir).select(
        "*",
        F.concat(F.lit("Title "), "rule_id").alias("title"),
        F.concat(F.lit("About "), "category").alias("description"),
        F.concat(F.lit("Fix "), "category").alias("remediation"),
        F.array(F.concat(F.lit("CWE-"), (F.length("rule_id")).cast("string"))).alias("cwe"),
        (F.col("line") + F.col("pkey") % 3).cast("int").alias("end_line"),
        F.concat(F.lit("code "), "fingerprint").alias("snippet"),
        F.when(F.col("verdict").isNotNull(), F.concat(F.lit("because "), "rf")).alias("reasoning"),
        F.lit(None).cast("string").alias("fix"),
        F.when(F.col("verdict").isNotNull(), F.lit("high")).alias("triage_confidence"),
        F.when(F.col("verdict").isNotNull(), F.lit("m1")).alias("model"),
    )


def rank_and_cap(spark, sf_dir):
    capped = pl.first_n(findings(spark, sf_dir), ["repository_id", "file_path"], ["ord"], 25)
    return capped.select("repository_id", "fingerprint", "rule_id", "severity", "confidence", "file_path", "line")


def severity_override(spark, sf_dir):
    changed = pl.override_severity(findings(spark, sf_dir), OVERRIDES)
    return changed.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def sarif_caps(spark, sf_dir):
    return pl.cap_results(findings(spark, sf_dir), KEYS, 8, 600).select("repository_id", "fingerprint", "rule_id")


def _comments(spark, sf_dir):
    text = F.concat(F.lit("Please look. "), rp.marker(F.col("fingerprint")))
    return observations(spark, sf_dir).where(F.col("okey") % 11 == 0).select("repository_id", text.alias("body"))


def _shown_lines(spark, sf_dir):
    return observations(spark, sf_dir).where((F.col("okey") % 3 == 0) & (F.col("line") <= 4)).select(
        "repository_id", "file_path", "line"
    )


def _plan(spark, sf_dir):
    return pl.inline_plan(
        _full(spark, sf_dir), _shown_lines(spark, sf_dir), _comments(spark, sf_dir), KEYS, 15, "medium"
    )


def inline_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("repository_id", "fingerprint", "plan")


def inline_comments(spark, sf_dir):
    return rp.inline_bodies(_plan(spark, sf_dir)).select("repository_id", "file_path", "line", "body")


def posted_markers(spark, sf_dir):
    return pl.posted_fingerprints(_comments(spark, sf_dir), KEYS)


def triage_selection(spark, sf_dir):
    picked = pl.select_for_triage(findings(spark, sf_dir), KEYS, 40, "medium")
    return picked.select("repository_id", "fingerprint", "severity", "confidence")


def _verdicts(spark, sf_dir):
    wanted = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("okey") % 5 + 1).cast("int"))
    sure = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), (F.col("okey") % 3 + 1).cast("int"))
    return findings(spark, sf_dir).where(F.col("verdict").isNotNull()).select(
        "repository_id", "fingerprint", "verdict",
        F.concat(F.lit("because "), "rf").alias("reasoning"), F.lit(None).cast("string").alias("fix"),
        pl.adjusted_severity(F.col("severity"), wanted, sure).alias("severity"), sure.alias("confidence"),
        F.lit("m1").alias("model"),
    )


def _triaged(spark, sf_dir):
    return pl.apply_verdicts(findings(spark, sf_dir).drop("verdict"), _verdicts(spark, sf_dir), KEYS)


def triage_apply(spark, sf_dir):
    return _triaged(spark, sf_dir).select(
        "repository_id", "fingerprint", "severity", "severity_changed_from", "verdict", "t_confidence"
    )


def triage_counts(spark, sf_dir):
    return pl.triage_summary(_triaged(spark, sf_dir), KEYS)


def status(spark, sf_dir):
    return rp.status_lines(findings(spark, sf_dir), KEYS, "high")


def worst(spark, sf_dir):
    counts = rp.severity_tally(KEYS, findings(spark, sf_dir).withColumn("verdict", F.lit(None).cast("string")))
    return counts.select("repository_id", *SEVERITIES, rp.severity_of_rank(F.col("worst_rank")).alias("worst"))


def _capped(spark, sf_dir):
    return pl.cap_results(_full(spark, sf_dir), KEYS)


def sarif_rules(spark, sf_dir):
    return rp.sarif_rules(_capped(spark, sf_dir), KEYS).withColumn("tags", F.array_join("tags", ","))


def sarif_results(spark, sf_dir):
    capped = _capped(spark, sf_dir)
    return rp.sarif_results(capped, rp.sarif_rules(capped, KEYS), KEYS).drop("ord")


def sarif_documents(spark, sf_dir):
    texts = rp.sarif_documents(_full(spark, sf_dir), KEYS, "findinglake", "1", "https://example.com")
    return texts.select(
        "repository_id",
        F.get_json_object("sarif", "$.version").alias("version"),
        F.get_json_object("sarif", "$.runs[0].results[0].partialFingerprints.securityReviewFingerprint").alias("first"),
        F.size(F.from_json(F.get_json_object("sarif", "$.runs[0].results"), "array<string>")).alias("results"),
        F.size(F.from_json(F.get_json_object("sarif", "$.runs[0].tool.driver.rules"), "array<string>")).alias("rules"),
    )


def comment_table(spark, sf_dir):
    return rp.table_rows(_full(spark, sf_dir), KEYS).drop("ord")


def _reviews(spark, sf_dir):
    r = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        r.cast("long").alias("repository_id"), (r + 1).alias("files_scanned"), (r * 700).alias("duration_ms"),
        (r % 3).alias("resolved"), (r % 2).alias("n_inline"),
    )


def review_comments(spark, sf_dir):
    """Repositories 0 to 2 have few findings, so every part of the comment comes up empty somewhere."""
    rows = _full(spark, sf_dir).where((F.col("repository_id") > 2) | (F.length("rule_id") - 2 == F.col("repository_id") * 20))
    rows = rows.withColumn("is_new", F.col("pkey") % 2 == 0).withColumn(
        "severity_changed_from", F.when(F.col("verdict").isNotNull() & (F.col("pkey") % 5 == 0), F.lit("low"))
    )
    texts = rp.review_comments(rows, _reviews(spark, sf_dir), KEYS, "high")
    return texts.select("repository_id", F.sha2("body", 256).alias("body"), "hidden_severe", "hidden_other", "hidden_refuted")


def triage_requests(spark, sf_dir):
    """One request per file: the excerpt around the findings chosen for a second opinion, and those findings."""
    keys = ["repository_id", "file_path"]
    picked = pl.select_for_triage(findings(spark, sf_dir), KEYS, 40, "medium")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.concat(F.lit("row "), n.cast("string"))), "\n")
    files = observations(spark, sf_dir).select(*keys).distinct().withColumn("content", text)
    asked = ex.triage_requests(files, picked, keys, 1, 120)
    return asked.select(*keys, F.sha2("excerpt", 256).alias("excerpt"), F.array_join("findings.fingerprint", ",").alias("findings"))


def _places(spark, sf_dir):
    """Findings spread over 400-line files."""
    return observations(spark, sf_dir).select(
        "repository_id", "file_path",
        (F.col("pkey") % 400 + 1).cast("int").alias("line"),
        F.when(F.col("okey") % 5 == 0, (F.col("pkey") % 400 + 3).cast("int")).alias("end_line"),
    )


def _lengths(spark, sf_dir):
    return observations(spark, sf_dir).select("repository_id", "file_path", F.lit(400).alias("n_lines")).distinct()


def excerpt_windows(spark, sf_dir):
    keys = ["repository_id", "file_path"]
    merged = ex.merged_windows(_places(spark, sf_dir), _lengths(spark, sf_dir), keys, 3)
    return ex.clipped_windows(merged, keys, 120).drop("island")


QUERIES = {
    "rank_and_cap": rank_and_cap,
    "severity_override": severity_override,
    "sarif_caps": sarif_caps,
    "sarif_rules": sarif_rules,
    "sarif_results": sarif_results,
    "sarif_documents": sarif_documents,
    "inline_plan": inline_plan,
    "inline_comments": inline_comments,
    "posted_markers": posted_markers,
    "comment_table": comment_table,
    "triage_selection": triage_selection,
    "triage_apply": triage_apply,
    "triage_counts": triage_counts,
    "status_lines": status,
    "severity_counts": worst,
    "review_comments": review_comments,
    "triage_requests": triage_requests,
    "excerpt_windows": excerpt_windows,
}

_SEV = "list_position(['critical','high','medium','low','info'], severity)"
_CONF = "list_position(['high','medium','low'], confidence)"
_BASE = f"""with {OBSERVATIONS_SQL},
first_seen as (select *, row_number() over (partition by repository_id, fingerprint
    order by observed_at, okey, line, pkey, skey, price) rn from obs),
f0 as (select repository_id, fingerprint, rule_id, category, severity,
    (['high','medium','low'])[cast(pkey%3+1 as int)] confidence, file_path, line, rf, pkey, okey,
    case rf when 'A' then 'confirmed' when 'R' then 'refuted' end verdict from first_seen where rn=1),
f as (select *, row_number() over (partition by repository_id
    order by {_SEV}, {_CONF}, file_path, line, fingerprint) ord from f0)
"""
def _capped_sql(per_rule: int, total: int) -> str:
    return f"""{_BASE},
c1 as (select * from (select *, row_number() over (partition by repository_id, rule_id order by ord) rr from f) q where rr<={per_rule}),
c as (select * from (select *, row_number() over (partition by repository_id order by ord) rt from c1) q where rt<={total}),
ruleset as (select repository_id, rule_id, row_number() over (partition by repository_id order by rule_id)-1 rule_index,
    min({_SEV})-1 worst_rank, count(*) results, arg_min(category, ord) category, arg_min(confidence, ord) as "precision"
    from c group by repository_id, rule_id)
"""


_CAPPED = _capped_sql(1000, 25000)
_PLAN = f"""{_BASE},
posted as (select distinct repository_id, fingerprint from obs where okey%11=0),
shown as (select distinct repository_id, file_path, line from obs where okey%3=0 and line<=4),
g as (select f.*, p.fingerprint is not null posted,
   p.fingerprint is null and s.line is not null and coalesce(verdict,'')<>'refuted' and {_SEV}<=3 eligible
   from f left join posted p using (repository_id, fingerprint) left join shown s using (repository_id, file_path, line)),
n as (select *, sum(case when eligible then 1 else 0 end) over (partition by repository_id order by ord
   rows unbounded preceding) k from g),
planned as (select *, case when posted then 'already' when eligible and k<=15 then 'comment' else 'deferred' end as plan from n)
"""
_TRIAGED = f"""{_BASE},
v as (select *, (['critical','high','medium','low','info'])[cast(okey%5+1 as int)] wanted,
   (['high','medium','low'])[cast(okey%3+1 as int)] sure from f),
t as (select *, case when verdict is not null and sure='high' then
   (['critical','high','medium','low','info'])[greatest({_SEV}-1, least({_SEV}+1,
      list_position(['critical','high','medium','low','info'], wanted)))] else severity end settled from v)
"""
_LEVEL = "(['error','error','warning','note','none'])"
_COUNTS = ", ".join(f"count(*) filter (where severity='{s}') {s}" for s in SEVERITIES)
_ACTIVE = ", ".join(
    f"count(*) filter (where severity='{s}' and coalesce(verdict,'')<>'refuted') {s}" for s in SEVERITIES
)

_ICON = f"(['🔴','🟠','🟡','🔵','⚪'])[{_SEV}]"
_DETAIL = f"""concat_ws(chr(10)||chr(10), concat('### ', {_ICON}, ' Title ', rule_id),
  concat_ws(' · ', concat('`', file_path, ':', line, '`'), category, concat(severity, ' severity'), concat(confidence, ' confidence'),
    case when verdict is not null then concat(case verdict when 'confirmed' then 'Confirmed on review' else 'Judged a false positive' end,
      case when pkey%5=0 then ' (severity was low)' else '' end) end,
    case when pkey%2=0 then 'new in this change' end, concat('CWE-', length(rule_id))),
  concat('```', chr(10), 'code ', fingerprint, chr(10), '```'),
  case when verdict is not null then concat('because ', rf) else concat('About ', category) end, concat('**Fix.** Fix ', category),
  case when verdict is not null then concat('In general: About ', category, ' Fix ', category) end,
  case when verdict is null and confidence='low' then concat('_Low confidence: if the code around it handles this, write `security-review-ignore ',
    rule_id, '` and a reason on the line above._') end,
  concat('<sub>', rule_id, ' · ', fingerprint, case when verdict is not null then ' · judged by m1' else '' end, '</sub>'))"""
_COMMENTS = f"""{_BASE},
p as (select *, case when verdict='refuted' then 'refuted' when severity in ('critical','high') then 'severe' else 'other' end part
      from f where repository_id>2 or length(rule_id)-2=repository_id*20),
q as (select *, row_number() over (partition by repository_id, part order by ord) n from p),
t as (select repository_id,
  string_agg({_DETAIL}, chr(10)||chr(10) order by n) filter (where part='severe' and n<=40) severe_text,
  string_agg(concat('| ', {_ICON}, ' ', severity, ' | Title ', rule_id, ' | `', file_path, ':', line, '` | ', rule_id, ' |'), chr(10) order by n)
    filter (where part='other' and n<=50) other_text,
  string_agg(concat('- `', file_path, ':', line, '` Title ', rule_id, ': because ', rf), chr(10) order by n)
    filter (where part='refuted' and n<=50) refuted_text,
  count(*) filter (where part='severe') severe, count(*) filter (where part='other') other, count(*) filter (where part='refuted') refuted,
  {", ".join(f"count(*) filter (where part<>'refuted' and severity='{s}') {s}" for s in SEVERITIES)} from q group by 1),
r as (select cast(n_nationkey as bigint) repository_id, n_nationkey k, coalesce(severe,0) severe, coalesce(other,0) other, coalesce(refuted,0) refuted,
  coalesce(severe,0)+coalesce(other,0) active, severe_text, other_text, refuted_text,
  concat_ws(' · ', {", ".join(f"case when {s}>0 then concat('{i} ', {s}, ' {s}') end" for s, i in rp.SEVERITY_ICONS.items())}) tally
  from nation left join t on t.repository_id=n_nationkey),
w as (select *, greatest(severe-40,0) hs, greatest(other-50,0) ho, greatest(refuted-50,0) hr from r)
select repository_id, sha256(concat_ws(chr(10)||chr(10), concat('## Security review: ', active, ' finding', case when active=1 then '' else 's' end),
    case when active=0 then concat('No findings on the changed lines of ', k+1, ' file', case when k=0 then '' else 's' end, ', in ',
      case when k*700<1000 then concat(k*700, 'ms') else printf('%.1fs', k*700/1000.0) end, '.') else tally end,
    case when severe>0 then concat('> ', severe, ' finding', case when severe=1 then '' else 's' end, ' at high or worse: the check fails.') end,
    case when active>0 and k%2=1 then '1 finding commented inline too.' end, severe_text,
    case when hs>0 then concat('_', hs, ' more of high severity left out._') end,
    case when other>0 then concat('| Severity | Finding | Place | Rule |', chr(10), '| --- | --- | --- | --- |', chr(10), other_text) end,
    case when ho>0 then concat('_and ', ho, ' more._') end,
    case k%3 when 1 then '1 earlier finding resolved.' when 2 then '2 earlier findings resolved.' end,
    case when refuted>0 then concat('Judged false positives:', chr(10), refuted_text) end,
    case when hr>0 then concat('_and ', hr, ' more._') end)) body, hs hidden_severe, ho hidden_other, hr hidden_refuted from w"""

ORACLES = {
    "review_comments": _COMMENTS,
    "triage_requests": f"""{_BASE}, s as (select * from (
          select *, row_number() over (partition by repository_id order by {_SEV}, {_CONF} desc, ord) k from f where {_SEV}<=3) q where k<=40),
        c as (select distinct repository_id, file_path, unnest(range(greatest(1, line-1), least(40, line+1)+1)) ln from s),
        g as (select *, ln - row_number() over (partition by repository_id, file_path order by ln) island from c),
        w as (select repository_id, file_path, min(ln) lo, string_agg(concat(lpad(cast(ln as varchar), 5, ' '), '  row ', ln), chr(10) order by ln) body
              from g group by repository_id, file_path, island),
        x as (select repository_id, file_path, sha256(string_agg(body, concat(chr(10), '    ...', chr(10)) order by lo)) excerpt from w group by 1, 2),
        a as (select repository_id, file_path, string_agg(fingerprint, ',' order by k) findings from s group by 1, 2)
        select repository_id, file_path, excerpt, findings from x join a using (repository_id, file_path)""",
    "rank_and_cap": f"""{_BASE} select repository_id, fingerprint, rule_id, severity, confidence, file_path, line
        from (select *, row_number() over (partition by repository_id, file_path order by ord) k from f) q where k<=25""",
    "severity_override": f"""{_BASE} select rule_id, case
          when rule_id='ECONOMY/Brand#11' then 'info' when rule_id='LARGE/Brand#3' then 'critical'
          when category='PROMO' then 'low' else severity end severity, count(*) n from f group by 1,2""",
    "sarif_caps": f"{_capped_sql(8, 600)} select repository_id, fingerprint, rule_id from c",
    "sarif_rules": f"""{_CAPPED} select repository_id, rule_id, cast(rule_index as int) rule_index,
          concat(upper(category[1]), category[2:], 'Brand', regexp_extract(rule_id, '[0-9]+$')) as name,
          {_LEVEL}[worst_rank+1] as level,
          case worst_rank when 0 then '9.5' when 1 then '8.0' when 2 then '5.5' when 3 then '2.0' end security_severity,
          "precision", category, cast(null as varchar) analyzer,
          concat('Title ', rule_id) title, concat('About ', category) description, concat('Fix ', category) remediation,
          concat('security,category/', category, ',external/cwe/cwe-', length(rule_id)) tags, results from ruleset""",
    "sarif_results": f"""{_CAPPED} select c.repository_id, c.rule_id, cast(r.rule_index as int) rule_index,
          {_LEVEL}[{_SEV}] as level,
          case when verdict is null then concat('Title ',c.rule_id,'. About ',c.category)
               when verdict='refuted' then concat('Title ',c.rule_id,'. Judged a false positive on review: because ',rf,
                 ' The rule''s general concern: About ',c.category)
               else concat('Title ',c.rule_id,'. because ',rf) end message,
          file_path, greatest(1,line) start_line, case when pkey%3>0 then cast(line+pkey%3 as int) end end_line,
          concat('code ',fingerprint) snippet, fingerprint, severity, confidence, c.category, verdict,
          case when verdict is not null then 'high' end triage_confidence, case when verdict is not null then 'm1' end model
        from c join ruleset r using (repository_id, rule_id)""",
    "sarif_documents": f"""{_BASE} select repository_id, '2.1.0' as version, arg_min(fingerprint, ord) as first,
          cast(count(*) as int) results, cast(count(distinct rule_id) as int) rules from (
            select *, row_number() over (partition by repository_id, rule_id order by ord) k from f) q
          where k<=1000 group by 1""",
    "inline_plan": f"{_PLAN} select repository_id, fingerprint, plan from planned",
    "inline_comments": f"""{_PLAN} select repository_id, file_path, line,
          concat('<!-- security-review:finding:', fingerprint, ' -->', chr(10),
            case severity when 'critical' then '🔴' when 'high' then '🟠' when 'medium' then '🟡' end, ' **Title ', rule_id,
            '**', chr(10), chr(10), case when verdict is not null then concat('because ', rf) else concat('About ', category) end,
            chr(10), chr(10), '**Fix.** Fix ', category, chr(10), chr(10), '<sub>', severity, ' severity · ', category, ' · ',
            rule_id, '</sub>') body
        from planned where plan='comment'""",
    "posted_markers": f"{_PLAN} select repository_id, fingerprint from posted",
    "comment_table": f"""{_BASE},
        l as (select *, row_number() over (partition by repository_id order by ord) k,
              count(*) over (partition by repository_id) total
              from f where severity not in ('critical','high') and coalesce(verdict,'')<>'refuted')
        select repository_id, concat(severity,' | Title ',rule_id,' | ',file_path,':',line,' | ',rule_id) as row,
          greatest(total-50,0) hidden from l where k<=50""",
    "triage_selection": f"""{_BASE} select repository_id, fingerprint, severity, confidence from (
          select *, row_number() over (partition by repository_id order by {_SEV}, {_CONF} desc, ord) k from f
          where {_SEV}<=3) q where k<=40""",
    "triage_apply": f"""{_TRIAGED} select repository_id, fingerprint, settled severity,
          case when settled<>severity then severity end severity_changed_from, verdict,
          case when verdict is not null then sure end t_confidence from t""",
    "triage_counts": f"""{_TRIAGED} select repository_id, count(*) findings, count(verdict) triaged,
          count(*) filter (where verdict='refuted') refuted from t group by 1""",
    "status_lines": f"""{_BASE},
        k as (select repository_id, {_ACTIVE}, count(*) filter (where coalesce(verdict,'')<>'refuted') active,
          count(*) filter (where verdict='refuted') refuted,
          count(*) filter (where coalesce(verdict,'')<>'refuted' and severity in ('critical','high')) blocking
          from f group by 1)
        select *, case when blocking>0 then 'failure' else 'success' end as state,
          case when active=0 then 'No security findings on the changed lines' else substr(concat(
            concat_ws(', ', case when critical>0 then concat(critical,' critical') end,
              case when high>0 then concat(high,' high') end, case when medium>0 then concat(medium,' medium') end,
              case when low>0 then concat(low,' low') end, case when info>0 then concat(info,' info') end),
            ' (', case when blocking>0 then concat(blocking,' blocking') else 'none blocking' end, ')'),1,140) end as text from k""",
    "severity_counts": f"""{_BASE} select repository_id, {_COUNTS},
          (['critical','high','medium','low','info'])[min({_SEV})] worst from f group by 1""",
    "excerpt_windows": f"""with {OBSERVATIONS_SQL},
        p as (select repository_id, file_path, cast(greatest(1, pkey%400+1-3) as int) start,
              cast(least(400, case when okey%5=0 then pkey%400+3 else pkey%400+1 end + 3) as int) stop
              from obs),
        covered as (select distinct repository_id, file_path, unnest(range(start, stop+1)) ln from p),
        isl as (select *, ln - row_number() over (partition by repository_id, file_path order by ln) g from covered),
        w as (select repository_id, file_path, min(ln) start, max(ln) stop from isl group by repository_id, file_path, g),
        u as (select *, coalesce(sum(stop-start+1) over (partition by repository_id, file_path order by start
                rows between unbounded preceding and 1 preceding),0) used,
                sum(stop-start+1) over (partition by repository_id, file_path) wanted from w)
        select repository_id, file_path, cast(start as int) start, cast(least(stop, start+120-used-1) as int) stop,
          wanted>120 truncated from u where used<120""",
}
