"""Registered queries over patches, deliveries, answers and versions, all made
from rows of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values.advisories import ADVISORIES, POPULAR_NPM_PACKAGES
from ..fixed_values.enums import CONFIDENCES, SEVERITIES, VERDICTS
from ..functions.versions import compare, key_is_affected, key_or_null, lowest_version
from ..operators.dependency_rules import lookalikes
from ..operators.excerpts import excerpts
from ..operators.verdicts import parse_verdicts
from ..sources import advisories as adv
from ..sources import patches as pt
from ..sources.tables import read, spread
from ..sources.webhooks import parse_events, signature_state
from .texts import _scrubbed_sql


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(values, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick_sql(values, key: str) -> str:
    return "([" + ",".join(_q(v) for v in values) + f"])[cast(({key}) % {len(values)} + 1 as int)]"


# --- patches ---------------------------------------------------------------------------------


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-hunk patch per order; its numbers come from the order's keys."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = c % 90 + 1, c % 90 + 2
    body = _text(
        "index 1..2\n@@ -", a, ",3 +", b, ",4 @@ def f", o, "():\n keep ", o, "\n-old ", o, "\n+new ", o, "\n+more\n tail\n",
        "@@ -", a + 100, " +", b + 105, ",2 @@\n+++x\n\\ No newline at end of file\n-gone ", c, "\n",
    )
    return spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(o.alias("id"), c.alias("c"), body.alias("patch"))


def patch_lines(spark, sf_dir):
    return pt.numbered_lines(patches(spark, sf_dir).select("id", "patch"), ["id"])


def patch_lines_in_row(spark, sf_dir):
    parsed = patches(spark, sf_dir).select("id", F.explode(pt.parsed_lines(F.col("patch"))).alias("l"))
    return parsed.select("id", "l.*")


def patch_facts(spark, sf_dir):
    p = F.col("p")
    once = F.explode(F.array(pt.parsed_lines(F.col("patch")))).alias("p")
    parsed = patches(spark, sf_dir).select("id", "patch", once)
    return parsed.select(
        "id",
        F.array_join(pt.changed_lines(p).cast("array<string>"), ",").alias("changed"),
        F.array_join(pt.commentable_lines(p).cast("array<string>"), ",").alias("commentable"),
        F.array_join(F.map_values(pt.removed_lines(p)), "|").alias("removed"),
        F.sha2(pt.reconstructed(p), 256).alias("rebuilt"),
        F.array_join(F.transform(pt.hunks(F.col("patch")), lambda h: _text(h["old_count"], "/", h["new_count"], "/", h["header"])), ";").alias("hunks"),
    )


_PATCH_SQL = """with o as (select o_orderkey id, o_custkey c, o_custkey%90+1 a, o_custkey%90+2 b from orders),
l as (
 select id, 1 hunk, 'context' kind, concat('keep ',id) content, b new_line, a old_line, 2 as position from o
 union all select id,1,'del',concat('old ',id),null,a+1,3 from o
 union all select id,1,'add',concat('new ',id),b+1,null,4 from o
 union all select id,1,'add','more',b+2,null,5 from o
 union all select id,1,'context','tail',b+3,a+2,6 from o
 union all select id,2,'add','++x',b+105,null,8 from o
 union all select id,2,'del',concat('gone ',c),null,a+100,9 from o
 union all select id,2,'context','',b+106,a+101,10 from o)
"""
_PATCH_LINES_SQL = f"""{_PATCH_SQL} select id, cast(hunk as int) hunk, kind, content, cast(new_line as int) new_line,
  cast(old_line as int) old_line, cast(position as int) as position from l"""


def review_inputs(spark, sf_dir):
    """Scan inputs of a change, content known for every second file."""
    key = F.col("id")
    files = patches(spark, sf_dir).select(
        key.alias("file_idx"), _text("src/f", key, ".py").alias("file_path"),
        _pick(("added", "modified", "removed", "renamed", "unchanged"), key).alias("status"),
        F.lit(3).alias("additions"), "patch", F.when(key % 2 == 0, _text("whole ", key)).alias("content"),
    )
    out = pt.review_inputs(files)
    return out.select(
        "file_path", "status", F.array_join(F.col("changed_lines").cast("array<string>"), ",").alias("changed"),
        F.sha2("content", 256).alias("content"),
    )


def split_diffs(spark, sf_dir):
    """A three-file diff per customer, taken apart again."""
    c = F.col("c_custkey")
    diff = _text(
        "diff --git a/x y b/x y\nindex 1..2 100644\n--- a/x y\n+++ b/x y\n@@ -1 +1 @@\n-a", c, "\n+b", c, "\n",
        "diff --git a/gone b/gone\ndeleted file mode 100644\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n",
        "diff --git a/p b/n\nsimilarity index 90%\nrename from p\nrename to n\n--- a/p\n+++ b/dir/n", c, "\n@@ -2,2 +2,3 @@ t\n k\n+", "m\n\\ No newline at end of file\n",
    )
    return pt.split_multi_file_diff(spread(read(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", diff.alias("diff")), ["c_custkey"])


# --- deliveries ---------------------------------------------------------------------------------

_ACTIONS = ("opened", "closed", "synchronize", "ready_for_review", "labeled")
_EVENTS = ("pull_request", "pull_request", "pull_request", "ping", "push")


def _deliveries(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    body = F.struct(
        _pick(_ACTIONS, e).alias("action"),
        u.alias("number"),
        F.struct(
            F.when(e % 3 == 0, e).alias("number"), (e % 7 == 0).alias("draft"),
            F.struct(F.when(e % 11 != 0, _text("sha", e)).alias("sha")).alias("head"),
        ).alias("pull_request"),
        F.struct(F.col("event_type").alias("name"), F.struct(_text("user", u).alias("login")).alias("owner")).alias("repository"),
    )
    return read(spark, sf_dir, "events").select(
        e.alias("delivery"), _pick(_EVENTS, u + e).alias("event"), F.to_json(body).alias("payload")
    )


def webhook_events(spark, sf_dir):
    return parse_events(_deliveries(spark, sf_dir))


def webhook_signatures(spark, sf_dir):
    """Events whose signature column is right, wrong, absent or malformed."""
    rows = read(spark, sf_dir, "events").select("event_id", "props")
    header = (
        F.when(F.col("event_id") % 4 == 0, F.lit("sha256=00"))
        .when(F.col("event_id") % 4 == 1, F.lit("md5=1"))
        .when(F.col("event_id") % 4 == 2, F.lit(None))
        .otherwise(F.lit("sha256=" + "0" * 64))
    )
    states = rows.select(signature_state(F.col("props"), header, "demo").alias("state"))
    return states.groupBy("state").agg(F.count("*").alias("n"))


# --- verdicts -----------------------------------------------------------------------------------


def _turns(spark, sf_dir):
    """One answer per turn: every third as a tool call, the rest inside text."""
    key = F.col("conv_id") * 100 + F.col("turn")
    item = F.struct(
        _text("fp", key % 50).alias("fingerprint"),
        _pick((*VERDICTS, "maybe"), key).alias("verdict"),
        F.when(key % 13 != 0, F.col("text")).otherwise(F.lit(" \n\t ")).alias("reasoning"),
        F.when(key % 2 == 0, F.lit(" patch it ")).alias("fix"),
        _pick(SEVERITIES, key).alias("severity"),
        _pick((*CONFIDENCES, "sure"), key).alias("confidence"),
    )
    # Beside the item: no objects, and the same finding with a number for its reasoning.
    wrong = F.to_json(F.struct(_text("fp", key % 50).alias("fingerprint"), F.lit("refuted").alias("verdict"), key.alias("reasoning")))
    answer = F.concat(F.lit('{"findings":["oops",7,null,'), F.to_json(item), F.lit(","), wrong, F.lit("]}"))
    turns = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(key % 3 == 0, answer).alias("tool_json"),
        F.when(key % 3 != 0, F.concat("text", F.lit(" {"), answer.substr(F.lit(2), F.length(answer)), F.lit(" }} end"))).alias("text"),
        F.lit("m1").alias("model"),
    )
    return turns


def verdict_answers(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", _text("fp", (F.col("conv_id") * 100 + F.col("turn")) % 50).alias("fingerprint"),
        _pick(SEVERITIES, F.col("turn")).alias("severity"),
    ).where(F.col("conv_id") % 4 != 1)
    return parse_verdicts(_turns(spark, sf_dir), asked, ["conv_id", "turn"])


# --- versions and advisories -----------------------------------------------------------------------


def _declared(spark, sf_dir):
    """A package and a range per lineitem."""
    name = _pick([a[1] for a in ADVISORIES], F.col("l_partkey"))
    eco = _pick([a[0] for a in ADVISORIES], F.col("l_partkey"))
    number = _text(
        F.col("l_suppkey") % 12, ".", F.col("l_partkey") % 31, ".", F.col("l_quantity").cast("int"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("-rc.1")).otherwise(F.lit("")),
    )
    sign = _pick(("", "^", "~", ">=", "v", "= "), F.col("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select(
        eco.alias("ecosystem"), F.upper(name).alias("name"), F.concat(sign, number).alias("range")
    )


def version_affected(spark, sf_dir):
    """Declarations per advisory that admit an affected version.

    Equal declarations are counted first; a version is parsed once per distinct
    range, and an advisory's bounds once per advisory.
    """
    index = adv.bundled(spark).select(
        "ecosystem", F.lower("name").alias("key"), "cve",
        key_or_null(F.col("fixed_in")).alias("fixed_key"), key_or_null(F.col("introduced_in")).alias("intro_key"),
    )
    distinct = (
        _declared(spark, sf_dir)
        .groupBy("ecosystem", F.lower("name").alias("key"), "range")
        .agg(F.count("*").alias("n"))
        .select("ecosystem", "key", "n", F.explode(F.array(lowest_version(F.col("range")))).alias("low"))
        .select("*", F.explode(F.array(key_or_null(F.col("low")))).alias("low_key"))
    )
    hit = key_is_affected(F.col("low_key"), F.col("fixed_key"), F.col("intro_key"))
    return (
        distinct.join(F.broadcast(index), ["ecosystem", "key"])
        .groupBy("cve")
        .agg(
            F.sum("n").alias("declared"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("affected"),
            F.min("low").alias("least_text"),
        )
    )


def version_order(spark, sf_dir):
    """Each lineitem's version against a second one made from its other keys."""
    left = _text(F.col("l_suppkey") % 4, ".", F.col("l_partkey") % 3)
    right = _text(F.col("l_linenumber") % 4, ".", F.col("l_orderkey") % 3, F.when(F.col("l_orderkey") % 2 == 0, ".0").otherwise("-beta"))
    return read(spark, sf_dir, "lineitem").groupBy(compare(left, right).alias("sign")).agg(F.count("*").alias("n"))


def typosquat(spark, sf_dir):
    """Part keys turned into package names, some one edit from a popular one."""
    k = F.col("p_partkey")
    base = _pick(POPULAR_NPM_PACKAGES, k)
    at = (k % 4 + 1).cast("int")
    name = (
        F.when(k % 5 == 0, base)
        .when(k % 5 == 1, F.concat(base.substr(F.lit(1), at), F.lit("q"), base.substr(at + 1, F.lit(99))))
        .when(k % 5 == 2, F.concat(base.substr(F.lit(1), at - 1), base.substr(at + 1, F.lit(99))))
        .when(k % 5 == 3, F.concat(base, F.lit("xy")))
        .otherwise(F.concat(F.lit("z"), base.substr(F.lit(2), F.lit(99))))
    )
    listed = spark.createDataFrame([(p, at) for at, p in enumerate(POPULAR_NPM_PACKAGES)], "name string, place int")
    named = read(spark, sf_dir, "part").select(k.alias("part"), name.alias("name"))
    return lookalikes(named, listed).where("near is not null").select("part", "name", "near")


def _questions(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.floor(k / 40).alias("batch_id"), (k % 40).cast("int").alias("position"),
        _pick(("npm", "pypi"), k).alias("ecosystem"), _text("Pkg", k).alias("name"), _text("1.", k % 7).alias("version"),
    )


def _cache(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").where(k % 3 == 0).select(
        _pick(("npm", "pypi"), k).alias("ecosystem"), _text("pkg", k).alias("name"), _text("1.", k % 7).alias("version"),
        F.array(F.struct(_text("CVE-", k).alias("cve"))).alias("advisories"),
        F.when(k % 2 == 0, F.lit("2001-12-02")).otherwise(F.lit("2001-11-30")).cast("timestamp_ntz").alias("expires_at"),
    )


def advisory_cache(spark, sf_dir):
    as_of = F.lit("2001-12-01").cast("timestamp_ntz")
    answered, pending = adv.split_cached(_questions(spark, sf_dir), _cache(spark, sf_dir), as_of)
    return answered.select("name", F.lit("cached").alias("state")).unionByName(pending.select("name", F.lit("pending").alias("state")))


def _answers(spark, sf_dir):
    """Ids per question, in positional batches of forty; every seventh batch is short."""
    q = _questions(spark, sf_dir)
    k = F.col("batch_id") * 40 + F.col("position")
    ids = F.when(k % 3 == 0, F.array(_text("A", k % 600 * 2), _text("B", k % 40 * 2 + 1))).otherwise(F.array().cast("array<string>"))
    ordered = q.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("position", ids.alias("ids")))).alias("all"))
    whole = F.transform("all", lambda x: x["ids"])
    results = F.when(F.col("batch_id") % 7 == 0, F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole)
    return adv.match_positions(q, ordered.select("batch_id", results.alias("results")))


def _details(spark, sf_dir):
    """One description per supplier: id, JSON text; the fix is on record for one package of each even id."""
    s = F.col("s_suppkey")
    body = F.struct(
        F.when(s % 5 != 0, _text(_pick(("A", "B"), s), s)).alias("id"),
        F.when(s % 2 == 0, F.array(F.lit("GHSA-1"), _text("CVE-2024-", s))).alias("aliases"),
        F.when(s % 3 != 0, _text("First ", s, "\r\nsecond")).alias("summary"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), _pick(("9.8", "CVSS:3.1/AV:N", "5"), s).alias("score"))).alias("severity"),
        F.struct(F.when(s % 4 == 0, _pick(("high", "MODERATE"), F.floor(s / 4))).alias("severity")).alias("database_specific"),
        F.array(F.struct(
            F.struct(_pick(("npm", "PyPI"), F.floor(s / 2)).alias("ecosystem"), _text("PKG", F.floor(s / 2)).alias("name")).alias("package"),
            F.array(F.struct(F.array(F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed")),
                                     F.struct(F.lit(None).cast("string").alias("introduced"), _text("1.2.", s).alias("fixed"))).alias("events"))).alias("ranges"),
        )).alias("affected"),
    )
    return read(spark, sf_dir, "supplier").select(_text(_pick(("A", "B"), s), s).alias("id"), F.to_json(body).alias("body"))


def advisory_positions(spark, sf_dir):
    return _answers(spark, sf_dir).select("batch_id", "position", "name", F.array_join("ids", ",").alias("ids"))


def advisory_ids(spark, sf_dir):
    return adv.ids_to_fetch(_answers(spark, sf_dir))


def advisory_details(spark, sf_dir):
    found = adv.attach_details(_answers(spark, sf_dir), _details(spark, sf_dir))
    return found.groupBy("cve", "severity", "fixed_in", "summary").agg(F.count("*").alias("n"))


# --- excerpts ----------------------------------------------------------------------------------------


def _document_excerpts(spark, sf_dir, max_lines):
    """Windows of two lines around two lines of each document, whole text in."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    size = F.size(F.split("content", "\n"))
    first = docs.select("doc_id", (F.col("doc_id") % size + 1).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"))
    second = docs.select("doc_id", (F.col("doc_id") * 7 % size + 1).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"))
    cut = excerpts(docs, first.unionByName(second), ["doc_id"], 2, max_lines)
    return cut.select("doc_id", F.sha2("text", 256).alias("digest"), "start_line", "end_line", "truncated")


def document_excerpts(spark, sf_dir):
    return _document_excerpts(spark, sf_dir, 10)


def document_excerpts_clipped(spark, sf_dir):
    """The same with a budget of eight lines, which overlong excerpts exceed."""
    return _document_excerpts(spark, sf_dir, 8)


QUERIES = {
    "patch_lines": patch_lines,
    "patch_lines_in_row": patch_lines_in_row,
    "patch_facts": patch_facts,
    "review_inputs": review_inputs,
    "split_diffs": split_diffs,
    "webhook_events": webhook_events,
    "webhook_signatures": webhook_signatures,
    "verdict_answers": verdict_answers,
    "version_affected": version_affected,
    "version_order": version_order,
    "typosquat": typosquat,
    "advisory_cache": advisory_cache,
    "advisory_positions": advisory_positions,
    "advisory_ids": advisory_ids,
    "advisory_details": advisory_details,
    "document_excerpts": document_excerpts,
    "document_excerpts_clipped": document_excerpts_clipped,
}

_POPULAR_SQL = "[" + ",".join(_q(p) for p in POPULAR_NPM_PACKAGES) + "]"
_LINEITEM_VERSION = """concat(l_suppkey%12,'.',l_partkey%31,'.',cast(l_quantity as int),case when l_linenumber%5=0 then '-rc.1' else '' end)"""
_BUNDLED_SQL = ",".join(
    f"({_q(e)},{_q(n.lower())},{_q(f)},{'null' if i is None else _q(i)},{_q(c)})" for e, n, f, i, c, *_ in ADVISORIES
)


def _key_sql(v: str) -> str:
    return f"list_resize([cast(x as int) for x in string_split(string_split({v},'-')[1],'.')], 6, 0)"


_QUESTIONS_SQL = """q as (select p_partkey k, cast(floor(p_partkey/40) as bigint) batch_id, cast(p_partkey%40 as int) as position,
  (['npm','pypi'])[cast(p_partkey%2+1 as int)] eco, concat('Pkg',p_partkey) name from part)"""
_ANSWERS_SQL = f"""with {_QUESTIONS_SQL},
a as (select *, case when k%3=0 then [concat('A',k%600*2), concat('B',k%40*2+1)] else [] end ids
      from q where batch_id%7<>0)"""

def _excerpts_sql(most: int) -> str:
    return f"""with t as (select doc_id, string_split(text, chr(10)) ls from documents),
f as (select doc_id, ls, len(ls) n, unnest([doc_id % len(ls) + 1, doc_id*7 % len(ls) + 1]) line from t),
c as (select distinct doc_id, n, unnest(range(greatest(1, line-2), least(n, line+2)+1)) ln from f),
k as (select *, row_number() over (partition by doc_id order by ln) k, count(*) over (partition by doc_id) total from c),
g as (select *, ln - k as island from k where k <= {most}),
w as (select doc_id, island, min(ln) lo, max(ln) hi, max(total) total,
        string_agg(concat(lpad(cast(ln as varchar), 5, ' '), '  ', ls[ln]), chr(10) order by ln) body
      from g join t using (doc_id) group by doc_id, island),
x as (select doc_id, min(lo) lo, max(hi) hi, max(total) > {most} truncated,
        concat(string_agg(body, concat(chr(10), '    ...', chr(10)) order by lo),
               case when max(total) > {most} then concat(chr(10), '    ... (excerpt truncated)') else '' end) body from w group by 1)
select doc_id, sha256({_scrubbed_sql("body")}) digest,
        cast(lo as int) start_line, cast(hi as int) end_line, truncated from x"""


ORACLES = {
    "document_excerpts": _excerpts_sql(10),
    "document_excerpts_clipped": _excerpts_sql(8),
    "patch_lines": _PATCH_LINES_SQL,
    "patch_lines_in_row": _PATCH_LINES_SQL,
    "patch_facts": f"""{_PATCH_SQL} select id, concat(b+1,',',b+2,',',b+105) changed,
        concat(b,',',b+1,',',b+2,',',b+3,',',b+105,',',b+106) commentable, concat('old ',id,'|gone ',c) removed,
        sha256(concat(repeat(chr(10), cast(b-1 as int)),'keep ',id,chr(10),'new ',id,chr(10),'more',chr(10),'tail',
          repeat(chr(10), 102),'++x',chr(10))) rebuilt,
        concat('3/4/def f',id,'():;1/2/') hunks from o""",
    "review_inputs": f"""{_PATCH_SQL},
        s as (select *, {_pick_sql(("added", "modified", "removed", "renamed", "unchanged"), "id")} status from o)
        select concat('src/f',id,'.py') file_path, status,
          case when status<>'added' then concat(b+1,',',b+2,',',b+105) end changed,
          sha256(case when id%2=0 then concat('whole ',id) else
            concat(repeat(chr(10), cast(b-1 as int)),'keep ',id,chr(10),'new ',id,chr(10),'more',chr(10),'tail',
              repeat(chr(10), 102),'++x',chr(10)) end) as content
        from s where status not in ('removed','unchanged')""",
    "split_diffs": """select c_custkey, 'x y' as path, concat('@@ -1 +1 @@',chr(10),'-a',c_custkey,chr(10),'+b',c_custkey) as patch from customer
        union all select c_custkey, concat('dir/n',c_custkey), concat('@@ -2,2 +2,3 @@ t',chr(10),' k',chr(10),'+m',chr(10),
          '\\ No newline at end of file') from customer""".replace("\\\\", "\\"),
    "webhook_events": f"""with e as (select event_id d, {_pick_sql(_EVENTS, "user_id+event_id")} ev, {_pick_sql(_ACTIONS, "event_id")} act,
          user_id u, event_type, event_id%7=0 dr from events),
        r as (select *, case when ev='ping' then null when ev='push' then 'unhandled event type: push'
            when act not in ('opened','reopened','synchronize','ready_for_review') then concat('pull_request action not reviewable: ',act)
            when d%11=0 or coalesce(case when d%3=0 then d end, u)=0 then 'payload missing repository or pull request fields'
            when dr and act<>'ready_for_review' then 'pull request is a draft' end reason from e),
        k as (select *, case when ev='ping' then 'ping' when reason is not null then 'ignored' else 'pull_request' end kind from r)
        select d delivery, kind, reason, case when kind='pull_request' then concat('user',u) end as "owner",
          case when kind='pull_request' then event_type end repo,
          case when kind='pull_request' then coalesce(case when d%3=0 then d end, u) end pull_number,
          case when kind='pull_request' then act end as action, case when kind='pull_request' then concat('sha',d) end head_sha,
          case when kind='pull_request' then dr end draft from k""",
    "webhook_signatures": """select case event_id%4 when 1 then 'malformed-signature' when 2 then 'missing-signature'
        else 'mismatch' end state, count(*) n from events group by 1""",
    "verdict_answers": f"""with t as (select *, conv_id*100+turn k from conversations),
        v as (select conv_id, turn, k, concat('fp',k%50) fingerprint, {_pick_sql((*VERDICTS, "maybe"), "k")} verdict,
          case when k%13<>0 then regexp_replace(text, '^\\s+|\\s+$', '', 'g') else '' end reasoning, case when k%2=0 then 'patch it' end fix,
          {_pick_sql(SEVERITIES, "k")} wanted, {_pick_sql((*CONFIDENCES, "sure"), "k")} c0, {_pick_sql(SEVERITIES, "turn")} asked from t
          where conv_id%4<>1),
        w as (select *, case when c0='sure' then 'medium' else c0 end confidence,
          list_position(['critical','high','medium','low','info'], asked) f, list_position(['critical','high','medium','low','info'], wanted) g from v),
        x as (select *, case when confidence='high' then (['critical','high','medium','low','info'])[greatest(f-1,least(f+1,g))] else asked end severity from w)
        select conv_id, turn, fingerprint, verdict, reasoning, fix, severity, case when severity<>asked then asked end severity_changed_from,
          confidence, 'm1' model from x where verdict<>'maybe' and reasoning<>''""",
    "version_affected": f"""with b(eco, name, fixed, intro, cve) as (values {_BUNDLED_SQL}),
        d as (select {_pick_sql([a[0] for a in ADVISORIES], "l_partkey")} eco, lower({_pick_sql([a[1] for a in ADVISORIES], "l_partkey")}) name,
          {_LINEITEM_VERSION} v from lineitem),
        x as (select b.cve, v, {_key_sql("v")} a, {_key_sql("fixed")} f, case when intro is null then null else {_key_sql("coalesce(intro,'0')")} end i
          from d join b using (eco, name))
        select cve, count(*) declared,
          count(*) filter (where (i is null or a>i or (a=i and v not like '%-%')) and (a<f or (a=f and v like '%-%'))) affected,
          min(v) least_text from x group by 1""",
    "version_order": f"""with x as (select concat(l_suppkey%4,'.',l_partkey%3) l, concat(l_linenumber%4,'.',l_orderkey%3,
            case when l_orderkey%2=0 then '.0' else '-beta' end) r from lineitem),
        y as (select {_key_sql("l")} a, {_key_sql("r")} b, r like '%-%' pre from x)
        select cast(case when a<b then -1 when a>b then 1 when pre then 1 else 0 end as int) sign, count(*) n from y group by 1""",
    "typosquat": f"""with p as (select p_partkey k, {_pick_sql(POPULAR_NPM_PACKAGES, "p_partkey")} b, cast(p_partkey%4+1 as int) at_ from part),
        n as (select k part, case k%5 when 0 then b when 1 then concat(b[1:at_],'q',b[at_+1:]) when 2 then concat(b[1:at_-1],b[at_+1:])
            when 3 then concat(b,'xy') else concat('z',b[2:]) end name from p),
        m as (select part, name, {_POPULAR_SQL} ps from n),
        c as (select part, name, ps, list_filter(range(1,{len(POPULAR_NPM_PACKAGES) + 1}), lambda i: levenshtein(name, ps[i])=1)[1] hit,
            list_position(ps, name) self from m)
        select part, name, ps[hit] near from c where hit is not null and (coalesce(self,0)=0 or hit<self)""",
    "advisory_cache": f"""with {_QUESTIONS_SQL} select name, case when k%6=0 then 'cached' else 'pending' end state from q""",
    "advisory_positions": f"{_ANSWERS_SQL} select batch_id, position, name, array_to_string(ids,',') ids from a",
    "advisory_ids": f"""{_ANSWERS_SQL}, u as (select batch_id, position, unnest(ids) id, generate_subscripts(ids,1) i from a),
        select distinct id from u""",
    "advisory_details": f"""{_ANSWERS_SQL},
        s as (select s_suppkey s, concat((['A','B'])[cast(s_suppkey%2+1 as int)], s_suppkey) id from supplier),
        d as (select id, case when s%2=0 then concat('CVE-2024-',s) when s%5<>0 then id else 'unknown' end cve, s,
          case when s%4=0 then (case floor(s/4)%2 when 0 then 'high' else 'medium' end)
               else (['critical','medium','medium'])[cast(s%3+1 as int)] end severity,
          case when s%3<>0 then concat('First ',s) else 'No summary published.' end summary from s),
        u as (select k, unnest(ids) id from a)
        select cve, severity, case when k=floor(s/2) then concat('1.2.',s) else 'a later version' end fixed_in, summary, count(*) n
        from u join d using (id) group by 1,2,3,4""",
}
