"""Registered text queries over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import credentials as C
from ..functions import globs, scrub
from ..functions import text as tx
from ..operators.lines import block
from ..sources.tables import read, spread


def _digest(value):
    return F.sha2(value, 256)


def _planted(doc_id):
    """Credentials made from a document's own id, in every known shape."""
    hexed = F.sha2(doc_id.cast("string"), 256)
    return F.concat(
        F.lit("\nkey AKIA"), F.upper(F.substring(hexed, 1, 16)),
        F.lit(" and ghp_"), F.substring(hexed, 1, 30),
        F.lit(" github_pat_"), F.substring(hexed, 5, 24),
        F.lit(" xoxb-"), F.substring(hexed, 2, 14),
        F.lit(" sk_live_"), F.substring(hexed, 3, 20),
        F.lit(" sk-proj-"), F.substring(hexed, 4, 24),
        F.lit(" AIza"), F.substring(hexed, 1, 35),
        F.lit(" SG."), F.substring(hexed, 1, 18), F.lit("."), F.substring(hexed, 20, 18),
        F.lit(" npm_"), F.substring(hexed, 1, 36),
        F.lit("\nclient_secret: '"), F.substring(hexed, 1, 12), F.lit("' password=\""), F.substring(hexed, 1, 5),
        F.lit("\" https://svc:"), F.substring(hexed, 7, 9), F.lit("@db.example.com/x\n-----BEGIN RSA PRIVATE KEY-----\n"),
        hexed, F.when(doc_id % 2 == 0, F.lit("\n-----END RSA PRIVATE KEY-----\n")).otherwise(F.lit("\n")),
    )


_PLANTED_SQL = """concat(chr(10), 'key AKIA', upper(substr(h,1,16)), ' and ghp_', substr(h,1,30), ' github_pat_', substr(h,5,24),
  ' xoxb-', substr(h,2,14), ' sk_live_', substr(h,3,20), ' sk-proj-', substr(h,4,24), ' AIza', substr(h,1,35),
  ' SG.', substr(h,1,18), '.', substr(h,20,18), ' npm_', substr(h,1,36), chr(10), 'client_secret: ''', substr(h,1,12),
  ''' password="', substr(h,1,5), '" https://svc:', substr(h,7,9), '@db.example.com/x', chr(10),
  '-----BEGIN RSA PRIVATE KEY-----', chr(10), h,
  case when id%2=0 then concat(chr(10), '-----END RSA PRIVATE KEY-----', chr(10)) else chr(10) end)"""


def scrub_documents(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = scrub.scrub_credentials(F.concat("text", _planted(F.col("doc_id"))))
    masks = (F.length("c") - F.length(F.replace("c", F.lit(C.MASK), F.lit("")))) / len(C.MASK)
    return docs.select("doc_id", F.explode(F.array(clean)).alias("c")).select(
        "doc_id", _digest("c").alias("digest"), masks.cast("long").alias("masks")
    )


def redact_conversations(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    id_ = F.col("conv_id") * 100 + F.col("turn")
    record = F.struct(
        F.create_map(
            F.lit("Auth-Token"), F.col("role"), F.lit("note"), F.concat("text", _planted(id_))
        ).alias("context"),
        F.col("role").alias("user_password"),
        F.array(F.col("text")).alias("parts"),
    )
    kind = T.StructType([
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("user_password", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
    ])
    masked = turns.select("conv_id", "turn", scrub.redact(record, kind).alias("r"))
    return masked.select(
        "conv_id", "turn",
        F.col("r.context")["Auth-Token"].alias("by_key"),
        _digest(F.col("r.context")["note"]).alias("note"),
        F.col("r.user_password").alias("by_field"),
        _digest(F.array_join("r.parts", "|")).alias("parts"),
    )


def entropy(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.round(tx.shannon_entropy(F.col("text")), 6).alias("bits"))


def line_fingerprints(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    snippet = tx.truncate(F.col("raw"))
    return docs.select(
        "doc_id", F.col("at").alias("line"), F.length(snippet).alias("shown"),
        tx.fingerprint(F.lit("text/line"), path, snippet).alias("fingerprint"),
    )


def identifiers(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", _digest(tx.split_identifiers(F.col("html"))).alias("digest"))


def literals(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    found = tx.string_literals(F.col("html"))
    return pages.select(
        "page_id",
        F.size(found).alias("literals"),
        _digest(F.array_join(found, "|")).alias("bodies"),
        _digest(tx.blank_string_literals(F.col("html"))).alias("blanked"),
    )


def escaped_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "html", "url")
    return pages.select(
        "page_id", _digest(tx.escape_html(F.col("html"))).alias("html"),
        _digest(tx.escape_cell(F.concat("url", F.lit("|\r\n"), "html"))).alias("cell"),
    )


def comment_lines(spark, sf_dir):
    """Documents read as code: every third line turned into a comment form."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    sign = F.element_at(F.array(*[F.lit(s) for s in ("  // ", "#", " -- ", "/* ", "* ", "")]), (F.col("at") % 6 + 1).cast("int"))
    line = F.concat(sign, "raw")
    return docs.groupBy("doc_id").agg(
        F.count_if(tx.is_comment_line(line)).alias("comments"), F.count_if(tx.is_blank(F.col("raw"))).alias("blanks")
    )


def line_context(spark, sf_dir):
    """Every line with the two lines on either side, cut from its own document."""
    lines = F.split("text", "\n")
    docs = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    each = docs.select("doc_id", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("line"))
    return each.select("doc_id", "line", _digest(block(F.col("lines"), F.col("line"), 2)).alias("block"))


_FOLDERS = ("src", "src/gen", "tests", "node_modules/pkg", "lib/a", "lib/c", "app/__mocks__", "docs", "dist", "web/.next", ".env.d", "a/b")
_NAMES = (
    "index.js", "app.min.js", "view.test.ts", "main.py", "Dockerfile", "go.sum", "package-lock.json", "README.md",
    "requirements-dev.txt", "photo.png", "spec.rb", "x_mock.go", "Main.java", "infra.tf", "run.sh", ".env.local", "logo.svg",
)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(values, key):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    word = F.regexp_extract("url", r"//([a-z]+)", 1)
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.concat_ws("/", pick(_FOLDERS, F.col("page_id")), word, pick(_NAMES, F.col("page_id"))).alias("path"),
    )


def path_kinds(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select(
        "page_id", "path", tx.detect_language(path).alias("language"), tx.is_generated_path(path).alias("generated"),
        tx.is_lockfile(path).alias("lockfile"), tx.is_test_path(path).alias("test"),
        tx.is_scannable(path).alias("scannable"), tx.in_skipped_directory(path).alias("skipped"),
    )


_INCLUDE = ("src/**", "**/*.py", "lib/{a,b}/*/*.js", "?/b/**", "*.md")
_EXCLUDE = ("*.min.js", "./src/gen/**/*.ts", "**/photo.png")


def glob_scope(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select(
        "page_id", globs.path_in_scope(path, _INCLUDE, _EXCLUDE).alias("in_scope"),
        globs.path_in_scope(path, (), _EXCLUDE).alias("kept"),
    )


def event_values(spark, sf_dir):
    """Numbers out of the JSON column, by day and type."""
    rows = read(spark, sf_dir, "events").select("ts", "event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count("*").alias("events"), F.sum("p.k").alias("total"), F.max("p.k").alias("top")
    )


QUERIES = {
    "scrub_documents": scrub_documents,
    "redact_conversations": redact_conversations,
    "entropy": entropy,
    "line_fingerprints": line_fingerprints,
    "identifiers": identifiers,
    "literals": literals,
    "escaped_pages": escaped_pages,
    "comment_lines": comment_lines,
    "line_context": line_context,
    "path_kinds": path_kinds,
    "glob_scope": glob_scope,
    "events_json": event_values,
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replace_all(expr: str, patterns, flags: str = "g", to: str = "[redacted]") -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, {_quote(p)}, {_quote(to)}, {_quote(flags)})"
    return expr


# RE2 has no back-reference: one pattern per quote sign says the same.
_ASSIGNED = [
    C.ASSIGNED_SECRET.replace("([\"'`])", f"({q})").replace(r"\2", q) for q in ('"', "'", "`")
]


def _scrubbed_sql(expr: str) -> str:
    expr = _replace_all(expr, [p.replace("|$)", r"|\z)") for p in C.PROVIDER_TOKENS])
    for p, q in zip(_ASSIGNED, ('"', "'", "`")):
        expr = f"regexp_replace({expr}, {_quote(p)}, {_quote(chr(92) + '1' + q + '[redacted]' + q)}, 'gi')"
    return f"regexp_replace({expr}, {_quote(C.URL_PASSWORD)}, '\\1[redacted]\\3', 'gi')"


def _flat(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def _pick(values, key: str) -> str:
    return "([" + ",".join(_quote(v) for v in values) + f"])[cast({key} % {len(values)} + 1 as int)]"


_PATHS_SQL = (
    f"select page_id, concat_ws('/', {_pick(_FOLDERS, 'page_id')}, regexp_extract(url, '//([a-z]+)', 1), "
    f"{_pick(_NAMES, 'page_id')}) path from pages"
)
_LANGS = {
    "index.js": "javascript", "app.min.js": "javascript", "view.test.ts": "typescript", "main.py": "python",
    "README.md": "documentation", "spec.rb": "ruby", "x_mock.go": "go", "Main.java": "java", "infra.tf": "terraform",
    "run.sh": "shell", "logo.svg": "documentation", "package-lock.json": "json",
}
_LANG_SQL = "case " + " ".join(f"when path like '%/{n}' then '{l}'" for n, l in _LANGS.items()) + " else 'other' end"
_SEG = "\"[^\"\\\\]*(?:\\\\[\\s\\S][^\"\\\\]*)*(?:\"|\\\\?\\z)"
_SEGMENTS = "|".join([_SEG, _SEG.replace('"', "'"), _SEG.replace('"', "`"), "[^\"'`]+"])
_LIT = "\"[^\"\\\\]*(?:\\\\[^\\n\\r\\x{2028}\\x{2029}][^\"\\\\]*)*\""
_LITS = "|".join([_LIT, _LIT.replace('"', "'"), _LIT.replace('"', "`")])

ORACLES = {
    "scrub_documents": f"""with d as (select doc_id, doc_id id, sha256(cast(doc_id as varchar)) h, text from documents),
        c as (select doc_id, {_scrubbed_sql(f"concat(text, {_PLANTED_SQL})")} c from d)
        select doc_id, sha256(c) digest, cast((length(c)-length(replace(c,'[redacted]','')))/10 as bigint) masks from c""",
    "redact_conversations": f"""with d as (select *, conv_id*100+turn id, sha256(cast(conv_id*100+turn as varchar)) h
          from conversations)
        select conv_id, turn, '[redacted]' by_key,
          sha256({_replace_all(f"concat(text, {_PLANTED_SQL})", C.LOG_VALUES)}) note, '[redacted]' by_field,
          sha256({_replace_all("text", C.LOG_VALUES)}) parts from d""",
    "entropy": """select doc_id, round(list_entropy(string_split(text,'')),6) bits from documents""",
    "line_fingerprints": f"""with l as (select doc_id, unnest(string_split(text,chr(10))) raw,
            generate_subscripts(string_split(text,chr(10)),1)-1 line from documents),
        f as (select doc_id, line, {_flat("raw")} flat from l),
        s as (select doc_id, line, case when length(flat)>200 then concat(flat[1:197],'...') else flat end s from f)
        select doc_id, cast(line as int) line, cast(length(s) as int) shown,
          substr(sha256(concat('text/line docs/',doc_id,'.txt ',{_flat("s")})),1,20) fingerprint from s""",
    "identifiers": r"""select page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html,
          '([a-z0-9])([A-Z])','\1 \2','g'),'([A-Z]+)([A-Z][a-z])','\1 \2','g'),'[_\-]+',' ','g')) digest from pages""",
    "literals": f"""with p as (select page_id,
            [x[2:-2] for x in regexp_extract_all(html, {_quote(_LITS)}) if length(x)>2] lits,
            regexp_extract_all(html, {_quote(_SEGMENTS)}) segs from pages)
        select page_id, cast(len(lits) as int) literals, sha256(array_to_string(lits,'|')) bodies,
          sha256(array_to_string([case when x[1] in ('"','''','`') then
             case when length(x)>1 and x[-1]=x[1] and not regexp_matches(x[2:-2], '(^|[^\\\\])(\\\\\\\\)*\\\\$')
                  then concat(x[1], repeat(' ', length(x)-2), x[1])
                  else concat(x[1], repeat(' ', length(x)-1 + case when regexp_matches(x, '(^|[^\\\\])(\\\\\\\\)*\\\\$') then 1 else 0 end)) end
             else x end for x in segs],'')) blanked from p""",
    "escaped_pages": """select page_id, sha256(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),
          '>','&gt;'),'"','&quot;'),'''','&#39;')) html,
          sha256(regexp_replace(replace(concat(url,'|',chr(13),chr(10),html),'|','\\|'),'\\r?\\n',' ','g')) cell
        from pages""".replace("\\\\", "\\"),
    "comment_lines": """with l as (select doc_id, unnest(string_split(text,chr(10))) raw,
            generate_subscripts(string_split(text,chr(10)),1)-1 line from documents)
        select doc_id, count(*) filter (where line%6<5 or regexp_matches(raw,'^\\s*(//|#|--|\\*|/\\*)')) comments,
          count(*) filter (where not regexp_matches(raw,'\\S')) blanks from l group by 1""".replace("\\\\", "\\"),
    "line_context": """with l as (select doc_id, unnest(string_split(text,chr(10))) raw,
            cast(generate_subscripts(string_split(text,chr(10)),1) as int) line from documents)
        select doc_id, line, sha256(array_to_string(list(raw) over (partition by doc_id order by line
            rows between 2 preceding and 2 following), chr(10))) block from l""",
    "path_kinds": f"""with p as ({_PATHS_SQL})
        select page_id, path, {_LANG_SQL} as language,
          regexp_matches(path,'(^|/)(node_modules|vendor|dist|build|out|coverage|\\.next|__snapshots__)/') or path like '%.min.js' generated,
          path like '%/go.sum' or path like '%/package-lock.json' lockfile,
          path like 'tests/%' or path like '%/\\_\\_mocks\\_\\_/%' escape '\\' or path like '%.test.ts' or path like '%\\_mock.go' escape '\\' test,
          path not like '%/go.sum' and path not like '%/README.md' and path not like '%/photo.png' and path not like '%/logo.svg' scannable,
          path like 'node_modules/%' or path like 'dist/%' or path like 'web/.next/%' skipped from p""".replace("\\\\", "\\"),
    "glob_scope": f"""with p as ({_PATHS_SQL}),
        x as (select *, path like '%.min.js' or (path like 'src/gen/%' and path like '%.ts') or path like '%/photo.png' excluded from p)
        select page_id, not excluded and (path like 'src/%' or path like '%.py'
            or regexp_matches(path,'^lib/[ab]/[^/]*/[^/]*\\.js$') or regexp_matches(path,'^[^/]/b/') or path like '%.md') in_scope,
          not excluded kept from x""".replace("\\\\", "\\"),
    "events_json": """select cast(ts as date) as day, event_type, count(*) events,
          cast(sum(cast(json_extract(props,'$.k') as int)) as bigint) total,
          max(cast(json_extract(props,'$.k') as int)) top from events group by 1,2""",
}
