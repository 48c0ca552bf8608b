"""Unified diffs as rows.

A patch is split inside its own row. Running counters are sums over the lines
before, so a line's numbers follow from its hunk's start and the kinds above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values import patterns as P
from ..functions.dialect import bind, capture, matches
from ..functions.text import strip

LINE = "struct<hunk:int,kind:string,content:string,new_line:int,old_line:int,position:int>"


def _numbered(body: Column, hunk: Column, place: Column, new: Column, old: Column) -> Column:
    """Lines of one hunk with their numbers; `place` is the header's position.

    The n-th line that is not removed has the n-th new number, the n-th that is
    not added the n-th old one. The two numberings are laid side by side by one
    sort, where an unchanged line stands twice in a row; nothing grows by copies.
    """
    signed = F.transform(body, lambda raw, i: F.struct(i.alias("i"), F.substring(raw, 1, 1).alias("sign"), raw.alias("raw")))

    def counted(removed: str, side: int, first: Column) -> Column:
        return F.transform(
            F.filter(signed, lambda l: l["sign"] != removed),
            lambda l, n: F.struct(l["i"].alias("i"), F.lit(side).alias("side"), (first + n).alias("n"), l["sign"].alias("sign"), l["raw"].alias("raw")),
        )

    def lines(rows: Column) -> Column:
        both = F.transform(rows, lambda l, at: F.struct(l.alias("l"), F.get(rows, at + 1)["n"].alias("next")))
        once = F.filter(both, lambda x: (x["l"]["side"] == 0) | (x["l"]["sign"] == "-"))

        def line(x: Column) -> Column:
            l = x["l"]
            adds, drops = l["sign"] == "+", l["sign"] == "-"
            return F.struct(
                hunk.alias("hunk"),
                F.when(adds, "add").when(drops, "del").otherwise("context").alias("kind"),
                l["raw"].substr(F.lit(2), F.length(l["raw"])).alias("content"),
                F.when(~drops, l["n"]).alias("new_line"),
                F.when(drops, l["n"]).when(~adds, x["next"]).alias("old_line"),
                (place + l["i"] + 1).alias("position"),
            ).cast(LINE)

        return F.transform(once, line)

    return bind(F.sort_array(F.concat(counted("-", 0, new), counted("+", 1, old))), lines)


def parsed_lines(patch: Column) -> Column:
    """Array of patch lines with their numbers; headers are not lines.

    Text before the first header is ignored, a header takes a position, and
    the "no newline" note takes neither line nor position.
    """
    rows = F.filter(F.split(patch, "\n"), lambda r: matches(r, P.HUNK_HEADER) | ~r.startswith("\\"))

    def cut(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: matches(F.get(lines, i), P.HUNK_HEADER))

        def hunk(starts: Column, at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(lines))
            head = F.get(lines, at)
            return bind(
                F.slice(lines, at + 2, end - at - 1),
                lambda body: _numbered(
                    body, k + 1, at - F.get(starts, F.lit(0)) + 1,
                    capture(head, P.HUNK_HEADER, 3).try_cast("int"), capture(head, P.HUNK_HEADER, 1).try_cast("int"),
                ),
            )

        return bind(heads, lambda starts: F.flatten(F.transform(starts, lambda at, k: hunk(starts, at, k))))

    return F.when(patch.isNotNull(), bind(rows, lambda lines: F.when(F.size(lines) > 0, cut(lines)).otherwise(F.array().cast(f"array<{LINE}>"))))


def numbered_lines(patches: DataFrame, keys: list[str]) -> DataFrame:
    """The same numbering as rows: one window per patch, no growing arrays.

    Suited to large patches; `parsed_lines` suits many small ones.
    """
    rows = patches.select(*keys, F.posexplode(F.split("patch", "\n")).alias("i", "raw"))
    header = F.col("raw").startswith("@@") & matches(F.col("raw"), P.HUNK_HEADER)
    sign = F.substring("raw", 1, 1)
    kind = F.when(F.col("header"), "header").when(sign == "+", "add").when(sign == "-", "del").otherwise("context")
    in_order = Window.partitionBy(*keys).orderBy("i")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        rows.withColumn("header", header)
        .where(F.col("header") | ~F.col("raw").startswith("\\"))
        .withColumn("kind", kind)
    )
    counted = (
        marked.withColumn("hunk", F.sum(F.col("header").cast("int")).over(upto))
        .withColumn("row", F.row_number().over(in_order))
        .withColumn("seen_new", F.sum(F.col("kind").isin("add", "context").cast("int")).over(upto))
        .withColumn("seen_old", F.sum(F.col("kind").isin("del", "context").cast("int")).over(upto))
    )
    # What stood at the last header, and the row of the first: all windows share one order, so rows are sorted once.
    start = F.struct(
        (capture(F.col("raw"), P.HUNK_HEADER, 3).try_cast("int") - F.col("seen_new") - 1).alias("new"),
        (capture(F.col("raw"), P.HUNK_HEADER, 1).try_cast("int") - F.col("seen_old") - 1).alias("old"),
    )
    placed = (
        counted.withColumn("start", F.last(F.when(F.col("header"), start), ignorenulls=True).over(upto))
        .withColumn("first_row", F.min(F.when(F.col("header"), F.col("row"))).over(upto))
    )
    return placed.where((F.col("hunk") > 0) & (F.col("kind") != "header")).select(
        *keys,
        F.col("hunk").cast("int").alias("hunk"),
        "kind",
        F.expr("substr(raw, 2)").alias("content"),
        F.when(F.col("kind") != "del", F.col("start.new") + F.col("seen_new")).cast("int").alias("new_line"),
        F.when(F.col("kind") != "add", F.col("start.old") + F.col("seen_old")).cast("int").alias("old_line"),
        (F.col("row") - F.col("first_row") + 1).cast("int").alias("position"),
    )


def changed_lines(parsed: Column) -> Column:
    return F.transform(F.filter(parsed, lambda l: l["kind"] == "add"), lambda l: l["new_line"])


def commentable_lines(parsed: Column) -> Column:
    return F.transform(F.filter(parsed, lambda l: l["new_line"].isNotNull()), lambda l: l["new_line"])


def removed_lines(parsed: Column) -> Column:
    """Removed text by its line number before the change."""
    gone = F.filter(parsed, lambda l: l["kind"] == "del")
    return F.map_from_arrays(F.transform(gone, lambda l: l["old_line"]), F.transform(gone, lambda l: l["content"]))


def reconstructed(parsed: Column) -> Column:
    """As much of the new file as the patch shows; gaps become empty lines.

    Shown lines are put in order (the later one wins where a number repeats)
    and each brings the line breaks that separate it from the one before.
    """
    shown = F.filter(
        F.transform(
            parsed,
            lambda l, i: F.struct(l["new_line"].alias("n"), i.alias("i"), l["content"].alias("text")),
        ),
        lambda x: x["n"] >= 1,
    )

    def last_of_each(rows: Column) -> Column:
        return F.filter(rows, lambda x, i: F.coalesce(F.get(rows, i + 1)["n"] != x["n"], F.lit(True)))

    def joined(rows: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(1)).otherwise(F.get(rows, i - 1)["n"])
            return F.concat(F.repeat(F.lit("\n"), x["n"] - before), x["text"])

        return F.array_join(F.transform(rows, piece), "")

    return bind(F.sort_array(shown), lambda rows: bind(last_of_each(rows), joined))


def hunks(patch: Column) -> Column:
    """Hunk headers: starts, counts (1 when left out) and the trailing text."""
    rows = F.filter(F.split(patch, "\n"), lambda r: matches(r, P.HUNK_HEADER))

    def number(r: Column, group: int, default: int | None = None) -> Column:
        found = capture(r, P.HUNK_HEADER, group).try_cast("int")
        return found if default is None else F.coalesce(found, F.lit(default))

    return F.transform(
        rows,
        lambda r: F.struct(
            number(r, 1).alias("old_start"), number(r, 2, 1).alias("old_count"),
            number(r, 3).alias("new_start"), number(r, 4, 1).alias("new_count"),
            F.trim(capture(r, P.HUNK_HEADER, 5)).alias("header"),
        ),
    )


# Line starts of a multi-file diff that are neither path nor patch text.
_META = (
    "--- ", "index ", "old mode ", "new mode ", "similarity index ", "rename ", "new file mode ",
    "deleted file mode ", "Binary files ",
)


def split_multi_file_diff(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """One row per file of a `git diff`: keys, path, patch.

    The `+++` line names the path; it is carried forward over the lines below
    it. Sections are cut out inside the row of the diff, so files of one diff
    spread over tasks once they are rows. A path named twice keeps its last
    patch.
    """
    sections = F.split(F.concat(F.lit("\n"), F.col(diff)), "\ndiff --git ")
    one = diffs.select(*keys, F.posexplode(sections).alias("section", "text"))
    lines = F.slice(F.split("text", "\n"), 2, 2**31 - 2)
    shaped = one.select(*keys, "section", F.when(F.col("section") == 0, F.split("text", "\n")).otherwise(lines).alias("lines"))
    return _section_patches(shaped, keys)


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """`split_multi_file_diff` of a diff in a file of any size: path, patch.

    A file header is the separator of records, so Spark reads the diff in byte ranges, each from the first header in it
    to the end of the section that its end cuts, and no text passes the driver.
    """
    rows = spark.read.option("lineSep", "\ndiff --git ").text(path).select(
        F.col("value").alias("text"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("section")
    )
    lines = F.split("text", "\n")
    # The first line is what is left of a header, unless the diff begins without one.
    bare = F.col("text").startswith("--- ")
    shaped = rows.select("section", F.when(bare, lines).otherwise(F.slice(lines, 2, 2**31 - 2)).alias("lines"))
    return _section_patches(shaped, [])


def _section_patches(shaped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, patch of sections given as keys, section (their order) and lines."""
    at_path = F.transform(
        F.filter(F.transform("lines", lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: x["l"].startswith("+++ ")),
        lambda x: x,
    )
    named = shaped.withColumn("named", at_path).where(F.size("named") > 0)
    target = strip(F.expr("substr(try_element_at(named, -1).l, 5)"))
    first_at = F.get(F.col("named"), 0)["i"]
    body = F.filter(
        F.transform("lines", lambda l, i: F.when(i > first_at, l)),
        lambda l: l.isNotNull()
        & ~l.startswith("+++ ")
        & ~F.array_contains(F.transform(F.array(*[F.lit(m) for m in _META]), lambda m: l.startswith(m)), True)
        & (l.startswith("@@") | F.substring(l, 1, 1).isin("+", "-", " ", "\\")),
    )
    patches = named.select(
        *keys, "section", F.regexp_replace(target, "^b/", "").alias("path"), (target == "/dev/null").alias("gone"),
        F.array_join(body, "\n").alias("patch"), F.size(body).alias("n"),
    ).where(~F.col("gone") & (F.col("n") > 0))
    return patches.groupBy(*keys, "path").agg(F.max_by("patch", "section").alias("patch"))


def review_inputs(files: DataFrame) -> DataFrame:
    """Scan inputs of a change: file_idx, file_path, status, additions, patch, content.

    An added file is scanned whole; otherwise only added lines count. Without
    the new content, what the patch shows is scanned instead.
    """
    facts = bind(
        parsed_lines(F.col("patch")),
        lambda p: F.struct(
            F.coalesce(changed_lines(p), F.array().cast("array<int>")).alias("changed"),
            F.coalesce(F.col("content"), F.when(p.isNotNull(), reconstructed(p)), F.lit("")).alias("content"),
        ),
    )
    live = files.where(~F.col("status").isin("removed", "unchanged"))
    # Generated, so that the parsed patch is worked out once per file.
    parsed = live.select(
        "file_idx", "file_path", "status", "additions", F.col("content").isNotNull().alias("whole"),
        F.explode(F.array(facts)).alias("facts"),
    )
    status = F.when(F.col("status").isin("added", "renamed", "removed"), F.col("status")).otherwise("modified")
    out = parsed.where((F.size("facts.changed") > 0) | (F.col("additions") > 0)).select(
        "file_idx", "file_path", F.col("facts.content").alias("content"), status.alias("status"),
        F.when(F.col("status") != "added", F.col("facts.changed")).alias("changed_lines"), "whole",
    )
    return out.where(F.col("whole") | matches(F.col("content"), r"\S")).drop("whole")
