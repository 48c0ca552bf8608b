"""Conversation structure repair: the cheapest edits as one shortest path of whole numbers.

A conversation's rows are edited from first to last so that the roles' initials
give `(s?(ua)+)?`. Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert
of an empty user or assistant row 5; blank and duplicate rows must go; a
truncated row that stays costs 5 more. Nodes are (rows read, rows inserted, last
initial written). An edge's weight is one number: its cost in the high digits,
and its letter in the low digit at the letter's place, which the node tells. So
a plain minimum over sums finds the cheapest edits and, among these, the least
list of letters: a list that ends is followed by zeros, under every letter. All
roles follow from the letters, since every written row but a leading `s` has
only one place-bound initial.

A long conversation is first cut where all cheapest paths pass through one node
(plain costs from both ends tell where). Each part then has numbers of its own
width, and equal parts are worked out once. Where nothing can be cut the
numbers have three bits for each row: time grows with the square of the longest
stretch of equally cheap choices, not with the conversation.

Faults are worked out by Spark before anything is ordered. Equal rows of a
conversation become one row with a count, and a row is a duplicate unless it has
the first turn of its role and text, found by grouping and joined back on the
whole row, so no key is hot. Then the narrow rows of a conversation pass one
task in order, as a stream: the letters, which are one value, and the digest are
made by the order, and no part of them without the rest. It holds about 80 bytes
for each row of the conversation it is at. A second stream of the texts that may stay, behind their letters,
gives the digest; it holds one batch of texts.

Cases: nulls of role and text are one space, which is also what a null id or
turn is written as; rows without turn come first; rows of one turn are ordered by role, then
by the SHA-256 of the text; null ids are one conversation; a conversation with
no row left has zeros, an empty list and the digest of nothing; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The letters in their order, from one; three bits hold a digit.
LETTERS, _BITS = "DIKR", 3
_D, _I, _K, _R = range(1, 5)
#: A state is the last initial written, 0 before the first. What may follow it, and the states a conversation may end in.
_STATES, _ENDS = "0sua", "0a"
_FOLLOW = {"0": "su", "s": "u", "u": "a", "a": "u"}
#: Marks of a row: it must go, it was cut off, or neither.
GOES, CUT, SOUND = "g", "t", "."
_FAR = 1 << 62


def _steps(state: str, initial: str, mark: str) -> Iterator[tuple[int, int, int]]:
    """(cost, letter, next state's place) of what may be done with a row."""
    yield DELETE, _D, _STATES.index(state)
    if mark != GOES:
        more = TRUNCATED if mark == CUT else 0
        for role in _FOLLOW[state]:
            if role == initial:
                yield KEEP + more, _K, _STATES.index(role)
            elif role != "s":
                yield REROLE + more, _R, _STATES.index(role)


_STEPS = {i + m: [list(_steps(s, i, m)) for s in _STATES] for i in "sua-" for m in (GOES, CUT, SOUND)}
#: (from, to) of an insert, which may write user or assistant.
_INSERTS = [(_STATES.index(s), _STATES.index(r)) for s in _STATES for r in _FOLLOW[s] if r != "s"]


def _settle(costs: list[int], backward: bool = False) -> list[int]:
    """Costs at one place once rows may be inserted there; two inserts reach every state there is."""
    for _ in range(2):
        for source, target in _INSERTS:
            if backward:
                source, target = target, source
            if costs[source] + INSERT < costs[target]:
                costs[target] = costs[source] + INSERT
    return costs


def _forward(rows: str) -> array:
    """At 4 * place + state the least cost from the start; `rows` has an initial and a mark for each row."""
    costs = _settle([0, _FAR, _FAR, _FAR])
    found = array("q", costs)
    for at in range(0, len(rows), 2):
        new = [_FAR] * 4
        for cost, steps in zip(costs, _STEPS[rows[at : at + 2]]):
            if cost < _FAR:
                for more, _, state in steps:
                    if cost + more < new[state]:
                        new[state] = cost + more
        costs = _settle(new)
        found.extend(costs)
    return found


def _backward(rows: str, ends: str) -> array:
    """At 4 * place + state the least cost to the end."""
    n = len(rows) // 2
    costs = _settle([0 if state in ends else _FAR for state in _STATES], backward=True)
    found = array("q", bytes(32 * (n + 1)))
    found[4 * n :] = array("q", costs)
    for at in range(n - 1, -1, -1):
        costs = _settle(
            [min(costs[state] + more for more, _, state in steps) for steps in _STEPS[rows[2 * at : 2 * at + 2]]], backward=True
        )
        costs = [min(c, _FAR) for c in costs]
        found[4 * at : 4 * at + 4] = array("q", costs)
    return found


def _path(rows: str, start: str, ends: str) -> tuple[int, str]:
    """(cost, letters) of the least path, decided by whole numbers alone; `after` only leaves out nodes that no cheapest
    path meets."""
    n = len(rows) // 2
    after = _backward(rows, ends)
    total = after[_STATES.index(start)]
    width = n + total // INSERT
    unit = _BITS * width

    def weight(cost: int, letter: int, place: int) -> int:
        return (cost << unit) + (letter << _BITS * (width - 1 - place))

    def reached(nodes: dict, node: tuple[int, int], at: int, value: int) -> bool:
        """Note a node's value if it is the least so far; true if the node is new."""
        if (value >> unit) + after[4 * at + node[1]] > total:
            return False
        old = nodes.get(node)
        if old is None or value < old:
            nodes[node] = value
        return old is None

    nodes = {(0, _STATES.index(start)): 0}
    for at in range(n + 1):
        waiting = sorted(nodes)
        while waiting:  # inserts before row `at`, fewest first, so that a node's value is final when it is taken
            inserted, state = waiting.pop(0)
            if at + inserted < width:
                for source, target in _INSERTS:
                    node = inserted + 1, target
                    if source == state and reached(nodes, node, at, nodes[inserted, state] + weight(INSERT, _I, at + inserted)):
                        insort(waiting, node)
        if at < n:
            steps, following = _STEPS[rows[2 * at : 2 * at + 2]], {}
            for (inserted, state), value in nodes.items():
                if at + inserted < width:
                    for cost, letter, target in steps[state]:
                        reached(following, (inserted, target), at + 1, value + weight(cost, letter, at + inserted))
            nodes = following
    best = min(value for (_, state), value in nodes.items() if _STATES[state] in ends)
    digits = (best >> _BITS * place & 7 for place in range(width - 1, -1, -1))
    return best >> unit, "".join(LETTERS[d - 1] for d in digits if d)


@lru_cache(maxsize=50_000)
def _short_path(rows: str, start: str, ends: str) -> tuple[int, str]:
    return _path(rows, start, ends)


def _cuts(rows: str) -> Iterator[tuple[int, str]]:
    """(row, state) through which every cheapest path goes, with one number of inserts before it.

    Letters before it then have one length, so what comes before and after is decided apart.
    """
    before, after = _forward(rows), _backward(rows, _ENDS)
    total = after[0]

    def cheapest(at: int, state: int) -> bool:
        return before[4 * at + state] + after[4 * at + state] == total

    def reached(nodes: dict, state: int, least: int, most: int) -> None:
        old = nodes.get(state, (least, most))
        nodes[state] = min(old[0], least), max(old[1], most)

    inserts = {0: (0, 0)}  # by state, the least and most inserts on cheapest paths that come there
    for at in range(len(rows) // 2):
        for _ in range(2):
            for source, target in _INSERTS:
                if source in inserts and cheapest(at, target) and before[4 * at + source] + INSERT == before[4 * at + target]:
                    reached(inserts, target, inserts[source][0] + 1, inserts[source][1] + 1)
        if at and len(inserts) == 1:
            ((state, (least, most)),) = inserts.items()
            if least == most:
                yield at, _STATES[state]
        following: dict[int, tuple[int, int]] = {}
        for state, (least, most) in inserts.items():
            for cost, _, target in _STEPS[rows[2 * at : 2 * at + 2]][state]:
                if cheapest(at + 1, target) and before[4 * at + state] + cost == before[4 * (at + 1) + target]:
                    reached(following, target, least, most)
        inserts = following


#: Conversations of more rows are cut into parts, and parts of more rows are not remembered.
_WHOLE, _REMEMBERED = 12, 64


def repair(rows: str) -> tuple[int, str]:
    """(cost, letters) for the rows of a conversation, each an initial (s, u, a or - for any other) and a mark."""
    n = len(rows) // 2
    if n <= _WHOLE:
        return _short_path(rows, "0", _ENDS)
    cost, letters, at, state = 0, [], 0, "0"
    for end, next_state in chain(_cuts(rows), [(n, _ENDS)]):
        part = rows[2 * at : 2 * end]
        more, found = (_short_path if end - at <= _REMEMBERED else _path)(part, state, next_state)
        cost += more
        letters.append(found)
        at, state = end, next_state
    return cost, "".join(letters)


def replay(letters: str, roles: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(letter, role written or null) for each letter; `roles` gives the rows' roles."""
    last = ""
    for letter in letters:
        own = "" if letter == "I" else next(roles)
        if letter == "D":
            yield letter, None
            continue
        if letter == "K":
            role = own
        else:
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield letter, role


def damaged(df: DataFrame, text: str = "text", row_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The rows with the stated damage done: conv, turn, role, text and `copies` (0 for a row that is dropped)."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(row_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    own = F.coalesce(F.col(text), space)
    rows = df.select(
        F.col(row_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), own.alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    )
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


_ORDER = ("turn", "role", "digest")


def _same(names: tuple[str, ...]) -> Column:
    """Equal in all the columns, nulls among them."""
    found = F.lit(True)
    for name in names:
        found = found & F.col(f"r.{name}").eqNullSafe(F.col(f"f.{name}"))
    return found


def _marked(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv, turn, role, digest, n, blank, first, cut. `rows` are damaged ones with their digest."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    narrow = rows.groupBy(
        "conv", *_ORDER, (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut")
    ).agg(F.sum("copies").alias("n"))
    narrow = stored(narrow, "conversation_rows")
    # The first turn of a role and text, nulls first, is a row of its own: the join has one partner at most.
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = narrow.where("n > 0").groupBy("conv", "role", "digest").agg(F.min(at)["turn"].alias("turn"))
    found = first.withColumn("first", F.lit(True)).alias("f")
    joined = narrow.alias("r").join(found, _same(("conv", *_ORDER)), "left")
    return joined.select("r.*", F.coalesce("f.first", F.lit(False)).alias("first"))


def _conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation from its marked rows: counts, cost and letters."""
    found = StructType().add("conv", rows.schema["conv"].dataType)
    for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        found = found.add(c, "long")
    found = found.add("audit", "string")
    schema = _arrow(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, begun = None, False
        held: dict = {}

        def ended() -> None:
            signs = held["signs"].decode("latin-1")
            cost, letters = repair(signs)
            gaps = held["most"] - held["least"] + 1 - held["turns"] if held["turns"] else 0
            out.append((conv, gaps, held["blank"], held["duplicate"], held["truncated"], held["illegal"], cost, letters))

        for batch in batches:
            for key, turn, initial, n, blank, cut, first in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or key != conv:
                    if begun:
                        ended()
                    conv, begun = key, True
                    held = dict(signs=bytearray(), least=None, most=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, last="")
                if not n:
                    continue
                if turn is not None and turn != held["most"]:
                    held["turns"] += 1
                    held["most"] = turn
                    if held["least"] is None:
                        held["least"] = turn
                sign = initial if initial in ("s", "u", "a") else "-"
                for copy in range(n):
                    if held["signs"] and held["last"] + initial not in ("su", "ua", "au"):
                        held["illegal"] += 1
                    held["last"] = initial
                    if blank:
                        held["blank"] += 1
                        mark = GOES
                    elif not first or copy:
                        held["duplicate"] += 1
                        mark = GOES
                    elif cut:
                        held["truncated"] += 1
                        mark = CUT
                    else:
                        mark = SOUND
                    held["signs"] += (sign + mark).encode()
            while len(out) >= 1000:
                part, out = out[:1000], out[1000:]
                yield _batch(part, schema)
        if begun:
            ended()
        if out:
            yield _batch(out, schema)

    ordered = rows.select("conv", *_ORDER, F.substring("role", 1, 1).alias("initial"), "n", "blank", "cut", "first")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", *_ORDER)
    return ordered.select("conv", "turn", "initial", "n", "blank", "cut", "first").mapInArrow(run, found)


def _arrow(schema: StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The conversations with `repaired_sha256`: their texts pass behind their letters, in order."""
    found = StructType([*conversations.schema.fields]).add("repaired_sha256", "string")
    arrow = _arrow(found)
    counted = [f for f in conversations.columns if f != "conv"]
    heads = conversations.select(
        "conv", F.lit(0).alias("part"), F.struct(*counted).alias("head"),
        *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*_ORDER, "text", "n")),
    )
    texts = rows.select("conv", F.lit(1).alias("part"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), *_ORDER, "text", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current: dict | None = None

        def ended() -> None:
            for _, role in current["left"]:
                written(role, "")
            out.append((current["conv"], *current["head"].values(), current["sha"].hexdigest()))

        def written(role: str | None, text: str | None) -> None:
            if role is not None:
                current["sha"].update(f"{current['between']}{role}:{text or ''}".encode())
                current["between"] = "\n"

        def roles() -> Iterator[str]:
            while True:
                yield current["role"]

        for batch in batches:
            for conv, part, head, role, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if current is not None:
                        ended()
                    current = {"conv": conv, "head": head, "sha": hashlib.sha256(), "between": "", "role": ""}
                    current["left"] = replay(head["audit"], roles())
                    continue
                current["role"] = role
                for _ in range(n):
                    for letter, made in current["left"]:
                        written(made, "" if letter == "I" else text)
                        if letter != "I":
                            break
            while len(out) >= 1000:
                done, out = out[:1000], out[1000:]
                yield _batch(done, arrow)
        if current is not None:
            ended()
        if out:
            yield _batch(out, arrow)

    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "part", *_ORDER)
    return both.select("conv", "part", "head", "role", "text", "n").mapInArrow(run, found)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv, turn, role, text, copies): conv, the counts, `cost`, `audit`, `repaired_sha256`."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    conversations = stored(_conversations(_marked(rows)), "conversations")
    return _digests(conversations, rows.where("copies > 0").withColumnRenamed("copies", "n"))


def repair_conversations(df: DataFrame, text: str = "text", row_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Damage the rows as stated, then repair each conversation; one row for every id."""
    return repaired(damaged(df, text, row_id, turn, role)).withColumnRenamed("conv", row_id)


#: The same by damage, facts and a fold from the last row to the first that keeps the least (cost, letters) of each state.
#: One state's list holds nothing once it cannot be reached. `crc` has a bit-wise CRC-32, which DuckDB lacks.
ORACLE = r"""
    WITH named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations
    ), kinds AS (
        SELECT *, xor(list_reduce(
            list_transform(range(0, 8 * len(name) + 1), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE
                CASE WHEN (k - 1) % 8 = 0 THEN 256 + ascii(name[(k - 1) // 8 + 1]) ELSE 0 END END),
            lambda acc, x: CASE WHEN xor(acc, CASE WHEN x >= 256 THEN x - 256 ELSE 0 END) % 2 = 1
                THEN xor(xor(acc, CASE WHEN x >= 256 THEN x - 256 ELSE 0 END) // 2, 3988292384)
                ELSE xor(acc, CASE WHEN x >= 256 THEN x - 256 ELSE 0 END) // 2 END), 4294967295) % 20 AS kind
        FROM named
    ), rows_ AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM kinds
    ), placed AS (
        SELECT *, sha256(text) AS digest,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
               regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid
        FROM rows_
    ), judged AS (
        SELECT *, left(role, 1) AS initial, solid = '' AS blank,
               solid <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
               right(solid, 1) NOT IN ('.', '!', '?') AS cut,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
        FROM placed
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
               count_if(duplicate) AS duplicate, count_if(cut AND NOT blank AND NOT duplicate) AS truncated,
               count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
               list({'i': initial, 'goes': blank OR duplicate, 'more': CASE WHEN cut THEN 5 ELSE 0 END} ORDER BY pos) AS signs,
               list({'role': role, 'text': text} ORDER BY pos) AS kept
        FROM judged GROUP BY conv_id
    ), ended AS (
        SELECT conv_id, len(signs) AS n, signs FROM counted
    ), walked AS (
        WITH RECURSIVE walk AS (
            SELECT conv_id, n AS pos, 0 AS c0, '' AS l0, 10 AS cs, 'II' AS ls, 5 AS cu, 'I' AS lu, 0 AS ca, '' AS la
            FROM ended
            UNION ALL
            SELECT conv_id, pos, b0.c, b0.l, bs.c, bs.l, bu.c, bu.l, ba.c, ba.l
            FROM (
                SELECT conv_id, pos,
                    least({'c': r0.c, 'l': r0.l}, {'c': 5 + ru.c, 'l': 'I' || ru.l}, {'c': 10 + ra.c, 'l': 'II' || ra.l}) AS b0,
                    least({'c': rs.c, 'l': rs.l}, {'c': 5 + ru.c, 'l': 'I' || ru.l}, {'c': 10 + ra.c, 'l': 'II' || ra.l}) AS bs,
                    least({'c': ru.c, 'l': ru.l}, {'c': 5 + ra.c, 'l': 'I' || ra.l}) AS bu,
                    least({'c': ra.c, 'l': ra.l}, {'c': 5 + ru.c, 'l': 'I' || ru.l}) AS ba
                FROM (
                    SELECT conv_id, pos,
                        least({'c': 2 + c0, 'l': 'D' || l0},
                              {'c': off + CASE WHEN x.i = 's' THEN cs ELSE 99999999 END, 'l': 'K' || ls},
                              {'c': off + CASE WHEN x.i = 'u' THEN cu ELSE 1 + cu END, 'l': CASE WHEN x.i = 'u' THEN 'K' ELSE 'R' END || lu}) AS r0,
                        least({'c': 2 + cs, 'l': 'D' || ls},
                              {'c': off + CASE WHEN x.i = 'u' THEN cu ELSE 1 + cu END, 'l': CASE WHEN x.i = 'u' THEN 'K' ELSE 'R' END || lu}) AS rs,
                        least({'c': 2 + cu, 'l': 'D' || lu},
                              {'c': off + CASE WHEN x.i = 'a' THEN ca ELSE 1 + ca END, 'l': CASE WHEN x.i = 'a' THEN 'K' ELSE 'R' END || la}) AS ru,
                        least({'c': 2 + ca, 'l': 'D' || la},
                              {'c': off + CASE WHEN x.i = 'u' THEN cu ELSE 1 + cu END, 'l': CASE WHEN x.i = 'u' THEN 'K' ELSE 'R' END || lu}) AS ra
                    FROM (
                        SELECT w.*, w.pos - 1 AS before, b.signs[w.pos] AS x,
                               CASE WHEN b.signs[w.pos].goes THEN 9999999 ELSE b.signs[w.pos].more END AS off
                        FROM walk w JOIN ended b ON w.conv_id IS NOT DISTINCT FROM b.conv_id WHERE w.pos > 0
                    ) AS q (conv_id, pos_, c0, l0, cs, ls, cu, lu, ca, la, pos, x, off)
                ) AS rows_read
            ) AS inserted
        )
        SELECT conv_id, c0 AS cost, l0 AS audit FROM walk WHERE pos = 0
    ), written AS (
        SELECT counted.conv_id, walked.cost, walked.audit, counted.kept, unnest(range(1, len(audit) + 1)) AS k FROM walked
        JOIN counted ON walked.conv_id IS NOT DISTINCT FROM counted.conv_id
    ), lines AS (
        SELECT conv_id, k, audit[k] AS letter, kept[len(replace(audit[1:k], 'I', ''))] AS own,
               len(replace(audit[1:k], 'D', '')) - CASE WHEN audit[1:k] SIMILAR TO 'D*K.*' AND
                   left(kept[len(replace(regexp_extract(audit, '^D*K'), 'I', ''))].role, 1) = 's' THEN 1 ELSE 0 END AS place
        FROM written
    ), repaired AS (
        SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN own.role ELSE CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END END
                   || ':' || CASE letter WHEN 'I' THEN '' ELSE own.text END, chr(10) ORDER BY k) AS body
        FROM lines WHERE letter <> 'D' GROUP BY conv_id
    )
    SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN walked w ON i.conv_id IS NOT DISTINCT FROM w.conv_id
    LEFT JOIN repaired r ON i.conv_id IS NOT DISTINCT FROM r.conv_id"""
