"""Repair of conversation structure by iterative-deepening A*.

The rows of a conversation become a legal one, role initials `(s?(ua)+)?`, by the cheapest edits: Keep, Rerole, Delete, Insert.
A depth-first search tries the edits in ASCII order under a bound on the cost; what a state has failed to reach is kept as
its proven least cost to go (the transposition table), and the least cost that exceeded a bound is the next bound.  So the first
path that is accepted is cheapest, and of the cheapest the ASCII-least.

A long conversation is searched in blocks of BLOCK rows, each by itself, from each state it may begin in to each it may end
in; the blocks' paths are then put together in order.  That loses nothing: two paths of equal cost between the same states
differ before either ends, as a longer one would have paid for its inserts, so their order is not changed by what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import crc32_sql, written
from cadentia.llm.ranking import in_groups, in_order

#: Rows that are searched at once.
BLOCK = 32
RENAME, REMOVE, ADD, CUT = 1, 2, 5, 5
#: States: nothing kept yet, after a system turn, after a user turn, after an assistant turn.  An empty conversation, or one that
#: ends with an assistant turn, is complete.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The turn that Rerole and Insert make in a state.
WANTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What is wrong with a row: nothing, it is cut off, it has to go.
SOUND, TRUNCATED, DOOMED = range(3)


def cheapest(rows: list[tuple[str, int]], starts: tuple[int, ...], ends: tuple[int, ...]) -> dict[int, tuple[int, str, int]]:
    """start -> (cost, edits, end) of the best path over all rows (role initial, fault) from that state to one of `ends`; starts
    without one are left out."""
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        least[i] = least[i + 1] + (REMOVE if fault else 0 if initial in ("s", "u", "a") else RENAME)
    proven: dict[tuple[int, int, int], float] = {}

    def edits(i, state, inserted):
        if i < n:
            yield "D", REMOVE, (i + 1, state, 0)
        if inserted < 2:  # three would come back to a state of the same row
            yield "I", ADD, (i, WANTED[state], inserted + 1)
        if i < n and rows[i][1] != DOOMED:
            more = CUT if rows[i][1] == TRUNCATED else 0
            if rows[i][0] in NEXT[state]:
                yield "K", more, (i + 1, NEXT[state][rows[i][0]], 0)
            yield "R", RENAME + more, (i + 1, WANTED[state], 0)

    def descend(at, room):
        if at[0] == n and at[1] in ends:
            return "", at[1]
        need = inf
        for edit, cost, then in edits(*at):
            if cost + proven.get(then, least[then[0]]) <= room:
                rest = descend(then, room - cost)
                if rest is not None:
                    return edit + rest[0], rest[1]
            need = min(need, cost + proven.get(then, least[then[0]]))
        proven[at] = need
        return None

    found = {}
    for start in starts:
        at, bound = (0, start, 0), proven.get((0, start, 0), least[0])
        while bound <= REMOVE * n + 2 * ADD:  # all rows deleted and two put in: what can be reached costs no more
            path = descend(at, bound)
            if path is not None:
                found[start] = (int(bound), *path)
                break
            bound = proven[at]
    return found


def ahead(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal key, from sorted batches; key columns come first."""
    k, held, rows = len(key), None, []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            mark = row[:k]
            if rows and mark != held:
                yield held, rows
                rows = []
            held = mark
            rows.append(row[k:])
    if rows:
        yield held, rows


def frames(rows: Iterator[tuple], columns: list[str], most: int = 5_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id (as text, so that a null is no float in pandas), role, text, turn, rank, block and last (whether that is the last): the rows by turn (nulls first), then
    role, then text; null roles and texts are one space."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    placed = in_groups(in_order(rows, ["conv_id", "turn", "role", "text"], "repair-placed"), "conv_id", "repair")
    block = lambda x: F.expr(f"{x} div {BLOCK}")
    return placed.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text", "rank", block("rank").alias("block"), (block("rank") == block("(n - 1)")).alias("last"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, block, last, rank, turn, initial, fault (blank, duplicate, truncated or null) of ordered rows, without their texts.

    The first row of each (conversation, role, text) is found by a partial aggregation over digests, and matched by its rank, so
    a text that fills a conversation meets in no task."""
    sign = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    light = rows.select("conv_id", "block", "last", "rank", "turn", F.substring("role", 1, 1).alias("initial"), sign.alias("sign"), said.alias("said"))
    first = light.groupBy("conv_id", "said").agg(F.min("rank").alias("rank")).select(F.col("conv_id").alias("first_conv"), F.col("rank").alias("first_rank"))
    both = light.join(first, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("rank") == F.col("first_rank")), "left")
    fault = F.when(F.col("sign") == "", "blank").when(F.col("first_rank").isNull(), "duplicate").when(~F.col("sign").isin(".", "!", "?"), "truncated")
    return both.select("conv_id", "block", "last", "rank", "turn", "initial", fault.alias("fault"))


def plan(faulty: DataFrame) -> DataFrame:
    """conv_id, block, state (where the block's edits begin), audit (its edits), cost (of the whole conversation), illegal (pairs of
    adjacent rows of the whole conversation), all for each block."""

    def search(batches):
        def results():
            for (conv, block), rows in ahead(batches, ["conv_id", "block"]):
                turns = [(r[2], DOOMED if r[3] in ("blank", "duplicate") else TRUNCATED if r[3] else SOUND) for r in rows]
                initials = [r[2] for r in rows]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                # The first block begins with nothing kept, and after the last any complete state will do; else every pair of states.
                starts = (NOTHING,) if block == 0 else (NOTHING, SYSTEM, USER, ASSISTANT)
                goals = [(NOTHING, ASSISTANT)] if rows[0][0] else [(end,) for end in range(4)]
                ways = [(s, *way) for ends in goals for s, way in cheapest(turns, starts, ends).items()]
                yield conv, block, illegal, initials[0], initials[-1], [{"start": a, "end": d, "cost": b, "audit": c} for a, b, c, d in ways]

        return frames(results(), ["conv_id", "block", "illegal", "first", "last", "ways"])

    def compose(batches):
        """Blocks of a conversation in order.  What all paths that are still possible have in common is handed out at once, so
        only where they differ is held."""

        def results():
            conv, begun, at, ways, illegal, last = None, False, 0, {}, 0, None

            def finish():
                best = min((ways[s][0], "".join(p for *_, p in ways[s][1]), s) for s in (NOTHING, ASSISTANT) if s in ways)
                for block, state, piece in ways[best[2]][1]:
                    yield conv, block, state, piece, None, None
                yield conv, None, None, None, best[0], illegal

            for batch in batches:
                for c, block, inside, first, final, options in batch.itertuples(index=False, name=None):
                    if not begun or c != conv:
                        if begun:
                            yield from finish()
                        conv, begun, ways, illegal, last = c, True, {NOTHING: (0, [])}, 0, None
                    illegal += inside + (last is not None and last + first not in ("su", "ua", "au"))
                    last, then = final, {}
                    for o in options:
                        if o["start"] in ways:
                            cost, pieces = ways[o["start"]]
                            one = (cost + o["cost"], [*pieces, (block, o["start"], o["audit"])])
                            held = then.get(o["end"])
                            if held is None or (one[0], "".join(p for *_, p in one[1])) < (held[0], "".join(p for *_, p in held[1])):
                                then[o["end"]] = one
                    ways = then
                    while len({w[1][0] if w[1] else None for w in ways.values()}) == 1 and next(iter(ways.values()))[1]:
                        yield conv, *next(iter(ways.values()))[1][0], None, None
                        ways = {s: (cost, pieces[1:]) for s, (cost, pieces) in ways.items()}
            if begun:
                yield from finish()

        return frames(results(), ["conv_id", "block", "state", "audit", "cost", "illegal"])

    ways = "conv_id string, block long, illegal long, first string, last string, ways array<struct<start:int,end:int,cost:long,audit:string>>"
    key = ["conv_id", "block"]
    searched = faulty.select(*key, "last", "rank", "initial", "fault").repartition(*key).sortWithinPartitions(*key, "rank").mapInPandas(search, ways)
    composed = written(searched, "repair-blocks").repartition("conv_id").sortWithinPartitions(*key).mapInPandas(compose, "conv_id string, block long, state int, audit string, cost long, illegal long")
    return written(composed, "repair-plan")


def repair(rows: DataFrame, edits: DataFrame, deal: tuple[str, ...] = ("conv_id", "block")) -> DataFrame:
    """conv_id, block, step, edit, role, text: a row for each edit but Delete; block and the step among its edits give the order,
    which rows also have within a part.

    Rows and their block's edits come as one sorted stream, so a task holds one row.  Blocks are dealt apart; dealt by conv_id
    alone, a conversation comes out in order."""
    state = F.lit(None).cast("int")
    text = rows.select("conv_id", "block", "rank", F.lit(1).alias("kind"), state.alias("state"), F.lit(None).cast("string").alias("audit"), "role", "text")
    none = F.lit(None).cast("string")
    given = edits.filter("block IS NOT NULL").select("conv_id", "block", (F.col("block") * BLOCK).alias("rank"), F.lit(0).alias("kind"), "state", "audit", none.alias("role"), none.alias("text"))

    def run(batches):
        def results():
            audit, at, state, conv, block = "", 0, NOTHING, None, 0

            def inserts():
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    state, at = WANTED[state], at + 1
                    yield conv, block, at - 1, "I", NAMES[state], ""

            for batch in batches:
                for c, b, _, kind, begin, given, role, said in batch.itertuples(index=False, name=None):
                    yield from inserts()
                    if kind == 0:
                        audit, at, state, conv, block = given, 0, int(begin), c, b
                        continue
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = NEXT[state][role[0]]
                        yield c, b, at - 1, "K", role, said
                    elif edit == "R":
                        state = WANTED[state]
                        yield c, b, at - 1, "R", NAMES[state], said
            yield from inserts()

        return frames(results(), ["conv_id", "block", "step", "edit", "role", "text"])

    both = text.unionByName(given).repartition(*deal).sortWithinPartitions("conv_id", "block", "kind", "rank")
    return both.mapInPandas(run, "conv_id string, block long, step long, edit string, role string, text string")


def summaries(faulty: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    seen = faulty.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated")
    )
    pieces = F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "audit"))))
    planned = edits.groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    planned = planned.withColumnRenamed("conv_id", "planned_conv")
    return seen.join(planned, F.col("conv_id").eqNullSafe(F.col("planned_conv"))).drop("planned_conv")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired rows that come by conversation, in order: a digest is made from first byte to last."""

    def run(batches):
        def results():
            conv, begun, digest = None, False, None
            for batch in batches:
                for c, _, _, _, role, said in batch.itertuples(index=False, name=None):
                    if not begun or c != conv:
                        if begun:
                            yield conv, digest.hexdigest()
                        conv, begun, digest = c, True, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(f"{role}:{said}".encode())
            if begun:
                yield conv, digest.hexdigest()

        return frames(results(), ["digest_conv", "repaired_sha256"])

    return repaired.mapInPandas(run, "digest_conv string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the contract's faults, by the CRC-32 of `conv_id:turn` (nulls: one space) modulo 20."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space, so a null text is blank.  A null turn comes first and counts in no gap; equal turns
    go by role, then text; of rows that repeat, the first stays.  Rows with a null conv_id are one conversation.  A role
    that begins with none of s, u, a (an empty one, too) cannot be kept.  An empty table gives an empty result; other columns
    are not read.  Search and edits are dealt by blocks of a conversation; its plan (its edits) and its digest pass one task."""
    rows = ordered(conversations)
    faulty = written(faults(rows), "repair-faults")
    edits = plan(faulty)
    said = digests(repair(rows, edits, ("conv_id",)))
    both = summaries(faulty, edits).join(said, F.col("conv_id").eqNullSafe(F.col("digest_conv")), "left")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).withColumn("conv_id", F.col("conv_id").cast("long")).drop("digest_conv")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = rows.select(F.col("conv_id").cast("long").alias("every_conv")).distinct()
    found = repair_conversations(damage(rows))
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    out = every.join(found, F.col("every_conv").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("every_conv").alias("conv_id"), *(F.coalesce(c, F.lit(z).cast("long" if z == 0 else "string")).alias(c) for c, z in zeros.items()))

_NAME_SQL = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

#: The cheapest edits by dynamic programming over rows and states: `way` has, for each conversation, row and state, the least
#: (cost, edits); up to two inserts go before each row and after the last.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_NAME_SQL)} % 20 AS kind FROM conversations),
r0 AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM r0),
r2 AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS last FROM r1),
rows AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    CASE WHEN last = '' OR nth > 1 THEN NULL WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more FROM r2),
keeps(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
wanted(s, t, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts(s, t, c, e, out) AS (
  SELECT s, s, 0, '', [] FROM wanted
  UNION ALL SELECT s, t, 5, 'I', [name || ':'] FROM wanted
  UNION ALL SELECT a.s, b.t, 10, 'II', [a.name || ':', b.name || ':'] FROM wanted a JOIN wanted b ON b.s = a.t),
moves AS (
  SELECT conv_id, i, s, s AS t, 2 AS c, 'D' AS e, []::VARCHAR[] AS out FROM rows, (SELECT DISTINCT s FROM wanted)
  UNION ALL SELECT conv_id, i, s, t, more, 'K', [role || ':' || text] FROM rows JOIN keeps USING (initial) WHERE more IS NOT NULL
  UNION ALL SELECT conv_id, i, s, t, 1 + more, 'R', [name || ':' || text] FROM rows, wanted WHERE more IS NOT NULL),
way AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'e': '', 'out': []::VARCHAR[]}} AS best FROM rows
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.t, min({{'c': w.best.c + j.c + m.c, 'e': w.best.e || j.e || m.e, 'out': w.best.out || j.out || m.out}})
  FROM way w JOIN inserts j ON j.s = w.s JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.s = j.t GROUP BY ALL),
found AS (
  SELECT w.conv_id, min({{'c': w.best.c + j.c, 'e': w.best.e || j.e, 'out': w.best.out || j.out}}) AS best
  FROM way w JOIN inserts j ON j.s = w.s AND j.t IN (0, 3) JOIN (SELECT DISTINCT conv_id, n FROM rows) k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.n = w.i GROUP BY ALL),
seen AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT e.conv_id::BIGINT AS conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
  coalesce(s.illegal, 0) AS illegal, coalesce(f.best.c, 0)::BIGINT AS cost, coalesce(f.best.e, '') AS audit, sha256(coalesce(array_to_string(f.best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN seen s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
