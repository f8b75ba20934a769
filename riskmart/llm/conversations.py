"""Operator 11: repair of conversation structure by depth-first branch-and-bound.

A conversation's rows, in order, are kept, given another role or deleted, and empty
user or assistant turns are inserted, so that the roles read ``(system? (user
assistant)+)?``. The cheapest edits win, ties the ASCII-least sequence of their initials
(the audit).

Rows are sorted over the whole table by range partitions, so a conversation that holds a
third of all rows spans many tasks, and cut into blocks of ``BLOCK`` rows. A block needs
one small code per row, no text. A conversation inside one block is searched from the
start state to an accepted end; one that crosses blocks is searched in each block from
every state to every state, and the blocks' costs (four by four numbers and the order of
their audits) are chained. Inserts stand directly before a kept or re-roled row, or at the
very end, so no audit of a block is the beginning of another and the least audits of the
blocks make the least audit of the whole.

A last pass streams the rows of every conversation in order beside their audits and
hashes the repaired text piece by piece. SHA-256 is sequential, so a conversation's text
passes through one task there, of which only one Arrow batch, the audit (one letter a
row, a result column) and the hash state are held.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import range_partitions
from .common import drop_stored, prepare, store
from .manifest import crc32_sql

BLOCK_BITS = 10               # rows of a block: 2 ** BLOCK_BITS
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
#: What has been said so far: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
SAID = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Cost and audit of what must still be inserted after the last row.
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
WINDOW = 16                   # rows over which the bound follows the states
FAR = 1 << 40
REMEMBERED = 20_000           # searches kept per task


def _moves() -> dict[str, list[list[tuple[int, str, int]]]]:
    """Per row code and state the edits worth a try: (cost, letters, next state).

    A code is the role initial (s, u, a, x for others) and the fault (f fine, t
    truncated, d must be deleted)."""
    out = {}
    for role in "suax":
        for fault in "ftd":
            table = []
            for state in STATES:
                found = [(DELETE, "D", state)]
                if fault != "d":
                    extra = TRUNCATED if fault == "t" else 0
                    for cost, letters, at in ((0, "", state), (INSERT, "I", INSERTED[state])):
                        if at in SAID[role]:
                            found.append((cost + KEEP + extra, letters + "K", SAID[role][at]))
                        found.append((cost + REROLE + extra, letters + "R", INSERTED[at]))
                best: dict[int, tuple[int, str]] = {}
                for cost, letters, to in sorted(found):
                    best.setdefault(to, (cost, letters))
                table.append([(cost, letters, to) for to, (cost, letters) in best.items()])
            out[role + fault] = table
    return out


MOVES = _moves()


def bounds(codes: list[str], goals: dict[int, tuple[int, str]], window: int = WINDOW) -> list[list[int]]:
    """Lower bound of the cost from every (row, state) to a goal: exact within a window
    of rows, and free to change the state between two windows."""
    n = len(codes)
    h = [[0] * 4 for _ in range(n)] + [[goals[s][0] if s in goals else FAR for s in STATES]]
    for i in range(n - 1, -1, -1):
        nxt = h[i + 1]
        if (i + 1) % window == 0 and i + 1 < n:
            nxt = [min(nxt)] * 4
        table = MOVES[codes[i]]
        h[i] = [min(c + nxt[to] for c, _, to in table[s]) for s in STATES]
    return h


def search(codes: list[str], start: int, goals: dict[int, tuple[int, str]], window: int = WINDOW):
    """(cost, audit) of the cheapest edits from ``start`` to a goal state, ties by the
    least audit; None if there is no way. ``goals`` maps states to their (cost, audit)
    after the last row.

    Depth first with an explicit stack. A prefix goes if its cost and bound exceed the
    incumbent's cost, if they equal it and its audit is already greater, or if its node
    (row, state) was reached by a prefix that is no worse. When the stack is empty the
    incumbent is optimal.
    """
    n = len(codes)
    h = bounds(codes, goals, window)
    if h[0][start] >= FAR:
        return None
    best_cost, best_audit = FAR, ""
    seen: dict[int, tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, s, cost, audit = stack.pop()
        total = cost + h[i][s]
        if total > best_cost or (total == best_cost and audit > best_audit):
            continue
        known = seen.get(4 * i + s)
        if known is not None and known < (cost, audit):
            continue
        if i == n:
            cost, audit = total, audit + goals[s][1]
            if (cost, audit) < (best_cost, best_audit):
                best_cost, best_audit = cost, audit
            continue
        after, children = h[i + 1], []
        for c, letters, to in MOVES[codes[i]][s]:
            g = cost + c
            f = g + after[to]
            if f > best_cost:
                continue
            longer = audit + letters
            node = 4 * (i + 1) + to
            old = seen.get(node)
            if old is not None and old <= (g, longer):
                continue
            seen[node] = (g, longer)
            children.append((f, longer, to, g))
        children.sort(reverse=True)               # the cheapest is on top
        stack.extend((i + 1, to, g, longer) for _, longer, to, g in children)
    return best_cost, best_audit


def _blocks():
    """Per block: a row per piece of a conversation. Whole conversations carry their
    audit; open pieces the costs, the order and the audits of all state pairs."""
    fields = "conv string, block long, pos long, whole boolean, codes string, costs array<long>, " \
             "ranks array<int>, audits array<string>"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pos", "ascending"), ("first", "ascending")])
        pos, first = table.column("pos").to_pylist(), table.column("first").to_pylist()
        conv, code = table.column("conv").to_pylist(), table.column("code").to_pylist()
        block = table.column("block")[0].as_py()
        pieces: list[tuple] = []                   # (conversation, first place, codes)
        firsts = {p for p, f in zip(pos, first) if f}
        at = [i for i, f in enumerate(first) if not f]
        for i in at:
            c = code[i]
            if c[1] != "b" and pos[i] not in firsts:
                c = c[0] + "r"
            if not pieces or pieces[-1][0] != conv[i]:
                pieces.append((conv[i], pos[i], []))
            pieces[-1][2].append(c)
        memo = remembered
        out = {name: [] for name in ("conv", "block", "pos", "whole", "codes", "costs", "ranks", "audits")}
        for k, (cv, start, codes) in enumerate(pieces):
            # what touches the edge of a block may go on in the next one
            whole = 0 < k < len(pieces) - 1
            plain = tuple(c[0] + ("d" if c[1] in "br" else c[1]) for c in codes)
            got = memo.get((whole, plain))
            if got is None:
                if whole:
                    got = ([], [], [search(plain, START, TAIL)[1]])
                else:
                    found = [[search(plain, a, {b: (0, "")}) for b in STATES] for a in STATES]
                    ranks = [sorted({x[1] for x in row if x}) for row in found]
                    got = ([x[0] if x else None for row in found for x in row],
                           [ranks[a].index(x[1]) if x else None for a, row in enumerate(found) for x in row],
                           [x[1] if x else None for row in found for x in row])
                if len(memo) >= REMEMBERED or len(plain) > 64:
                    memo.clear()
                memo[(whole, plain)] = got
            for name, value in zip(out, (cv, block, start, whole, "".join(c[1] for c in codes), *got)):
                out[name].append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.string()))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    remembered: dict = {}
    return run, fields


def chained(table: pa.Table) -> pa.Table:
    """State pair of every piece of one conversation on its cheapest, least way."""
    table = table.sort_by("block")
    costs, ranks = table.column("costs").to_pylist(), table.column("ranks").to_pylist()
    ahead = [[TAIL[s][0] for s in STATES]]
    for c in reversed(costs):
        ahead.append([min((c[4 * a + b] + ahead[-1][b] for b in STATES if c[4 * a + b] is not None), default=FAR)
                      for a in STATES])
    ahead.reverse()
    state, pairs = START, []
    for k, (c, r) in enumerate(zip(costs, ranks)):
        _, _, to = min((c[4 * state + b] + ahead[k + 1][b], r[4 * state + b], b) for b in STATES
                       if c[4 * state + b] is not None)
        pairs.append(4 * state + to)
        state = to
    tail = [""] * len(pairs)
    if tail:
        tail[-1] = TAIL[state][1]
    return pa.table({"conv": table.column("conv"), "block": table.column("block"),
                     "pair": pa.array(pairs, pa.int32()), "tail": pa.array(tail, pa.string())})


class _Report:
    """Counts, audit and hash of one conversation, fed in order."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.hash, self.lines = conv, [], hashlib.sha256(), 0
        self.gap_low = self.gap_high = self.last_turn = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"b": 0, "r": 0, "t": 0}
        self.initial = None
        self.edits: list[str] = []
        self.codes, self.place, self.at, self.state = "", 0, 0, START

    def piece(self, audit: str, codes: str) -> None:
        self._rest()
        self.audit.append(audit)
        self.edits, self.at, self.codes, self.place = audit, 0, codes, 0

    def _line(self, head: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + head + ":").encode())
        self.hash.update(text.encode())
        self.lines += 1

    def _say(self, role: str, text: str, initial: str) -> None:
        self._line(role, text)
        self.state = SAID[initial][self.state]

    def _insert(self) -> None:
        role = "assistant" if self.state == USER else "user"
        self.cost += INSERT
        self._say(role, "", role[0])

    def _rest(self) -> None:
        while self.at < len(self.edits):
            self._insert()
            self.at += 1

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.gap_low = turn if self.gap_low is None else self.gap_low
            self.gap_high = self.last_turn = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        fault = self.codes[self.place]
        self.place += 1
        if fault in self.faults:
            self.faults[fault] += 1
        while self.edits[self.at] == "I":
            self._insert()
            self.at += 1
        edit = self.edits[self.at]
        self.at += 1
        self.cost += COST[edit] + (TRUNCATED if fault == "t" and edit != "D" else 0)
        if edit == "K":
            self._say(role, text, initial)
        elif edit == "R":
            role = "assistant" if self.state == USER else "user"
            self._say(role, text, role[0])

    def result(self) -> tuple:
        self._rest()
        gaps = 0 if self.gap_low is None else self.gap_high - self.gap_low + 1 - self.turns
        return (self.conv, gaps, self.faults["b"], self.faults["r"], self.faults["t"], self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


RESULT = [("conv", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
          ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
          ("repaired_sha256", pa.string())]


def _report(batches):
    """Rows sorted by conversation, place and kind: 0 the conversation, 1 a piece (its
    codes and audit), 2 a row."""
    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done), RESULT)],
                                          names=[n for n, _ in RESULT])

    now, done = None, []
    for batch in batches:
        for conv, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if now is not None:
                    done.append(now.result())
                now = _Report(conv)
            elif kind == 1:
                now.piece(text, role)
            else:
                now.row(turn, role, text)
        if len(done) > 10_000:
            yield table(done)
            done = []
    if now is not None:
        done.append(now.result())
    if done:
        yield table(done)


def damaged(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage; nulls read as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (conv.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        fault.alias("fault")).where("fault != 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, F.lit(""))
                    .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                    .alias("copy"))
            .drop("copy"))


def row_code(role: Column, text: Column) -> Column:
    """Role initial (s, u, a, x) and fault: b blank, t truncated, f neither."""
    initial = F.substring(role, 1, 1)
    end = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
                    F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "f").otherwise("t"))


def repaired(rows: DataFrame, ids: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id) with its counts, cost, audit and the
    hash of its repaired text. ``rows``: conv_id, turn, role, text without null roles and
    texts.

    A null conv_id is a conversation of its own. Null turns come first; rows of one turn
    are taken by role, then by their digest; equal rows are duplicates of the first. Other
    roles than system, user and assistant count by their initial. Conversations without
    rows have zeros, an empty audit and the hash of nothing. An empty table gives an
    empty result. Texts of any length are held one Arrow batch at a time.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = dict(ids.dtypes)["conv_id"]
    # a text key that is never null
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    mark = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = ["conv", "turn", "role", "mark"]
    placed = (rows.select(conv.alias("conv"), "turn", "role", "text", mark.alias("mark"),
                          F.monotonically_increasing_id().alias("uid"))
              .repartitionByRange(range_partitions(spark), *order, "uid").sortWithinPartitions(*order, "uid")
              .withColumn("pos", F.monotonically_increasing_id()).drop("uid"))
    placed = store(placed, "op11-rows")
    block = F.shiftright("pos", block_bits).alias("block")
    firsts = (placed.groupBy("conv", "mark").agg(F.min("pos").alias("pos"))
              .select(block, "pos", F.lit("").alias("conv"), F.lit("").alias("code"), F.lit(True).alias("first")))
    codes = placed.select(block, "pos", "conv", row_code(F.col("role"), F.col("text")).alias("code"),
                          F.lit(False).alias("first"))
    solve, fields = _blocks()
    pieces = store(codes.unionByName(firsts).groupBy("block").applyInArrow(solve, fields), "op11-pieces")
    pairs = pieces.where("NOT whole").select("conv", "block", "costs", "ranks").groupBy("conv") \
        .applyInArrow(chained, "conv string, block long, pair int, tail string")
    audits = (pieces.where("whole").select("conv", "pos", "codes", F.element_at("audits", 1).alias("audit"))
              .unionByName(pieces.join(pairs, ["conv", "block"])
                           .select("conv", "pos", "codes",
                                   F.concat(F.element_at("audits", F.col("pair") + 1), "tail").alias("audit"))))
    null = F.lit(None).cast("long")
    stream = (ids.select(conv.alias("conv"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), null.alias("turn"),
                         F.lit("").alias("role"), F.lit("").alias("text")).distinct()
              .unionByName(audits.select("conv", "pos", F.lit(1).alias("kind"), null.alias("turn"),
                                         F.col("codes").alias("role"), F.col("audit").alias("text")))
              .unionByName(placed.select("conv", "pos", F.lit(2).alias("kind"), "turn", "role", "text")))
    out = (stream.repartition("conv").sortWithinPartitions("conv", "pos", "kind")
           .select("conv", "kind", "turn", "role", "text")
           .mapInArrow(_report, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                "cost long, audit string, repaired_sha256 string"))
    out = store(out.select(F.when(F.col("conv") != "-", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id"),
                           *[n for n, _ in RESULT[1:]]), "op11-result")
    drop_stored(placed, pieces)
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """The report of ``repaired`` on the conversations after the stated damage."""
    return repaired(damaged(conversations), conversations.select("conv_id"))


def oracle() -> str:
    def more(x: str, cost, letters: str, line: str | None) -> str:
        out = f"{x}.o" if line is None else f"{x}.o || chr(10) || {line}"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letters}', 'o': {out}}}"

    def step(sources: list[str], cost: str, letters: str, line: str) -> str:
        return ", ".join(more(x, cost, letters, line) for x in sources)

    far = "{'c': 1000000000::BIGINT, 'a': '', 'o': ''}"
    bad = "CASE WHEN deleted THEN 1000000000::BIGINT ELSE extra END"
    user = ["b0", "b1", "b3", more("b2", INSERT, "I", "'assistant:'")]
    bot = ["b2", *[more(x, INSERT, "I", "'user:'") for x in ("b0", "b1", "b3")]]
    own = "role || ':' || text"

    def kept(initial: str, sources: list[str]) -> str:
        return step(sources, f"{bad} + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000::BIGINT END", "K", own)

    n0 = more("b0", DELETE, "D", None)
    n1 = f"list_min([{more('b1', DELETE, 'D', None)}, {kept('s', ['b0'])}])"
    n2 = f"list_min([{more('b2', DELETE, 'D', None)}, {kept('u', user)}, " \
         f"{step(user, f'{REROLE} + {bad}', 'R', chr(39) + 'user:' + chr(39) + ' || text')}])"
    n3 = f"list_min([{more('b3', DELETE, 'D', None)}, {kept('a', bot)}, " \
         f"{step(bot, f'{REROLE} + {bad}', 'R', chr(39) + 'assistant:' + chr(39) + ' || text')}])"
    end = f"list_min([b0, b3, {more('b2', INSERT, 'I', chr(39) + 'assistant:' + chr(39))}, " \
          f"{more('b1', 2 * INSERT, 'II', chr(39) + 'user:' + chr(39) + ' || chr(10) || ' + chr(39) + 'assistant:' + chr(39))}])"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS fault
  FROM conversations),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE fault != 0),
placed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                            sha256(octet_length(encode(role))::VARCHAR || ':' || role || text)) AS i,
         substr(role, 1, 1) AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS tail
  FROM rows_after),
judged AS (
  SELECT *, tail = '' AS blank,
         tail != '' AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS dup FROM placed),
marked AS (
  SELECT *, blank OR dup AS deleted, NOT blank AND NOT dup AND tail NOT IN ('.', '!', '?') AS cut,
         CASE WHEN NOT blank AND NOT dup AND tail NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY g ORDER BY i) AS earlier FROM judged),
counts AS (
  SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY g),
way AS (
  SELECT g, 0::BIGINT AS i, n, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS b0, {far} AS b1, {far} AS b2, {far} AS b3 FROM counts
  UNION ALL
  SELECT w.g, m.i, n, {n0}, {n1}, {n2}, {n3}
  FROM way w JOIN marked m ON w.g = m.g AND m.i = w.i + 1),
done AS (SELECT g, {end} AS best FROM way WHERE i = n),
found AS (SELECT c.*, best FROM counts c JOIN done d ON c.g = d.g)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN found f ON a.conv_id IS NOT DISTINCT FROM f.conv_id
"""
