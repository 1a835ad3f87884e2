"""Chat formatting: role repair of least cost over a legal-turn automaton, then rendering."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import whole_runs
from .common import Scratch, frugal, md5_long, offsets_before

ROLES = ("system", "user", "assistant")
#: State 0 is the start, state k the role ROLES[k - 1] of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns, or pieces of the level below, that are composed into one piece; pieces whose rows are numbered together.
FAN, RUN = 256, 16

# Names under which roles are found.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Automaton:
    """Legal neighbours and what repairs cost. A system turn may open; user and assistant alternate; an assistant ends."""

    merge: float = 1.0
    relabel: float = 2.5
    insert: float = 1.5
    next: dict = field(default_factory=lambda: {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)})
    ends: tuple = (ASSISTANT,)

    def path(self, state: int, role: int | None) -> list[int] | None:
        """The fewest empty turns that lead from a state to a turn of a role, or to an end; None if none do."""
        frontier = [(state, [])]
        seen = set()
        while frontier:
            at, empty = frontier.pop(0)
            if role in self.next[at] if role is not None else at in self.ends:
                return empty
            if at not in seen:
                seen.add(at)
                frontier += [(k, [*empty, k]) for k in self.next[at]]
        return None

    def step(self, state: int, role: int) -> tuple[float, str, list[int]]:
        """Cost, action and empty turns of a turn of a role after a state: in order, merge or insert, whichever is cheaper."""
        path = self.path(state, role)
        go = (np.inf, "", []) if path is None else (self.insert * len(path), "insert" if path else "keep", path)
        return (self.merge, "merge", []) if state == role and self.merge < go[0] else go

    def matrices(self) -> np.ndarray:
        """[role found (0: none of the three), state before, state after]: least cost of a turn."""
        out = np.full((4, 4, 4), np.inf)
        for found in range(4):
            for before in range(4):
                for after in (SYSTEM, USER, ASSISTANT):
                    out[found, before, after] = self.step(before, after)[0] + (self.relabel if found != after else 0)
        return out

    def end_costs(self) -> np.ndarray:
        paths = [self.path(s, None) for s in range(4)]
        return np.array([np.inf if p is None else self.insert * len(p) for p in paths])


def _product(steps: np.ndarray) -> np.ndarray:
    """The min-plus product of steps [k, before, after]."""
    out = steps[0]
    for m in steps[1:]:
        out = (out[:, :, None] + m[None, :, :]).min(axis=1)
    return out


def _route(steps: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """States on the cheapest way through the steps, from `enter` to `leave`; the first state of equals."""
    cost = np.full(4, np.inf)
    cost[enter] = 0
    back = np.zeros((len(steps), 4), np.int64)
    for k, m in enumerate(steps):
        total = cost[:, None] + m
        back[k] = total.argmin(axis=0)
        cost = total.min(axis=0)
    states = np.empty(len(steps) + 1, np.int64)
    states[-1] = leave
    for k in range(len(steps) - 1, -1, -1):
        states[k] = back[k, states[k + 1]]
    return states


_GROUP = ["conv", "parent"]
#: Where turns without a number stand: behind all others.
LAST = 1 << 62


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, *order)


def _parent(c: str) -> Column:
    return F.expr(f"{c} div {FAN} - int({c} < 0 and {c} % {FAN} <> 0)").cast("long")


def repair(turns: DataFrame, automaton: Automaton = Automaton(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, new_role, action, inserted, before, after, cost, is_first, is_last), a row per row.

    The cheapest sequence of roles for a conversation is a shortest path over four states. A turn is a
    4 x 4 matrix of costs under (min, +); products of up to FAN neighbours are formed level by level, so a
    conversation of any length is never in one task. At the top the best final state is chosen, and on
    the way down each piece learns the states it is entered and left with. A turn number that more than FAN rows of a
    conversation share is first brought to one matrix by levels of its own, over buckets of its rows. Rows are written
    once with a number each; only role codes go up, and texts move once, at the bottom.

    action: keep, merge (joined to the turn before), insert (empty turns of the roles in `before` come
    first); relabel is told by new_role <> role. inserted counts empty turns before the turn and, at the
    last turn, after it. Roles are trimmed and lower-cased, with usual aliases; null or unknown ones have
    to be relabelled. Rows are ordered by turn (nulls last), then by the role found (none, system, user, assistant), the
    role as written and a hash of the text, however many share a turn; repeated rows stay. Rows without a conversation id form one conversation. Null texts render as empty.
    Other columns are not read.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    costs, ends = automaton.matrices(), automaton.end_costs()
    name = F.lower(F.trim(F.col(role_col).cast("string")))
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[name], name)
    code = sum((F.when(name == r, k + 1).otherwise(0) for k, r in enumerate(ROLES)), F.lit(0))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
        F.concat_ws(":", F.when(F.col(conv_col).isNull(), "0").otherwise("1"), F.col(conv_col).cast("string")).alias("conv"),
        F.coalesce(code, F.lit(0)).cast("int").alias("code"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = scratch.save(rows)
    narrow = rows.select("conv", F.coalesce("turn", F.lit(LAST)).alias("at"), "code", "role", md5_long("text").alias("h"), "rid", F.lit(None).cast("array<double>").alias("m"))
    narrow = narrow.withColumn("parent", _parent("at"))
    memory: dict = {}

    def remembered(f, key, *args):
        """f(*args), looked up for short sequences of roles, which come again and again."""
        if key is None or len(key) > 256:
            return f(*args)
        if key not in memory:
            if len(memory) > 100_000:
                memory.clear()
            memory[key] = f(*args)
        return memory[key]

    def steps_of(frame):
        """Steps a..b of a frame: by role codes where no piece among them is composed already."""
        codes = frame["code"].to_numpy() if "code" in frame else np.full(len(frame), -1)
        steps = costs[np.maximum(codes, 0)]
        composed = np.flatnonzero(codes < 0)
        if len(composed):
            steps[composed] = np.array(frame["m"].iloc[composed].tolist()).reshape(-1, 4, 4)
        return lambda a, b: (codes[a:b].astype(np.int8).tobytes() if (codes[a:b] >= 0).all() else None, steps[a:b])

    def compose(batches):
        memory.clear()
        for frame, bounds in whole_runs(batches, _GROUP):
            steps, first, m = steps_of(frame), bounds[:-1], []
            for a, b in zip(bounds, bounds[1:]):
                key, s = steps(a, b)
                m.append(remembered(lambda s: _product(s).ravel().tolist(), key, s))
            yield pd.DataFrame({"conv": frame["conv"].to_numpy()[first], "at": frame["parent"].to_numpy()[first], "m": m})

    def climb(bottom: DataFrame, *order: str) -> list[DataFrame]:
        """Levels of pieces over the bottom one, up to one piece for each conversation."""
        levels = [scratch.save(_sorted(bottom, *order).mapInPandas(frugal(compose), "conv string, at long, m array<double>"))]
        while levels[-1].groupBy("conv").count().where("count > 1").limit(1).count():
            # indices shrink FAN-fold a level; after eight levels only -1 and 0 are left
            levels[-1] = levels[-1].withColumn("parent", _parent("at") if len(levels) < 8 else F.lit(0).cast("long"))
            levels.append(scratch.save(_sorted(levels[-1], "at").mapInPandas(frugal(compose), "conv string, at long, m array<double>")))
        return levels

    def through(batches):
        """Frames of whole pieces with the states between which each of their steps leads."""
        memory.clear()
        for frame, bounds in whole_runs(batches, _GROUP):
            steps, (enter, leave, f, z) = steps_of(frame), (frame[c].to_numpy() for c in ("enter", "leave", "first", "last"))
            before, after = np.empty(len(frame), np.int32), np.empty(len(frame), np.int32)
            first, last = np.zeros(len(frame), bool), np.zeros(len(frame), bool)
            for a, b in zip(bounds, bounds[1:]):
                key, s = steps(a, b)
                key = None if key is None else key + bytes([enter[a], leave[a]])
                states = remembered(_route, key, s, int(enter[a]), int(leave[a]))
                before[a:b], after[a:b] = states[:-1], states[1:]
                first[a], last[b - 1] = f[a], z[a]
            yield frame.assign(enter=before, leave=after, first=first, last=last)

    states = "enter int, leave int, cost double, first boolean, last boolean"

    def down(batches):
        for frame in through(batches):
            yield frame[["conv", "at", "enter", "leave", "cost", "first", "last"]]

    def label(batches):
        for frame in through(batches):
            yield frame[["rid", "conv", "at", "enter", "leave", "cost", "first", "last"]]

    def descend(levels: list[DataFrame], known: DataFrame, bottom: DataFrame, *order: str) -> DataFrame:
        """(rid, conv, at, states) for each row of the bottom level."""
        for level in reversed(levels[:-1]):
            known = scratch.save(_sorted(level.join(known, _GROUP), "at").mapInPandas(frugal(down), f"conv string, at long, {states}").withColumnRenamed("at", "parent"))
        return scratch.save(_sorted(bottom.join(known, _GROUP), *order).mapInPandas(frugal(label), f"rid long, conv string, at long, {states}"))

    by_row, by_place = ("at", "code", "role", "h", "rid"), ("code", "role", "h", "rid")
    # turn numbers that many rows share: only in pieces that are far too long
    heavy = scratch.save(narrow.groupBy(*_GROUP).count().where(F.col("count") > 4 * FAN).drop("count"))
    shared = None
    if heavy.limit(1).count():
        parts = F.expr(f"(count(1) + {FAN - 1}) div {FAN}").cast("long").alias("parts")
        shared = scratch.save(narrow.join(heavy, _GROUP).groupBy("conv", "at").agg(F.count(F.lit(1)).alias("n"), parts).where(F.col("n") > FAN).drop("n"))
        apart = narrow.join(shared, ["conv", "at"])
        # rows of such a turn: numbered in their order over runs of bounded length, FAN of them a bucket, as a conversation
        # of their own. Rows equal in all that the order knows count as a range, dealt out by themselves.
        apart = apart.withColumn("_role", F.concat(F.when(F.col("role").isNull(), "0").otherwise("1"), F.coalesce("role", F.lit(""))))
        same = ["conv", "at", "code", "_role", "h"]
        ranges = apart.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.first("parts").alias("parts"))
        ranges = ranges.withColumn("run", F.struct("code", "_role", F.expr(f"h div ({1 << 60} div ((parts + {RUN - 1}) div {RUN}))").alias("h")))
        ranges = scratch.save(offsets_before(ranges, ["conv", "at"], "run", ["code", "_role", "h"], "copies", "start").select(*same, "copies", "start"))
        apart = apart.join(ranges, same).withColumn("run", F.pmod(F.xxhash64("rid"), F.expr(f"(copies + {RUN * FAN - 1}) div {RUN * FAN}"))).withColumn("one", F.lit(1))
        apart = offsets_before(apart, same, "run", ["rid"], "one", "k")
        inner = apart.select(F.concat("conv", F.lit("#"), F.col("at").cast("string")).alias("conv"), "rid", "code", "role", "h", "m", F.expr(f"(start + k) div {FAN}").alias("parent"))
        inner = scratch.save(inner)
        inner_levels = climb(inner, *by_place)
        pieces = inner_levels[-1].withColumn("i", F.length("conv") - F.length(F.substring_index("conv", "#", -1)))
        pieces = pieces.select(F.substring("conv", F.lit(1), F.col("i") - 1).alias("conv"), F.substring_index("conv", "#", -1).cast("long").alias("at"), F.lit(-1).alias("code"), F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("h"), F.lit(-1).cast("long").alias("rid"), "m")
        narrow = narrow.join(shared, ["conv", "at"], "left_anti").unionByName(pieces.withColumn("parent", _parent("at")))
    levels = climb(narrow, *by_row)

    def best(m):
        total = np.array(m)[:4] + ends
        return int(total.argmin()), float(total.min())

    @F.pandas_udf("leave int, cost double")
    def finish(m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(x) for x in m], columns=["leave", "cost"])

    known = levels[-1].withColumn("f", finish("m")).select("conv", F.col("at").alias("parent"), F.lit(START).alias("enter"), "f.leave", "f.cost", F.lit(True).alias("first"), F.lit(True).alias("last"))
    found = descend(levels, known, narrow, *by_row)
    if shared is not None:
        top = inner_levels[-1].select("conv", F.col("at").alias("parent"))
        turn = found.where("rid < 0").select(F.concat("conv", F.lit("#"), F.col("at").cast("string")).alias("conv"), "enter", "leave", "cost", "first", "last")
        found = found.where("rid >= 0").unionByName(descend(inner_levels, top.join(turn, "conv"), inner.withColumn("at", F.col("parent")), *by_place))

    # what a step means: looked up by the states it leads between
    steps = [automaton.step(a, b) if b else (0.0, "", []) for a in range(4) for b in range(4)]
    tails = [automaton.path(b, None) or [] for b in range(4)]
    names = lambda path: F.array(*[F.lit(ROLES[k - 1]) for k in path]).cast("array<string>")
    step = F.col("enter") * 4 + F.col("leave")
    before = F.get(F.array(*[names(path) for _, _, path in steps]), step)
    after = F.when(F.col("last"), F.get(F.array(*[names(path) for path in tails]), F.col("leave"))).otherwise(names([]))
    return rows.join(found.drop("conv", "at"), "rid").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("leave") - 1).alias("new_role"),
        F.get(F.array(*[F.lit(action) for _, action, _ in steps]), step).alias("action"),
        (F.size(before) + F.size(after)).cast("long").alias("inserted"),
        before.alias("before"),
        after.alias("after"),
        "cost",
        F.col("first").alias("is_first"),
        F.col("last").alias("is_last"),
    )


def render(repaired: DataFrame, opening: str = "<|{}|>\n", closing: str = "<|end|>\n", joint: str = "\n") -> DataFrame:
    """Adds rendered: the turn's piece of its conversation. Pieces in order of turn make up the conversation.

    A piece closes the turn before it, unless it is merged into that; then come empty turns, its own
    opening and text; the last one also closes and adds the empty turns that follow.
    """
    head, tail = opening.split("{}")
    start = lambda r: F.concat(F.lit(head), r, F.lit(tail))
    empties = lambda c: F.array_join(F.transform(c, lambda r: F.concat(start(r), F.lit(closing))), "")
    close = F.when(~F.col("is_first"), F.lit(closing)).otherwise("")
    body = F.when(F.col("action") == "merge", F.lit(joint)).otherwise(F.concat(close, empties("before"), start(F.col("new_role"))))
    end = F.when(F.col("is_last"), F.concat(F.lit(closing), empties("after"))).otherwise("")
    return repaired.withColumn("rendered", F.concat(body, F.coalesce("text", F.lit("")), end))


def format_chats(turns: DataFrame, automaton: Automaton = Automaton(), **cols: str) -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted, cost, is_first, is_last, rendered), a row per row."""
    return render(repair(turns, automaton, **cols)).select("conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "is_first", "is_last", "rendered")


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_merged, n_relabelled, n_inserted, cost): what the repair did to each conversation."""
    return formatted.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("action") == "merge").alias("n_merged"),
        F.count_if(~F.lower(F.trim("role")).eqNullSafe(F.col("new_role"))).alias("n_relabelled"),
        F.sum("inserted").alias("n_inserted"),
        F.first("cost").alias("cost"),
    )


def format_oracle(automaton: Automaton = Automaton()) -> str:
    """The same in DuckDB's SQL: costs of the four states turn by turn, then back along the cheapest way."""
    number = lambda x: "'inf'::DOUBLE" if np.isinf(x) else f"{float(x)}::DOUBLE"
    array = lambda xs: "[" + ", ".join(xs) + "]"
    m = automaton.matrices()
    costs = array(array(array(number(m[f, a, b]) for a in range(4)) for b in range(4)) for f in range(4))
    steps = [automaton.step(a, b) if b else (0.0, "", []) for a in range(4) for b in range(4)]
    empty = lambda path: "'" + "".join(f"<|{ROLES[k - 1]}|>\n<|end|>\n" for k in path) + "'"
    tails = [automaton.path(b, None) or [] for b in range(4)]
    name = "lower(trim(role))"
    name = "CASE " + " ".join(f"WHEN {name} = '{a}' THEN '{r}'" for a, r in ALIASES.items()) + f" ELSE {name} END"
    return f"""
    WITH RECURSIVE q AS (SELECT {costs} AS costs, {array(number(x) for x in automaton.end_costs())} AS ends, {array("'" + x[1] + "'" for x in steps)} AS actions, {array(str(len(x[2])) for x in steps)} AS n_before,
      {array(empty(x[2]) for x in steps)} AS before, {array(empty(x) for x in tails)} AS after, {array(str(len(x)) for x in tails)} AS n_after, {array("'" + r + "'" for r in ROLES)} AS roles),
    t0 AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN '0' ELSE '1:' || conv_id END AS k, CASE {name} WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS code FROM conversations),
    t AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS n FROM t0 WINDOW w AS (PARTITION BY k ORDER BY turn NULLS LAST, code, role NULLS FIRST, substr(md5(coalesce(text, '')), 1, 15))),
    fwd AS (SELECT DISTINCT k, 0::BIGINT AS rn, [0::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE] AS c, []::BIGINT[] AS back FROM t
      UNION ALL SELECT k, rn, list_transform(tot, lambda x: list_min(x)), list_transform(tot, lambda x: list_position(x, list_min(x)) - 1) FROM (
        SELECT t.k, t.rn, list_transform(costs[code + 1], lambda col: list_transform([1, 2, 3, 4], lambda i: c[i] + col[i])) AS tot FROM fwd JOIN t ON t.k = fwd.k AND t.rn = fwd.rn + 1, q)),
    fin AS (SELECT k, list_transform([1, 2, 3, 4], lambda i: c[i] + ends[i]) AS tot FROM fwd JOIN (SELECT DISTINCT k, n FROM t) USING (k), q WHERE rn = n),
    bwd AS (SELECT k, n AS rn, list_position(tot, list_min(tot)) - 1 AS s, list_min(tot) AS cost FROM fin JOIN (SELECT DISTINCT k, n FROM t) USING (k)
      UNION ALL SELECT bwd.k, bwd.rn - 1, back[s + 1], cost FROM bwd JOIN fwd ON fwd.k = bwd.k AND fwd.rn = bwd.rn WHERE bwd.rn > 0),
    way AS (SELECT t.*, a.s AS enter, b.s AS leave, b.cost, t.rn = 1 AS is_first, t.rn = t.n AS is_last FROM t JOIN bwd b ON b.k = t.k AND b.rn = t.rn JOIN bwd a ON a.k = t.k AND a.rn = t.rn - 1)
    SELECT conv_id, turn, role, roles[leave] AS new_role, actions[enter * 4 + leave + 1] AS action, (n_before[enter * 4 + leave + 1] + CASE WHEN is_last THEN n_after[leave + 1] ELSE 0 END)::BIGINT AS inserted, cost, is_first, is_last,
      CASE WHEN actions[enter * 4 + leave + 1] = 'merge' THEN chr(10) ELSE CASE WHEN is_first THEN '' ELSE '<|end|>' || chr(10) END || before[enter * 4 + leave + 1] || '<|' || roles[leave] || '|>' || chr(10) END
      || coalesce(text, '') || CASE WHEN is_last THEN '<|end|>' || chr(10) || after[leave + 1] ELSE '' END AS rendered FROM way, q"""
