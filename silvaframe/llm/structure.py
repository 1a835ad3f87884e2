"""Conversation structure repair: a time-major dynamic programme over role automaton states, many conversations at once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import whole_runs
from .common import Scratch, frugal

#: Rows of a piece of a conversation; pieces, or pieces of the level below, that are composed into one.
PIECE, FAN = 256, 256
#: More than any cost.
FAR = 1 << 60

# States: nothing yet, a system turn, a user turn, an assistant turn last. Legal ends are the first and the last one.
STATES = 4
#: The state that a turn of a role (0 none of the three, 1 system, 2 user, 3 assistant) leads to; -1 is illegal.
TURN = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
#: The state that the one legal user or assistant turn leads to.
FREE = np.array([2, 2, 3, 2])
#: Faults in order of precedence.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Costs:
    """What an edit costs; undeleted truncated turns add `truncated`."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def end(self) -> np.ndarray:
        """Least cost from each state to a legal end."""
        return np.array([0, 2 * self.insert, self.insert, 0])


def _closed(cost: np.ndarray, insert: int) -> np.ndarray:
    """Costs [state, ...] with empty turns inserted first; more than two never help."""
    once = np.minimum(cost, insert + cost[FREE])
    return np.minimum(cost, insert + once[FREE])


class Bucket:
    """Pieces of one padded length, time-major: tensors [turn, piece], to which costs add [state, ...] axes.

    A step is a row with its equal copies: the first is kept, reroled or deleted, the other ones are deleted.
    """

    def __init__(self, fault: np.ndarray, role: np.ndarray, copies: np.ndarray, costs: Costs):
        self.costs, self.role, self.copies = costs, role, copies
        self.fixed = (fault == BLANK) | (fault == DUPLICATE) | (copies == 0)  # padding is a row of no copies
        self.stay = np.where(fault == TRUNCATED, costs.truncated, 0)
        self.rest = costs.delete * np.maximum(copies - 1, 0)

    def options(self, t: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of delete, keep and rerole at turn t from each state, given the costs behind it."""
        extra = (STATES, *[1] * (after.ndim - 2), -1)
        delete = np.where(self.copies[t] > 0, self.costs.delete, 0) + self.rest[t] + after
        to = TURN[self.role[t]].T  # [state, piece]
        kept = np.take_along_axis(after, np.maximum(to, 0).reshape(extra), axis=0) if after.ndim == 2 else np.stack([np.where(to[q] == -1, FAR, after[np.maximum(to[q], 0), :, np.arange(to.shape[1])].T) for q in range(STATES)])
        kept = np.where((self.fixed[t] | (to == -1)).reshape(extra), FAR, kept + self.stay[t] + self.rest[t])
        free = np.where(self.fixed[t], FAR, after[FREE] + self.costs.rerole + self.stay[t] + self.rest[t])
        return delete, kept, free

    def backward(self, end: np.ndarray) -> np.ndarray:
        """Least costs [turn, state, ..., piece] from before each turn to the end, whose costs are given."""
        out = np.empty((len(self.role) + 1, *end.shape), np.int64)
        out[-1] = end
        for t in range(len(self.role) - 1, -1, -1):
            out[t] = np.minimum(_closed(np.minimum.reduce(self.options(t, out[t + 1])), self.costs.insert), FAR)
        return out

    def trace(self, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inserted, edit, state before, state after) [turn, piece]: of the cheapest edits the first in the order D, I, K, R."""
        shape = self.role.shape
        inserted, edit, before, behind = (np.zeros(shape, np.int64) for _ in range(4))
        piece = np.arange(shape[1])
        for t in range(shape[0]):
            delete, kept, _ = self.options(t, cost[t + 1])
            before[t] = state
            for _ in range(3):
                want = cost[t][state, piece]
                drop = delete[state, piece] == want
                more = ~drop & (self.costs.insert + cost[t][FREE[state], piece] == want)
                inserted[t] += more
                state = np.where(more, FREE[state], state)
            keep = ~drop & (kept[state, piece] == want)
            edit[t] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
            state = np.where(drop, state, np.where(keep, TURN[self.role[t], state], FREE[state]))
            behind[t] = state
        return inserted, edit, before, behind


def _buckets(bounds: np.ndarray):
    """Places [turn, piece] of rows, by padded length; -1 is padding. With them the numbers of the pieces."""
    size = np.diff(bounds)
    padded = 1 << np.maximum(0, np.ceil(np.log2(size)).astype(int))
    for n in np.unique(padded):
        some = np.flatnonzero(padded == n)
        at = np.arange(n)[:, None] + bounds[some][None, :]
        yield some, np.where(np.arange(n)[:, None] < size[some][None, :], at, -1)


def _bucket(frame: pd.DataFrame, at: np.ndarray, costs: Costs) -> Bucket:
    fault, role, copies = (frame[c].to_numpy()[at] for c in ("fault", "code", "copies"))
    return Bucket(np.where(at < 0, NONE, fault), role, np.where(at < 0, 0, copies), costs)


_PIECE = ["ck", "at"]


def _matrices(costs: Costs):
    """Costs from each state before a piece to each state behind it, and the roles that it begins and ends with."""

    def run(batches):
        for frame, bounds in whole_runs(batches, _PIECE):
            m = np.empty((len(bounds) - 1, STATES * STATES), np.int64)
            for some, at in _buckets(bounds):
                end = np.broadcast_to(np.where(np.eye(STATES, dtype=bool), 0, FAR)[:, :, None], (STATES, STATES, len(some)))
                m[some] = _bucket(frame, at, costs).backward(end)[0].reshape(-1, len(some)).T
            first, code = frame.iloc[bounds[:-1]], frame["code"].to_numpy()
            yield pd.DataFrame({"ck": first["ck"].to_numpy(), "at": first["at"].to_numpy(), "m": list(m), "opens": code[bounds[:-1]], "closes": code[bounds[1:] - 1]})

    return run


def _exits(costs: Costs):
    """The state behind each piece for each state before it, given the costs from behind it to the end."""

    def run(batches):
        for frame, bounds in whole_runs(batches, _PIECE):
            out = np.empty((len(bounds) - 1, STATES), np.int64)
            for some, at in _buckets(bounds):
                b = _bucket(frame, at, costs)
                cost = b.backward(np.array(frame["v"].iloc[bounds[some]].tolist()).T)
                for q in range(STATES):
                    out[some, q] = b.trace(cost, np.full(len(some), q))[3][-1]
            first = frame.iloc[bounds[:-1]]
            yield pd.DataFrame({"ck": first["ck"].to_numpy(), "at": first["at"].to_numpy(), "m": list(out)})

    return run


def _edits(costs: Costs):
    """A row's edits, what they cost, and whether its role may not follow the one before it."""
    end = costs.end()

    def run(batches):
        for frame, bounds in whole_runs(batches, _PIECE):
            cols = {c: np.zeros(len(frame), np.int64) for c in ("inserted", "edit", "before", "behind")}
            v = np.array([end if x is None else x for x in frame["v"].iloc[bounds[:-1]]])
            enter = frame["enter"].to_numpy()[bounds[:-1]]
            for some, at in _buckets(bounds):
                b = _bucket(frame, at, costs)
                found = b.trace(b.backward(v[some].T), enter[some])
                for c, x in zip(cols.values(), found):
                    c[at[at >= 0]] = x[at >= 0]
            code, copies, fault = (frame[c].to_numpy() for c in ("code", "copies", "fault"))
            last = np.zeros(len(frame), bool)
            last[bounds[1:] - 1] = frame["last"].to_numpy()[bounds[1:] - 1]
            tail = np.where(last, np.array([0, 2, 1, 0])[cols["behind"]], 0)
            deleted = cols["edit"] == ord("D")
            cost = costs.insert * (cols["inserted"] + tail) + costs.delete * (copies - 1 + deleted) + costs.rerole * (cols["edit"] == ord("R")) + np.where(~deleted & (fault == TRUNCATED), costs.truncated, 0)
            prior = np.concatenate([[0], code[:-1]])
            legal = (prior * 4 + code == 6) | (prior * 4 + code == 11) | (prior * 4 + code == 14)
            legal[bounds[:-1]] = True  # what lies between pieces is looked at apart
            letters = cols.pop("edit").astype(np.uint8).view("S1").astype("U1")
            yield frame[["rid", "ck", "at", "pos", "copies"]].assign(edit=letters, **cols, tail=tail, cost=cost, illegal=copies - 1 + ~legal)

    return run


def _compose(frame: pd.DataFrame) -> pd.DataFrame:
    """Matrices under (min, +), or maps of states, of consecutive pieces as one."""
    m = [np.array(x) for x in frame.sort_values("at")["m"]]
    out = m[0]
    for x in m[1:]:
        out = np.minimum((out.reshape(STATES, STATES, 1) + x.reshape(1, STATES, STATES)).min(axis=1), FAR).ravel() if len(x) > STATES else x[out]
    return pd.DataFrame({"ck": frame["ck"].iloc[:1], "at": frame["parent"].iloc[:1], "m": [out]})


def _spread_costs(frame: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each of consecutive pieces from those behind the last one."""
    frame = frame.sort_values("at")
    m, v = [np.array(x).reshape(STATES, STATES) for x in frame["m"]], [np.array(frame["v"].iloc[0])]
    for x in m[:0:-1]:
        v.append(np.minimum((x + v[-1][None, :]).min(axis=1), FAR))
    return pd.DataFrame({"ck": frame["ck"], "at": frame["at"], "v": v[::-1]})


def _spread_states(frame: pd.DataFrame) -> pd.DataFrame:
    """The state before each of consecutive pieces from the one before the first."""
    frame, state, out = frame.sort_values("at"), int(frame["v"].iloc[0][0]), []
    for m in frame["m"]:
        out.append([state])
        state = int(m[state])
    return pd.DataFrame({"ck": frame["ck"], "at": frame["at"], "v": out})


def _through_levels(pieces: DataFrame, top: list[int], spread, scratch: Scratch) -> DataFrame:
    """(ck, at, v): what `spread` tells each piece, from `top` at the whole conversation, over levels of at most FAN pieces each."""
    kind, levels = "ck string, at long, m array<long>", [pieces.select("ck", "at", "m").withColumn("parent", F.expr(f"at div {FAN}"))]
    while levels[-1].where("at > 0").limit(1).count():
        up = scratch.save(levels[-1].groupBy("ck", "parent").applyInPandas(_compose, kind))
        levels.append(up.withColumn("parent", F.expr(f"at div {FAN}")))
    known = levels[-1].select("ck", F.col("at").alias("parent"), F.array(*[F.lit(int(x)).cast("long") for x in top]).alias("v"))
    for level in levels[-2::-1]:
        known = scratch.save(level.join(known, ["ck", "parent"]).groupBy("ck", "parent").applyInPandas(spread, "ck string, at long, v array<long>")).withColumnRenamed("at", "parent")
    return known.withColumnRenamed("parent", "at")


@dataclass
class Structure:
    """turns: a row per distinct turn (conv_id, turn, role, text, copies, fault, pos, edit, new_role, before, after, cost), in order of
    pos within a conversation; before and after are the roles of empty turns put in around it, edit is that of the first
    of its equal copies, the others are deleted. conversations: a row per conversation with its counts."""

    turns: DataFrame
    conversations: DataFrame


def repair_structure(turns: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Structure:
    """Finds faults of conversations and the cheapest edits after which their roles read (system? (user assistant)+)? or nothing.

    Rows are taken in order of turn (nulls first), then of role and MD5 of the text. The first that applies is a row's
    fault: blank, duplicate (role and text seen earlier), truncated (no `.!?` at its end). Keep costs nothing, reroling to
    user or assistant, deleting (which blank and duplicate rows need) and inserting an empty turn cost what `costs` says. Of edits of one cost those stand whose letters (D, I, K, R) come first.

    Conversations lie side by side in tensors [turn, conversation], bucketed by length: the costs of all states are worked
    out turn by turn from the back and stored, and the edits are traced from the front, both for all of a bucket at once. A
    conversation of more than PIECE rows is cut into pieces, which are matrices of costs between states, composed in levels
    of FAN; on the way back each piece learns the costs behind it, then the state before it. So no conversation lies in one
    task. Equal rows count as one row with copies. Only narrow columns take part: texts move at the end and only of rows that stay.

    Null roles and texts count as one space; a role whose initial is none of s, u, a has to be reroled or deleted. Rows
    without a conversation id form one conversation. Repeated rows are duplicates. An empty table gives empty tables.
    Other columns are not read.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "structure")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    end = F.rtrim(text, F.lit(SPACE))
    initial = F.substring(role, 1, 1)
    rows = scratch.save(
        turns.select(
            F.col(conv_col).alias("conv_id"),
            F.concat_ws(":", F.when(F.col(conv_col).isNull(), "0").otherwise("1"), F.col(conv_col).cast("string")).alias("ck"),
            F.col(turn_col).cast("long").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.md5(text).alias("hash"),
            (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)).cast("int").alias("code"),
            F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED).cast("int").alias("fault"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    # equal rows count as one; of rows of one role and text, the one of the least turn was there first
    equal = rows.groupBy("ck", "turn", "role", "hash").agg(F.min("rid").alias("rid"), F.first("code").alias("code"), F.first("fault").alias("fault"), F.count(F.lit(1)).alias("copies"))
    equal = scratch.save(equal)
    first = equal.groupBy("ck", "role", "hash").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "rid")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = equal.join(first.select("ck", "role", "hash", F.col("m.rid").alias("first")), ["ck", "role", "hash"]).where("rid <> first").select("rid", F.lit(True).alias("again"))
    narrow = equal.join(again, "rid", "left").withColumn("fault", F.when((F.col("fault") != BLANK) & F.coalesce("again", F.lit(False)), DUPLICATE).otherwise(F.col("fault")))
    narrow = narrow.orderBy("ck", F.asc_nulls_first("turn"), "role", "hash").select("ck", "turn", "rid", "code", "fault", "copies", F.monotonically_increasing_id().alias("pos"))
    narrow = scratch.save(narrow)  # positions grow along the order
    piece = F.expr(f"pos div {PIECE}")
    # pieces are numbered from 0 within their conversation: their numbers run on within a partition of the sort
    runs = narrow.groupBy("ck", F.shiftright("pos", 33).alias("part")).agg(F.min(piece).alias("from"), F.max(piece).alias("to"))
    over = Window.partitionBy("ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum(F.col("to") - F.col("from") + 1)
    runs = runs.withColumn("base", F.coalesce(n.over(over), F.lit(0))).withColumn("pieces", n.over(Window.partitionBy("ck")))
    long = scratch.save(runs.where("pieces > 1").select("ck", "part", (F.col("base") - F.col("from")).alias("shift"), "pieces"))
    cut = narrow.withColumn("part", F.shiftright("pos", 33)).join(long, ["ck", "part"], "left")
    cut = cut.select("ck", F.when(F.col("pieces") > 1, piece + F.col("shift")).otherwise(0).cast("long").alias("at"), "pos", "rid", "code", "fault", "copies", F.coalesce("pieces", F.lit(1)).alias("pieces"))
    together = lambda df: df.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "pos")
    step = cut.select("ck", "at", "pos", "rid", "code", "fault", "copies", (F.col("at") == F.col("pieces") - 1).alias("last"))
    breaks = None
    if long.limit(1).count():
        part = together(cut.where("pieces > 1").select("ck", "at", "pos", "code", "fault", "copies"))
        m = scratch.save(part.mapInPandas(frugal(_matrices(costs)), "ck string, at long, m array<long>, opens int, closes int"))
        behind = _through_levels(m, costs.end().tolist(), _spread_costs, scratch)
        known = part.join(behind, _PIECE)
        states = scratch.save(together(known).mapInPandas(frugal(_exits(costs)), "ck string, at long, m array<long>"))
        enter = _through_levels(states, [0], _spread_states, scratch)
        known = behind.join(enter.select("ck", "at", F.get("v", F.lit(0)).cast("int").alias("enter")), _PIECE)
        step = step.join(known, _PIECE, "left").withColumn("enter", F.coalesce("enter", F.lit(0)))
        left, right = m.select("ck", "at", "closes"), m.select("ck", (F.col("at") - 1).alias("at"), "opens")
        pair = F.col("closes") * 4 + F.col("opens")
        breaks = left.join(right, _PIECE).groupBy("ck").agg(F.count_if(~pair.isin(6, 11, 14)).alias("between"))
    else:
        step = step.withColumns({"v": F.lit(None).cast("array<long>"), "enter": F.lit(0)})
    edits = scratch.save(together(step).mapInPandas(frugal(_edits(costs)), "rid long, ck string, at long, pos long, copies long, edit string, inserted int, before int, behind int, tail int, cost long, illegal long"))

    roles = lambda n, state: F.slice(F.when(state == 2, F.array(F.lit("assistant"), F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant"))), 1, n)
    name = F.when(F.col("edit") == "K", F.col("role")).when((F.col("edit") == "R") & (F.col("behind") == 2), "user").when(F.col("edit") == "R", "assistant")
    slim = narrow.select("rid", "turn", "fault")
    detail = edits.join(slim, "rid").join(rows.select("rid", "conv_id", "role", "text"), "rid")
    detail = detail.select("conv_id", "ck", "at", "turn", "role", "text", "copies", F.get(F.array(F.lit(None), F.lit("blank"), F.lit("duplicate"), F.lit("truncated")), "fault").alias("fault"), "pos", "edit", name.alias("new_role"), roles(F.col("inserted"), F.col("before")).alias("before"), roles(F.col("tail"), F.col("behind")).alias("after"), "cost")

    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    is_ = lambda k: F.col("fault") == k
    found = narrow.groupBy("ck").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(F.when(is_(BLANK), F.col("copies"))).alias("blank"),
        count(F.when(is_(DUPLICATE), F.col("copies")).when(~is_(BLANK), F.col("copies") - 1)).alias("duplicate"),
        count(F.when(is_(TRUNCATED), 1)).alias("truncated"),
    )
    sums = edits.groupBy("ck").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    if breaks is not None:
        sums = sums.join(breaks, "ck", "left").select("ck", (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"), "cost")
    ids = rows.groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
    return Structure(detail, ids.join(found, "ck").join(sums, "ck"))


def _streamed(batches):
    """(ck, audit, sha256) of pieces (ck, at, audit, text) sorted by (ck, at): a conversation's text is never held whole."""
    key, sha, audit, any_ = None, None, [], False
    for batch in batches:
        out = []
        for ck, letters, text in zip(*[batch.column(c).to_pylist() for c in ("ck", "audit", "text")]):
            if ck != key:
                if key is not None:
                    out.append((key, "".join(audit), sha.hexdigest()))
                key, sha, audit, any_ = ck, hashlib.sha256(), [], False
            audit.append(letters)
            if text is not None:
                sha.update((b"\n" if any_ else b"") + text.encode())
                any_ = True
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["ck", "audit", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (key, "".join(audit), sha.hexdigest())], ["ck", "audit", "repaired_sha256"])


def rendered(turns: DataFrame) -> DataFrame:
    """(ck, at, audit, text) of each piece: its letters, and its lines `role:text` after the repair, or null if it has none."""
    lines = F.concat(F.transform("before", lambda r: F.concat(r, F.lit(":"))), F.when(F.col("new_role").isNotNull(), F.array(F.concat("new_role", F.lit(":"), "text"))).otherwise(F.array().cast("array<string>")), F.transform("after", lambda r: F.concat(r, F.lit(":"))))
    letters = F.concat(F.repeat(F.lit("I"), F.size("before")), F.col("edit"), F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int")), F.repeat(F.lit("I"), F.size("after")))
    own = turns.select("ck", "at", "pos", letters.alias("letters"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("line"))
    by = own.groupBy("ck", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "letters", "line"))).alias("rows"))  # PIECE rows at most
    some = F.filter("rows", lambda r: r["line"].isNotNull())
    return by.select("ck", "at", F.array_join(F.transform("rows", lambda r: r["letters"]), "").alias("audit"), F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda r: r["line"]), "\n")).alias("text"))


def digest(original: DataFrame, found: Structure, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of the original table."""
    pieces = rendered(found.turns).repartition("ck").sortWithinPartitions("ck", "at")
    text = pieces.mapInArrow(frugal(_streamed), "ck string, audit string, repaired_sha256 string")
    known = found.conversations.join(text, "ck").drop("ck")
    ids = original.select(F.col(conv_col).alias("conv_id")).distinct()
    out = ids.join(known.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that a checksum of conversation and turn deals out to them: 0 drops, 1 empties, 2 takes the
    ends of sentences out, 3 repeats, 4 makes it the user's. Nulls count as one space there, and in role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def structure_oracle(costs: Costs = Costs()) -> str:
    """The same in DuckDB's SQL, row by row: costs of the four states from the back, then one edit at a time from the front."""
    k, r, d, i, t = 0, costs.rerole, costs.delete, costs.insert, costs.truncated
    far = 10**9
    state = "CASE code WHEN 's' THEN [1, NULL, NULL, NULL] WHEN 'u' THEN [2, 2, NULL, 2] WHEN 'a' THEN [NULL, NULL, 3, NULL] ELSE [NULL, NULL, NULL, NULL] END"
    return rf"""
    WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(0, 256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
    crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS kind FROM raw, tab),
    rows_ AS (SELECT coalesce('1:' || conv_id, '0') AS ck, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM crc, (VALUES (1), (2)) copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, md5(text)) AS rn, count(*) OVER (PARTITION BY ck) AS n, left(role, 1) AS code FROM rows_),
    faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY rn) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
    st AS (SELECT *, fault IN ('blank', 'duplicate') AS fixed, CASE fault WHEN 'truncated' THEN {t} ELSE 0 END AS stay, {state} AS to_, lag(code) OVER (PARTITION BY ck ORDER BY rn) AS prior FROM faults),
    bwd AS (SELECT DISTINCT ck, n + 1 AS rn, [0, {2 * i}, {i}, 0] AS c FROM st
      UNION ALL SELECT ck, rn, list_transform([0, 1, 2, 3], lambda q: least(e[q + 1], {i} + least(e[free[q + 1] + 1], {i} + e[free[free[q + 1] + 1] + 1]))) FROM (
        SELECT st.ck, st.rn, [2, 2, 3, 2] AS free, list_transform([0, 1, 2, 3], lambda q: least({d} + c[q + 1], CASE WHEN fixed THEN {far} ELSE least(CASE WHEN to_[q + 1] IS NULL THEN {far} ELSE {k} + stay + c[to_[q + 1] + 1] END, {r} + stay + c[[2, 2, 3, 2][q + 1] + 1]) END)) AS e
        FROM bwd JOIN st ON st.ck = bwd.ck AND st.rn = bwd.rn - 1)),
    fwd AS (SELECT ck, 1::BIGINT AS rn, 0 AS q, '' AS audit, []::VARCHAR[] AS lines FROM st WHERE rn = 1
      UNION ALL SELECT ck, CASE act WHEN 'I' THEN rn ELSE rn + 1 END, CASE act WHEN 'D' THEN q WHEN 'K' THEN to_[q + 1] ELSE free END, audit || act,
        CASE act WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, name || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, name || ':' || text) END FROM (
        SELECT f.*, s.role, s.text, s.to_, [2, 2, 3, 2][q + 1] AS free, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS name,
          CASE WHEN s.rn IS NOT NULL AND {d} + b1.c[q + 1] = b0.c[q + 1] THEN 'D' WHEN {i} + b0.c[[2, 2, 3, 2][q + 1] + 1] = b0.c[q + 1] THEN 'I' WHEN NOT s.fixed AND s.to_[q + 1] IS NOT NULL AND {k} + s.stay + b1.c[s.to_[q + 1] + 1] = b0.c[q + 1] THEN 'K' WHEN s.rn IS NOT NULL THEN 'R' END AS act
        FROM fwd f JOIN bwd b0 ON b0.ck = f.ck AND b0.rn = f.rn LEFT JOIN bwd b1 ON b1.ck = f.ck AND b1.rn = f.rn + 1 LEFT JOIN st s ON s.ck = f.ck AND s.rn = f.rn) WHERE act IS NOT NULL),
    fin AS (SELECT ck, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM fwd GROUP BY ck),
    tot AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (rn > 1 AND prior || code NOT IN ('su', 'ua', 'au')) AS illegal FROM st GROUP BY ck)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      coalesce(b.c[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce('1:' || conv_id, '0') AS ck FROM conversations) o LEFT JOIN tot USING (ck) LEFT JOIN bwd b ON b.ck = o.ck AND b.rn = 1 LEFT JOIN fin ON fin.ck = o.ck"""
