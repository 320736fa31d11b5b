"""Cheapest repair of conversations by iterative-deepening A*.

A conversation's rows are kept, given another role, or deleted, and empty turns are inserted, until
the roles read: nothing, or an optional system turn and then user and assistant in turn.  The search
goes depth first, edits in ASCII order of their initials, under a bound on cost plus what the rest
must cost at least; the bound rises to the least sum that exceeded it.  What a state that failed
turned out to need at least is kept, and it is not entered again with less to spend.  So the first
accepting path is a cheapest one, and of these the least audit.

Rows get their places by ranges over the cluster, and a search sees at most SEGMENT rows.  A longer
conversation is a chain of segments: each is searched once for every role that can stand before
it and after it, the cheapest chain is put together from these costs, and where costs tie from the
order of the audits.  Inserted turns belong to the row that follows, so no audit of a segment begins
another, and the least chain consists of least parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import segmented_ranks

from .common import cut

#: Rows of one search.
SEGMENT = 32
#: What stands before the next turn: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The next state by initial.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that may come next, if it isn't system, and the state after it.
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ENDS = (NOTHING, ASSISTANT)
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
SPACES = r"\x20\x09-\x0D"


@lru_cache(maxsize=100_000)
def search(rows: tuple[tuple[str, int], ...], start: int, ends: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest repair of (initial, fault) rows from one state to one of ``ends``, ties to the least audit; None if there is none.

    Turns can be inserted behind the last row only if it is the conversation's ``last``.
    """
    n = len(rows)
    if not any(end >= USER or end == start or start == NOTHING and any(i == "s" and f in (CLEAN, TRUNCATED) for i, f in rows) for end in ends):
        return None  # nothing leads to the first states but a kept system turn
    least = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        least[k] = least[k + 1] + (0 if rows[k][1] == CLEAN else DELETE)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def deeper(at: int, state: int, left: int) -> int:
        """Below 0 if an accepting path for ``left`` or less goes on from here, which ``path`` then is; else what is needed from here at least.

        What a state that failed needs is kept for later entries, also under later bounds.
        """
        needed = failed.get((at, state), least[at])
        if needed > left:
            return needed
        if at == n and state in ends:
            return -1
        options = []
        if at < n:
            initial, fault = rows[at]
            options.append(("D", DELETE, at + 1, state))
        if at < n or last:
            options.append(("I", INSERT, at, NEXT[state][1]))
        if at < n and fault in (CLEAN, TRUNCATED):
            more = LEFT_TRUNCATED if fault == TRUNCATED else 0
            if initial in STEPS[state]:
                options.append(("K", KEEP + more, at + 1, STEPS[state][initial]))
            options.append(("R", REROLE + more, at + 1, NEXT[state][1]))
        needed = 1 << 60
        for edit, cost, to, then in options:
            path.append(edit)
            rest = deeper(to, then, left - cost)
            if rest < 0:
                return rest
            needed = min(needed, cost + rest)
            path.pop()
        failed[at, state] = needed
        return needed

    bound = least[0]
    while bound < 1 << 60:
        over = deeper(0, start, bound)
        if over < 0:
            return bound, "".join(path)
        bound = over
    return None


def actions(rows: list[tuple[str, int]], start: int, audit: str) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, order, edit, new role) of an audit; inserted turns come before their row, those behind the last row after it."""
    at, order, state = 0, 0, start
    for edit in audit:
        role, then = NEXT[state]
        if edit == "I":
            yield at, order, edit, role
            order, state = order + 1, then
            continue
        if edit == "K":
            yield at, order, edit, None
            state = STEPS[state][rows[at][0]]
        elif edit == "R":
            yield at, order, edit, role
            state = then
        at, order = at + 1, 0


def faults(text: Column, again: Column) -> Column:
    """The first fault of a row: blank, seen before, or cut off before the end of a sentence."""
    return F.when(~F.coalesce(text.rlike(f"[^{SPACES}]"), F.lit(False)), BLANK).when(again, DUPLICATE).when(~text.rlike(rf"[.!?][{SPACES}]*\z"), TRUNCATED).otherwise(CLEAN)


def chains(routes: pd.DataFrame) -> pd.DataFrame:
    """The segments' states before and after on the cheapest chain of one conversation, ties to the least audits."""
    routes = routes.sort_values("segment", ignore_index=True)
    costs = np.array(routes["costs"].tolist(), dtype=np.int64).reshape(-1, 4, 4)
    order = np.array(routes["order"].tolist(), dtype=np.int64).reshape(-1, 4, 4)
    never = np.int64(1) << 60
    costs = np.where(costs < 0, never, costs)
    rest = np.zeros((len(costs) + 1, 4), dtype=np.int64)
    rest[-1] = [0 if state in ENDS else never for state in range(4)]
    for k in range(len(costs) - 1, -1, -1):
        rest[k] = np.minimum(costs[k] + rest[k + 1][None, :], never).min(axis=1)
    state, before, after = NOTHING, [], []
    for k in range(len(costs)):
        best = np.flatnonzero(costs[k, state] + rest[k + 1] == rest[k, state])
        to = int(best[np.argmin(order[k, state, best])])
        before.append(state)
        after.append(to)
        state = to
    return pd.DataFrame({"key": routes["key"], "segment": routes["segment"], "before": before, "after": after})


def key_of(conversation: Column) -> Column:
    """A text that is never null, different for each conversation, the null one too."""
    return F.concat(F.when(conversation.isNull(), "n").otherwise("v"), F.coalesce(conversation.cast("string"), F.lit("")))


def _segments(placed: DataFrame, length: int) -> DataFrame:
    """(key, segment, n_segments, codes, illegal): the rows' initials and faults in order, and the illegal neighbours inside."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    named = placed.select("key", "place", "size", F.substring("role", 1, 1).alias("initial"), "text", digest.alias("digest"))
    first = named.groupBy(F.col("key").alias("k_"), F.col("digest").alias("d_")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = named.join(first, (F.col("key") == F.col("k_")) & (F.col("digest") == F.col("d_")), "left")
    code = F.struct("place", "initial", faults(F.col("text"), F.coalesce(F.col("place") > F.col("first"), F.lit(False))).cast("int").alias("fault"))
    segment = F.floor((F.col("place") - 1) / length).cast("long")
    return seen.groupBy("key", segment.alias("segment")).agg(F.ceil(F.max("size") / length).cast("long").alias("n_segments"), F.array_sort(F.collect_list(code)).alias("codes"))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", length: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """((conversation, gaps, blank, duplicate, truncated, illegal, cost, audit), (conversation, place, order, edit, role, text) of the repaired rows).

    Rows are taken by turn, nulls first, and rows of one turn by role and text.  A null role or text
    is taken as one space; all rows of null conversations are one conversation.  A role counts by its
    first letter; an empty one is no role.  ``edit`` tells kept, rerolled and inserted rows apart.
    Repeated rows are duplicates.  An empty table gives no rows; other columns are left out.
    The driver gets nothing.  A search holds ``length`` rows; the costs of a conversation's segments
    meet in one task, some 500 bytes for each.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text")).withColumn("key", key_of(F.col("conv")))
    placed = cut(segmented_ranks(rows, "key", F.asc_nulls_first("turn"), "role", "text", place="place", size="size"))
    segments = cut(_segments(placed, length))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The searches: a lone segment from nothing to an end, others between all states."""
        for batch in batches:
            costs, orders, audits, counts = [], [], [], []
            for segment, n_segments, codes in zip(*(c.to_pylist() for c in batch.columns[1:])):
                own = tuple((c["initial"], c["fault"]) for c in codes)
                if n_segments == 1:
                    cost, audit = search(own, NOTHING, ENDS, True)
                    table, order, texts = [cost], [0], [audit]
                else:
                    found = [search(own, a, (b,), segment == n_segments - 1) if a == NOTHING or segment else None for a in range(4) for b in range(4)]
                    table = [-1 if f is None else f[0] for f in found]
                    texts = [None if f is None else f[1] for f in found]
                    order = [0] * 16
                    for a in range(0, 16, 4):
                        for rank, b in enumerate(sorted((b for b in range(a, a + 4) if texts[b] is not None), key=lambda b: texts[b])):
                            order[b] = rank
                costs.append(table)
                orders.append(order)
                audits.append(texts)
                pairs = [a[0] + b[0] for a, b in zip(own, own[1:])]
                counts.append({"blank": sum(f == BLANK for _, f in own), "duplicate": sum(f == DUPLICATE for _, f in own), "truncated": sum(f == TRUNCATED for _, f in own), "illegal": sum(p not in LEGAL for p in pairs), "first": own[0][0], "last": own[-1][0]})
            ints, strings = pa.list_(pa.int64()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(costs, ints), pa.array(orders, ints), pa.array(audits, strings), pa.array(counts, COUNTS)], names=["key", "segment", "n_segments", "costs", "order", "audits", "counts"])

    COUNTS = pa.struct([(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal")] + [("first", pa.string()), ("last", pa.string())])
    counted = "struct<blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string>"
    routes = cut(segments.mapInArrow(routed, f"key string, segment long, n_segments long, costs array<long>, order array<long>, audits array<string>, counts {counted}"))
    alone = routes.where("n_segments = 1").select("key", "segment", F.lit(NOTHING).alias("before"), F.element_at("audits", 1).alias("audit"), F.element_at("costs", 1).alias("cost"))
    chained = routes.where("n_segments > 1").select("key", "segment", "costs", "order").groupBy("key").applyInPandas(chains, "key string, segment long, before int, after int")
    at = (F.col("before") * 4 + F.col("after") + 1).cast("int")
    joined = routes.select(F.col("key").alias("k_"), F.col("segment").alias("s_"), "costs", "audits").join(chained, (F.col("key") == F.col("k_")) & (F.col("segment") == F.col("s_")))
    chosen = cut(alone.unionByName(joined.select("key", "segment", "before", F.element_at("audits", at).alias("audit"), F.element_at("costs", at).alias("cost"))))

    between = Window.partitionBy("key").orderBy("segment")  # a row for each segment
    seam = F.concat(F.lag("counts.last").over(between), F.col("counts.first"))
    seams = routes.where("n_segments > 1").select("key", "counts", "segment", seam.alias("seam")).where("seam is not null").groupBy("key").agg(F.sum((~F.col("seam").isin(*LEGAL)).cast("long")).alias("seams"))
    sums = routes.groupBy("key").agg(*[F.sum(f"counts.{name}").alias(name) for name in ("blank", "duplicate", "truncated", "illegal")])
    audits = chosen.groupBy("key").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    turns = placed.groupBy("key").agg(F.first("conv").alias("conv"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("kinds"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("kinds"), F.lit(0)).cast("long")
    summary = turns.join(sums, "key").join(audits, "key").join(seams, "key", "left")
    summary = summary.select(F.col("conv").alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seams", F.lit(0))).alias("illegal"), "cost", "audit")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for segment, codes, before, audit in zip(*(c.to_pylist() for c in batch.columns[1:])):
                own = [(c["initial"], c["fault"]) for c in codes]
                out.append([{"place": segment * length + at + 1, "order": order, "edit": edit, "new_role": role} for at, order, edit, role in actions(own, before, audit)])
            edits = pa.list_(pa.struct([("place", pa.int64()), ("order", pa.int32()), ("edit", pa.string()), ("new_role", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, edits)], names=["key", "edits"])

    held = segments.select(F.col("key").alias("k_"), F.col("segment").alias("s_"), "codes").join(chosen, (F.col("k_") == F.col("key")) & (F.col("s_") == F.col("segment")))
    edits = held.select("key", "segment", "codes", "before", "audit").mapInArrow(edited, "key string, edits array<struct<place:long,order:int,edit:string,new_role:string>>")
    edits = edits.select(F.col("key").alias("k_"), F.explode("edits").alias("e")).select("k_", F.col("e.place").alias("p_"), "e.order", "e.edit", "e.new_role")
    given = placed.select("key", "place", F.col("role").alias("old_role"), F.col("text").alias("old_text"))
    met = edits.join(given, (F.col("k_") == F.col("key")) & (F.col("p_") == F.col("place")), "left")
    own = F.col("edit") != "I"
    repaired = met.select(F.col("k_").alias("key"), F.col("p_").alias("place"), "order", "edit", F.coalesce("new_role", "old_role").alias("role"), F.when(own, F.col("old_text")).otherwise("").alias("text"))
    names = turns.select(F.col("key").alias("k_"), F.col("conv").alias(conv_col))
    return summary, repaired.join(names, F.col("key") == F.col("k_")).select(conv_col, "place", "order", "edit", "role", "text")


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, repaired_sha256) of the repaired rows as ``role:text``, joined by newlines in order.

    Rows come to their task sorted and are hashed as they come, so a conversation of any length needs no memory.
    """
    source = repaired.select(F.col(conv_col).alias("conv"), key_of(F.col(conv_col)).alias("key"), "place", "order", F.concat("role", F.lit(":"), "text").alias("line"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, digest = None, None, None
        for batch in batches:
            done = [], []
            for next_conv, next_key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                if next_key != key:
                    if digest is not None:
                        done[0].append(conv)
                        done[1].append(digest.hexdigest())
                    key, conv, digest = next_key, next_conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema[0].type), pa.array(done[1], pa.string())], names=["conv", "repaired_sha256"])
            kind = batch.schema[0].type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    conv_type = source.schema[0].dataType.simpleString()
    ordered = source.repartition("key").sortWithinPartitions("key", "place", "order")
    return ordered.mapInArrow(summed, f"conv {conv_type}, repaired_sha256 string").withColumnRenamed("conv", conv_col)
