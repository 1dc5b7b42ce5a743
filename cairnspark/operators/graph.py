"""The commit graph. Edges are (child, parent, nth), nth 1 for the first parent.

Walks over all parents go from run to run. A run is a stretch of commits without a branch or a merge inside: every commit but the
last has one parent, which is nobody else's. Runs are found by doubling, so a history of a million commits in a row costs
twenty rounds; after that a walk needs a round for each run on its way, not for each commit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.scratch import cut, drop

COMPACT = 8  # rounds after which what was seen is put into one table


def hops(edges: DataFrame, doublings: int) -> list[DataFrame]:
    """(node, ancestor) over 1, 2, 4, ... first-parent hops: N hops need as many joins as N has binary digits."""
    out = [cut(edges.where("nth = 1").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")), "hops")]
    for _ in range(doublings - 1):
        a, b = out[-1].alias("a"), out[-1].alias("b")
        out.append(cut(a.join(b, F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor"), "hops"))
    return out


def ancestor_at(heads: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """heads (head) with the commit n first-parent hops back; heads with a shorter history drop out."""
    powers = hops(edges, max(1, n.bit_length()))
    at = heads.select("head", F.col("head").alias("node"))
    for k in range(n.bit_length()):
        if n >> k & 1:
            at = at.join(powers[k], "node").select("head", F.col("ancestor").alias("node"))
    return at.select("head", F.col("node").alias("ancestor"))


def ancestors_at(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """asked (key, node, n), each row with its own number of hops, to key, oid; null where the history is shorter.

    Only the powers of two that occur are joined, and a row takes those of its number.
    """
    at = cut(asked.select("key", "node", F.col("n").cast("bigint").alias("n")), "asked")
    most = at.agg(F.max("n")).first()[0] or 0
    for k, step in enumerate(hops(edges, most.bit_length())) if most else ():
        takes = F.shiftright("n", k).bitwiseAND(F.lit(1)) == 1
        joined = at.join(step, (at["node"] == step["node"]) & takes, "left")
        at = joined.select("key", F.when(takes, step["ancestor"]).otherwise(at["node"]).alias("node"), "n")
    return at.select("key", F.col("node").alias("oid"))


def log(heads: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """The first limit commits of each head's first-parent history: head, depth, commit. Every round doubles what is known."""
    doublings = max(1, (limit - 1).bit_length())
    known = heads.select("head", F.lit(0).alias("depth"), F.col("head").alias("commit"))
    for k, step in enumerate(hops(edges, doublings)):
        further = known.where(F.col("depth") < limit - (1 << k)).join(step, F.col("commit") == F.col("node"))
        known = cut(known.union(further.select("head", F.col("depth") + (1 << k), "ancestor")), "log")
    return known


def runs(edges: DataFrame) -> DataFrame:
    """oid, run (the id of its last commit, the one nearest to the roots) and place (hops to that, 1 or more) of all commits that are
    not the last of their run. Any other commit is the last of the run that carries its own id, at place 0.

    A parent that a commit names twice counts once. A cycle is an error.
    """
    one = lambda key, other: edges.groupBy(key).agg(F.min(other).alias(other), F.max(other).alias("most")).where(F.col(other) == F.col("most")).drop("most")
    inner = one("child", "parent").join(one("parent", "child"), ["child", "parent"])
    at = cut(inner.select(F.col("child").alias("oid"), F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("place")), "runs")
    while True:
        ahead = at.select(F.col("oid").alias("to"), F.col("to").alias("next"), F.col("place").alias("more"))
        moved = at.join(ahead, "to", "left").select("oid", F.coalesce("next", "to").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("place"), F.col("next").isNotNull().alias("moved"))
        before, at = at, cut(moved, "runs")
        drop(before)
        going, most, n = at.agg(F.count_if("moved"), F.max("place"), F.count("*")).first()
        if not going:
            return at.select("oid", F.col("to").alias("run"), "place")
        if most > n:
            raise ValueError("the graph has a cycle")


def in_runs(rows: DataFrame, member: DataFrame) -> DataFrame:
    """rows (oid, ...) with run and place, from what runs() gives."""
    return rows.join(member, "oid", "left").withColumns({"run": F.coalesce("run", "oid"), "place": F.coalesce("place", F.lit(0).cast("bigint"))})


def run_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(run, next, place): the runs that a run's last commit leads to, and the place at which they are entered, their top."""
    last = edges.select("child", "parent").join(member.select(F.col("oid").alias("child")), "child", "left_anti")
    entered = in_runs(last.select(F.col("child").alias("from"), F.col("parent").alias("oid")), member)
    return entered.select(F.col("from").alias("run"), F.col("run").alias("next"), "place")


def first_parent_reach(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return reach(pairs, edges.where("nth = 1"))


def _nodes(edges: DataFrame, member: DataFrame) -> DataFrame:
    """oid, run, place, is_parent, is_child of all commits with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("child").alias("oid"), F.lit(False).alias("is_parent")), F.struct(F.col("parent").alias("oid"), F.lit(True).alias("is_parent")))).alias("e")).select("e.*")
    ends = ends.groupBy("oid").agg(F.max("is_parent").alias("is_parent"), F.max(~F.col("is_parent")).alias("is_child"))
    return cut(in_runs(ends, member), "nodes")


def _located(rows: DataFrame, name: str, nodes: DataFrame) -> DataFrame:
    """rows with run, place, is_parent and is_child of the commit in a column; null for one without an edge."""
    side = nodes.select(F.col("oid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in nodes.columns if c != "oid"])
    return rows.join(side, name, "left")


def _between(ancestor: str, descendant: str) -> Column:
    """Whether a walk must tell: only a commit that is a parent can be above another, only one that has a parent can be below."""
    apart = F.col(f"{ancestor}_run") != F.col(f"{descendant}_run")
    return F.coalesce(apart & F.col(f"{ancestor}_is_parent") & F.col(f"{descendant}_is_child"), F.lit(False))


def _is_above(ancestor: str, descendant: str, hit: str) -> Column:
    same = F.col(f"{ancestor}_run") == F.col(f"{descendant}_run")
    inside = F.when(same, F.col(f"{ancestor}_place") <= F.col(f"{descendant}_place")).otherwise(F.coalesce(hit, F.lit(False)))
    return F.coalesce(F.when(F.col(ancestor) == F.col(descendant), True).otherwise(inside), F.lit(False))


def _reached(open_: DataFrame, steps: DataFrame) -> DataFrame:
    """start, at, each pair once: the runs that lie above the starts of the open pairs (start, at) of runs.

    All pairs with a start share its walk. Runs that a start has seen are not visited again; every few rounds the starts leave
    whose pairs are all met.
    """
    seen = frontier = cut(open_.select("start", F.col("start").alias("at")).distinct(), "frontier")
    for k in count(1):  # each round visits runs that were not seen, so there is an end
        moved = frontier.join(steps, frontier["at"] == steps["run"]).select("start", F.col("next").alias("at")).distinct()
        frontier = cut(moved.join(seen, ["start", "at"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        if k % COMPACT:
            seen = seen.union(frontier)
        else:
            seen = cut(seen.union(frontier), "seen")
            frontier = cut(frontier.join(open_.join(seen, ["start", "at"], "left_anti"), "start", "left_semi"), "frontier")


def reach(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) with is_ancestor, over all parents and without a limit on the graph's size.

    A frontier of runs for each run with a descendant moves towards the roots. A commit is its own ancestor. Ids may be of any
    type; numbers in place of digests make all tables a fraction of the size.
    """
    member = runs(edges)
    nodes = _nodes(edges, member)
    asked = _located(_located(pairs.select("ancestor", "descendant"), "ancestor", nodes), "descendant", nodes)
    asked = cut(asked.drop("ancestor_is_child", "descendant_is_parent"), "pairs")
    ends = [F.col("descendant_run").alias("start"), F.col("ancestor_run").alias("at")]
    seen = _reached(asked.where(_between("ancestor", "descendant")).select(*ends), cut(run_edges(edges, member).select("run", "next"), "steps"))
    return _met(asked, "ancestor", "descendant", seen).select("ancestor", "descendant", _is_above("ancestor", "descendant", "hit").alias("is_ancestor"))


def _met(asked: DataFrame, ancestor: str, descendant: str, seen: DataFrame, hit: str = "hit") -> DataFrame:
    """asked with true where a walk from the descendant's run has met the ancestor's."""
    found = seen.select(F.col("start").alias(f"{descendant}_run"), F.col("at").alias(f"{ancestor}_run"), F.lit(True).alias(hit))
    return asked.join(found, [f"{descendant}_run", f"{ancestor}_run"], "left")


def reachable(heads: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """oid of all commits that heads (oid) reach, themselves included; depth limits the number of hops, as a shallow copy does."""
    if depth is not None:
        steps = edges.select(F.col("child").alias("oid"), "parent")
        seen = frontier = cut(heads.select("oid").distinct(), "reached")
        for _ in range(depth):
            frontier = cut(frontier.join(steps, "oid").select(F.col("parent").alias("oid")).distinct().join(seen, "oid", "left_anti"), "reached")
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
        return seen
    member = runs(edges)
    steps = cut(run_edges(edges, member), "steps")
    frontier = seen = cut(in_runs(heads.select("oid").distinct(), member).groupBy("run").agg(F.max("place").alias("top")), "reached")
    for k in count(1):  # a run comes back at most once, with its top, if a head stands inside it
        moved = frontier.join(steps.select("run", "next", F.col("place").alias("entered")), "run").groupBy(F.col("next").alias("run")).agg(F.max("entered").alias("top"))
        known = seen.select("run", F.col("top").alias("have"))
        frontier = cut(moved.join(known, (moved["run"] == known["run"]) & (moved["top"] <= known["have"]), "left_anti"), "reached")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier) if k % COMPACT else cut(seen.union(frontier).groupBy("run").agg(F.max("top").alias("top")), "reached")
    tops = cut(seen.groupBy("run").agg(F.max("top").alias("top")), "reached")
    return member.join(tops, "run").where("place <= top").select("oid").union(tops.select("run"))


def merge_analysis(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """heads (ours, theirs) with UNBORN, UP_TO_DATE, FASTFORWARD or NORMAL; ours is null if there is no commit yet."""
    member = runs(edges)
    nodes = _nodes(edges, member)
    asked = cut(_located(_located(heads.select("ours", "theirs"), "ours", nodes), "theirs", nodes), "pairs")
    ways = [asked.where(_between(a, d)).select(F.col(f"{d}_run").alias("start"), F.col(f"{a}_run").alias("at")) for a, d in (("ours", "theirs"), ("theirs", "ours"))]
    seen = _reached(ways[0].union(ways[1]), cut(run_edges(edges, member).select("run", "next"), "steps"))
    rows = _met(_met(asked, "ours", "theirs", seen, "forward"), "theirs", "ours", seen, "back")
    forward, back = _is_above("ours", "theirs", "forward"), _is_above("theirs", "ours", "back")
    verdict = F.when(F.col("ours").isNull(), "UNBORN").when(F.col("ours") == F.col("theirs"), "UP_TO_DATE").when(forward, "FASTFORWARD").when(back, "UP_TO_DATE").otherwise("NORMAL")
    return rows.select("ours", "theirs", verdict.alias("analysis"))


def fast_forward(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """heads (name, ours, theirs) to name, oid, merged: theirs where ours is behind it or there is none, else ours as it was."""
    verdicts = merge_analysis(heads.select("ours", "theirs").distinct(), edges)
    verdicts = verdicts.select(F.col("ours").alias("from"), F.col("theirs").alias("to"), F.col("analysis").isin("FASTFORWARD", "UNBORN").alias("merged"))
    rows = heads.join(verdicts, F.col("ours").eqNullSafe(F.col("from")) & (F.col("theirs") == F.col("to")))
    return rows.select("name", F.when(F.col("merged"), F.col("theirs")).otherwise(F.col("ours")).alias("oid"), "merged")


def generations(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """oid, generation: 0 for a commit without parents, else one more than its parents' largest.

    Round k has the runs that lie k others above a root, with the longest such way; the longest of all rounds counts. A round is
    one join with the edges between runs.
    """
    member = runs(edges)
    steps = cut(run_edges(edges, member).select(F.col("next").alias("run"), F.col("run").alias("above"), (F.col("place") + 1).alias("step")), "steps")
    roots = steps.select("run").distinct().join(steps.select(F.col("above").alias("run")), "run", "left_anti")
    at = cut(roots.select("run", F.lit(0).cast("bigint").alias("way")), "ways")
    ways, rounds = at, steps.select("above").distinct().count()
    for k in count(1):
        at = cut(at.join(steps, "run").groupBy(F.col("above").alias("run")).agg(F.max(F.col("way") + F.col("step")).alias("way")), "ways")
        if at.isEmpty():
            break
        if k > rounds:
            raise ValueError("the graph has a cycle")
        ways = ways.union(at) if k % COMPACT else cut(ways.union(at).groupBy("run").agg(F.max("way").alias("way")), "ways")
    longest = cut(ways.groupBy("run").agg(F.max("way").alias("way")), "ways")
    if not steps.join(longest.select(F.col("run").alias("above")), "above", "left_anti").isEmpty():
        raise ValueError("the graph has a cycle")  # one that no root is below
    known = in_runs(commits.select("oid").distinct(), member).join(longest, "run", "left")
    return known.select("oid", (F.coalesce("way", F.lit(0)) + F.col("place")).cast("int").alias("generation"))


def topological(edges_by_parents: DataFrame, positions: DataFrame, generations_: DataFrame) -> DataFrame:
    """The commit graph as columns: position by id, positions of the first two parents, generation."""
    at = lambda name: positions.select(F.col("oid").alias(f"{name}_oid"), F.col("position").alias(name))
    parent = lambda n: edges_by_parents.where(F.col("nth") == n).select(F.col("child").alias("oid"), F.col("parent").alias(f"parent{n}_oid"))
    rows = positions.join(generations_, "oid").join(parent(1), "oid", "left").join(parent(2), "oid", "left")
    return rows.join(at("parent1"), "parent1_oid", "left").join(at("parent2"), "parent2_oid", "left").select("position", "oid", "parent1", "parent2", "generation")


def chain_ids(rows: DataFrame) -> DataFrame:
    """rows (chain, seq, key, head, tail) to key, oid: ids of commits that name the one before them, in each chain by seq.

    A payload is head, a parent line unless the commit is the first, and tail. An id holds the id before it, so a chain is computed
    one commit after the other, in one pass over sorted rows that keeps a single id in memory.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, None
        for batch in batches:
            out = []
            for own, head, tail in zip(batch["chain"], batch["head"], batch["tail"], strict=True):
                middle = f"parent {last}\n" if own == chain else ""
                payload = f"{head}{middle}{tail}".encode()
                chain, last = own, hashlib.sha256(b"commit %d\0" % len(payload) + payload).hexdigest()
                out.append(last)
            yield pd.DataFrame({"key": batch["key"], "oid": pd.Series(out, batch.index, object)})

    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.select("chain", "seq", "key", "head", "tail").repartition("chain").sortWithinPartitions("chain", "seq")
    return dealt.select("chain", "key", "head", "tail").mapInPandas(run, f"key {kind}, oid string")
