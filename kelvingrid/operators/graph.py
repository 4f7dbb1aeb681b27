"""Graph operators: reachability, topology, roll-ups over trees, chains and pipe sizing, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.plans import rules
from kelvingrid.plans.shared import discard, materialise


def reached(nodes: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """Ids of ``nodes(id, upstream)`` from which a root (``roots(id)``) can be reached upstream, and the roots.

    Each round doubles how far every id looks up: the logarithm of the longest way is the number of rounds. What looks into nothing drops
    out, and what goes round in a cycle is left over when the ways can't be any longer.
    """
    tops = roots.select("id").distinct()
    now = nodes.groupBy("id").agg(F.min("upstream").alias("up")).join(tops, "id", "left_anti")
    now = materialise(now.join(tops.select(F.col("id").alias("up"), F.lit(True).alias("top")), "up", "left").select("id", "up", F.coalesce("top", F.lit(False)).alias("done")))
    n = now.count()
    for k in range(rounds):
        further = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("done").alias("then"))
        open_ = now.where("not done").join(further, "up").select("id", F.col("next").alias("up"), F.col("then").alias("done"))
        nxt = materialise(now.where("done").unionByName(open_))
        discard(now)
        now = nxt
        if 2 ** (k + 1) > n or now.where("not done").isEmpty():
            return materialise(now.where("done").select("id").unionByName(tops).distinct())
    raise RuntimeError("reachability did not end")


def below(edges: DataFrame, values: DataFrame, value: str, fold, rounds: int = 64) -> DataFrame:
    """(id, value): ``fold`` of the values of each node of a forest ``edges(parent, child)`` and all below it: F.sum, F.max, or ``union`` of arrays.

    After k rounds a node holds the fold of what is less than 2**k levels below it, and a pointer 2**k levels up; the next round adds its
    value to that ancestor's. Rows stay as many as nodes, rounds as many as the logarithm of the depth.
    """
    ids = edges.select(F.col("child").alias("id")).unionByName(edges.select(F.col("parent").alias("id"))).distinct()
    up = edges.select(F.col("child").alias("id"), F.col("parent").alias("up"))
    now = materialise(ids.join(values.select("id", F.col(value).alias("v")), "id", "left").join(up, "id", "left"))
    pair = F.array_compact(F.array("v", "more"))
    both = union_of(pair) if fold is union else F.aggregate(pair, F.lit(0).cast(now.schema["v"].dataType), lambda x, y: x + y) if fold is F.sum else F.array_max(pair)
    for _ in range(rounds):
        gifts = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(fold("v").alias("more"))
        jump = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        nxt = materialise(now.join(gifts, "id", "left").join(jump, "up", "left").select("id", F.when(F.size(pair) > 0, both).alias("v"), F.col("next").alias("up")))
        discard(now)
        now = nxt
        if now.where("up is not null").isEmpty():
            return now.where("v is not null").select("id", F.col("v").alias(value))
    raise RuntimeError("the forest has a cycle")


def union_of(lists):
    return F.array_distinct(F.flatten(lists))


def union(lists):
    """The fold of arrays to the array of their distinct items."""
    return union_of(F.collect_list(lists))


def upward(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, total, top) of ``rows(id, up, v)``: the sum of v from each row along ``up`` to the row, ``top``, that has none, by pointers that double their reach."""
    ids = rows.select(F.col("id").alias("up"), F.lit(True).alias("__there"))
    known = rows.join(ids, "up", "left").select("id", F.when(F.col("__there"), F.col("up")).alias("up"), F.col("v").alias("total"), F.col("id").alias("top"))
    now = materialise(known)
    for _ in range(rounds):
        if now.where("up is not null").isEmpty():
            return now.select("id", "total", "top")
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("top").alias("last"))
        nxt = materialise(now.join(ahead, "up", "left").select("id", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0).cast(now.schema["total"].dataType))).alias("total"), F.coalesce("last", "top").alias("top")))
        discard(now)
        now = nxt
    raise RuntimeError("the rows go round in a cycle")


def ways(edges: DataFrame, starts: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, anc, depth): every ancestor of the ids of ``starts(id)`` in a forest ``edges(parent, child)``, each id its own at 0.

    Tables of who is 2**k levels above whom have a row a node at the most. From the longest on, each adds to the places known the places that
    far above them, so rows are never more than the result's, and rounds are the logarithm of the depth.
    """
    step = materialise(edges.select(F.col("child").alias("at"), F.col("parent").alias("to")))
    jumps = []
    for _ in range(rounds):
        if step.isEmpty():
            break
        jumps.append(step)
        step = materialise(step.join(step.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")))
    else:
        raise RuntimeError("the forest has a cycle")
    now = starts.select("id", F.col("id").alias("anc"), F.lit(0).alias("depth"))
    for k in range(len(jumps) - 1, -1, -1):
        further = now.join(jumps[k].withColumnRenamed("at", "anc"), "anc").select("id", F.col("to").alias("anc"), (F.col("depth") + 2**k).alias("depth"))
        now = materialise(now.unionByName(further))
    for done in jumps:
        discard(done)
    return now


def cyclic(edges: DataFrame, rounds: int = 64, peels: int = 10_000) -> DataFrame:
    """Ids of ``edges(parent, child)`` on or below a cycle.

    Ids with one parent look up twice as far in each round, until they see an id without parents or with several; who still sees neither when the ways can't be longer is on or below a
    cycle: the logarithm of the ids is the number of rounds. Ids with several parents, which a tree hasn't, are then peeled off
    from the top, where only they and what they see count.
    """
    e = materialise(edges.select("parent", "child").distinct())
    parents = e.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
    several = materialise(parents.where("n > 1").select("id"))
    one = parents.where("n = 1").select("id", "up")
    n = one.count()
    ends = e.select(F.col("parent").alias("id")).distinct().join(parents.where("n = 1").select("id"), "id", "left_anti")
    now = materialise(one.join(ends.select(F.col("id").alias("up"), F.lit(True).alias("end")), "up", "left").select("id", "up", F.coalesce("end", F.lit(False)).alias("done")))
    reach = 1
    for _ in range(rounds):
        if reach > n or now.where("not done").isEmpty():
            break
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("done").alias("then"))
        nxt = materialise(now.where("done").unionByName(now.where("not done").join(ahead, "up").select("id", F.col("next").alias("up"), F.col("then").alias("done"))))
        discard(now)
        now, reach = nxt, 2 * reach
    round_ = now.where("not done").select("id")
    if several.isEmpty():
        return round_
    # what each parent of an id with several is, or sees: an end, or a cycle
    seen = e.join(several.withColumnRenamed("id", "child"), "child").join(now.select(F.col("id").alias("parent"), "up", "done"), "parent", "left")
    seen = materialise(seen.select("child", F.when(F.coalesce("done", F.lit(True)), F.coalesce("up", "parent")).alias("end")).distinct())
    bad = seen.where("end is null").select(F.col("child").alias("id")).distinct()
    rest = materialise(seen.where("end is not null").join(several.withColumnRenamed("id", "end"), "end", "left_semi"))
    inner = rest
    for _ in range(peels):
        less = materialise(inner.join(inner.select(F.col("child").alias("end")).unionByName(bad.withColumnRenamed("id", "end")).distinct(), "end", "left_semi"))
        if less.count() == inner.count():
            break
        inner = less
    else:
        raise RuntimeError("peeling did not end")
    lost = materialise(inner.select(F.col("child").alias("id")).unionByName(bad).distinct())
    below_ = now.where("done").join(lost.withColumnRenamed("id", "up"), "up", "left_semi").select("id")
    return round_.unionByName(lost).unionByName(below_).distinct()


def subtree_flow(edges: DataFrame, demand: DataFrame) -> DataFrame:
    """(id, flow): the demand of each node and all below it."""
    return below(edges, demand, "demand", F.sum).withColumnRenamed("demand", "flow")


def root_paths(edges: DataFrame) -> DataFrame:
    """(leaf, edge, at): each leaf's edges (named by their child) in order from the leaf to the root."""
    leaves = edges.select(F.col("child").alias("id")).join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    inner = ways(edges, leaves).join(edges.select(F.col("child").alias("anc")), "anc", "left_semi")
    return inner.select(F.col("id").alias("leaf"), F.col("anc").alias("edge"), F.col("depth").alias("at"))


def chains(rows: DataFrame, group: list[str], order: str, value: str, slack: float = 1e-9) -> DataFrame:
    """Number the runs of equal values along an order: adds ``chain`` from 0."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.when(F.abs(F.col(value) - F.lag(value).over(w)) <= slack, 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def dn_by_run(rows: DataFrame, flow: str, length: str, floor: str) -> DataFrame:
    """Adds ``dn``: the first diameter of ``floor`` or more that carries the flow over the length; null where there is none."""
    dn = F.when(F.lit(False), F.lit(0))
    for r in rules.DN_TABLE:
        dn = dn.when((F.lit(r[0]) >= F.col(floor)) & (F.col(flow) <= r[1] + rules.SLACK) & (F.col(length) <= r[2] + rules.SLACK), r[0])
    return rows.withColumn("dn", dn.cast("int"))


def equal_runs(edges: DataFrame, slack: float = 1e-9) -> DataFrame:
    """(child, top, flow, length) of the edges of ``edges(parent, child, flow, length)`` at which a run of equal flow begins, seen from the leaves.

    An edge goes on in the one above it where their flows are equal. A run is named by its lowest edge, and knows the highest, its flow and its whole length. Runs
    that begin where another one passes are parts of that one and are left out.
    """
    e = edges.select("parent", "child", "flow", "length")
    above = e.select(F.col("child").alias("parent"), F.col("flow").alias("next"))
    linked = e.join(above, "parent", "left").select("child", F.when(F.abs(F.col("flow") - F.col("next")) <= slack, F.col("parent")).alias("up"), "length")
    linked = materialise(linked)
    sums = upward(linked.select(F.col("child").alias("id"), "up", F.col("length").alias("v")))
    heads = sums.join(linked.select(F.col("up").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    return heads.join(e.select(F.col("child").alias("top"), "flow"), "top").select(F.col("id").alias("child"), "top", "flow", F.col("total").alias("length"))


def required_diameters(edges: DataFrame, strict: bool = True, rounds: int = 64, skip: bool = False) -> DataFrame:
    """Diameters of ``edges(parent, child, flow, length)``: (child, dn), smallest that satisfy all rules.

    Along each path from a leaf to its root every run of equal flow needs one diameter that carries the flow over the run's
    whole length, and diameters never fall toward the root. So a run asks for no less than its highest edge has, and what its lowest edge
    is given reaches all the others with the rule that nothing falls. Both rules only raise diameters, so repeating them ends. Rows
    are never more than edges. A run that no diameter carries is an error or, if not ``strict``, has null, and so has all above it. With ``skip`` it asks for nothing, and
    has what the ones below it need, null if that is nothing.
    """
    runs = materialise(equal_runs(edges), "runs")
    none = 1 << 30
    strict = strict and not skip
    beyond = F.lit(None).cast("int") if skip else F.lit(none)
    own = edges.select(F.col("child").alias("id"), F.coalesce(rules.min_dn(F.col("flow"), strict), beyond).alias("dn"))
    now = materialise(below(edges, own, "dn", F.max).join(edges.select(F.col("child").alias("id")), "id", "left_semi"), "diameters")
    for _ in range(rounds):
        need = dn_by_run(runs.join(now.select(F.col("id").alias("top"), F.col("dn").alias("floor")), "top"), "flow", "length", "floor")
        need = materialise(need.select(F.col("child").alias("id"), F.coalesce("dn", beyond).alias("need"), "floor"), "needs")
        if strict and not need.where(F.col("need") == none).isEmpty():
            raise ValueError("a run is too long for every diameter")
        raised = now.join(need.select("id", "need"), "id", "left").select("id", F.greatest("dn", "need").alias("dn"))
        after = materialise(below(edges, raised, "dn", F.max).join(edges.select(F.col("child").alias("id")), "id", "left_semi"), "diameters")
        same = after.join(now, ["id", "dn"], "left_anti").isEmpty()
        for done in (now, need):
            discard(done)
        now = after
        if same:
            discard(runs)
            sized = now.select(F.col("id").alias("child"), F.when(F.col("dn") < none, F.col("dn")).alias("dn"))
            return edges.select("child").join(sized, "child", "left") if skip else sized
    raise RuntimeError("diameters did not settle")


def rake(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, gone) without the ends of ``edges(a, b, length)``, both ways listed: ids with one neighbour hang on it, ``gone(id, e1, l1, e2, l2)``."""
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("b", "length")).alias("s")).where("n = 1")
    gone = materialise(degree.join(roots.select(F.col("id").alias("a")), "a", "left_anti").select(F.col("a").alias("id"), F.col("s.b").alias("e1"), F.col("s.length").alias("l1"), F.col("s.b").alias("e2"), F.lit(None).cast("double").alias("l2")), "raked")
    out = gone.select("id")
    return edges.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti"), gone


def compress(edges: DataFrame, roots: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(edges, gone) without the inner ids of chains, those with two neighbours: a chain becomes one edge, and its ids know both its ends and how far they are.

    Each direction of an edge that leads into a chain's inner id points to the one that leads on; pointers double their reach. Rings without a root or a fork have no end: no
    root reaches them, and they are dropped.
    """
    inner = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("x"), F.max("b").alias("y")).where("n = 2").join(roots.select(F.col("id").alias("a")), "a", "left_anti")
    inner = materialise(inner.select(F.col("a").alias("b"), "x", "y"), "inner")
    onward = F.when(F.col("x").isNotNull(), F.struct(F.col("b").alias("a"), F.when(F.col("x") == F.col("a"), F.col("y")).otherwise(F.col("x")).alias("b")))
    now = materialise(edges.join(inner, "b", "left").select(F.struct("a", "b").alias("h"), onward.alias("next"), F.col("b").alias("end"), F.col("length").alias("far")), "halves")
    reach, n = 1, 2 * inner.count()
    for _ in range(rounds):
        if reach > n or now.where("next is not null").isEmpty():
            break
        ahead = now.select(F.col("h").alias("next"), F.col("next").alias("then"), F.col("end").alias("last"), F.col("far").alias("more"))
        nxt = materialise(now.join(ahead, "next", "left").select("h", F.col("then").alias("next"), F.coalesce("last", "end").alias("end"), (F.col("far") + F.coalesce("more", F.lit(0.0))).alias("far")), "halves")
        discard(now)
        now, reach = nxt, 2 * reach
    ended = now.where("next is null").select("h.a", "end", "far")
    sides = ended.join(inner.select(F.col("b").alias("a")), "a", "left_semi").groupBy("a").agg(F.min(F.struct("end", "far")).alias("p"), F.max(F.struct("end", "far")).alias("q"))
    gone = materialise(sides.select(F.col("a").alias("id"), F.col("p.end").alias("e1"), F.col("p.far").alias("l1"), F.col("q.end").alias("e2"), F.col("q.far").alias("l2")), "compressed")
    kept = ended.join(inner.select(F.col("b").alias("a")), "a", "left_anti").where("a <> end").groupBy("a", F.col("end").alias("b")).agg(F.min("far").alias("length"))
    return kept, gone


def shortest(edges: DataFrame, roots: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Least distances from the roots over undirected ``edges(a, b, length)``: (id, distance, via), via null at a root.

    Ends are raked off and chains compressed, turn by turn, until less than a tenth goes: trees vanish in a logarithm of turns, whatever their depth, and
    what is left is a core of forks. The core is relaxed, by what improved in each round, and the rest follows in the opposite order, a join for
    each turn.
    """
    both = edges.select("a", "b", F.col("length").cast("double").alias("length")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("length").cast("double").alias("length")))
    both = materialise(both.where("a <> b").groupBy("a", "b").agg(F.min("length").alias("length")), "graph")
    now, turns = both, []
    for _ in range(64):
        n = now.count()
        if not n:
            break
        raked, gone = rake(now, roots)
        turns.append(gone)
        kept, gone = compress(materialise(raked, "graph"), roots)
        turns.append(gone)
        now = materialise(kept, "graph")
        if now.count() > 0.9 * n:
            break
    best = changed = materialise(roots.select("id", F.lit(0.0).alias("distance")).distinct())
    for _ in range(rounds):
        offers = now.join(changed.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
        known = best.select("id", F.col("distance").alias("old"))
        changed = materialise(offers.join(known, "id", "left").where("old is null or distance < old - 1e-12").drop("old"))
        if changed.isEmpty():
            break
        best = materialise(best.join(changed.select("id"), "id", "left_anti").unionByName(changed))
    else:
        raise RuntimeError("distances did not settle")
    for gone in reversed(turns):
        at = lambda e, d: best.select(F.col("id").alias(e), F.col("distance").alias(d))  # noqa: E731,B023
        found = gone.join(at("e1", "d1"), "e1", "left").join(at("e2", "d2"), "e2", "left")
        found = found.select("id", F.least(F.col("d1") + F.col("l1"), F.col("d2") + F.col("l2")).alias("distance")).where("distance is not null")
        best = materialise(best.unionByName(found))
        discard(gone)
    via = both.join(best.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct(F.col("distance") + F.col("length"), F.col("a"))).alias("o")).join(roots.select("id").distinct(), "id", "left_anti")
    return best.join(via.select("id", F.col("o.a").alias("via")), "id", "left")
