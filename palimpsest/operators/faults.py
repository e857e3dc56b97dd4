"""A seeded model of faulty networks over traces of messages (msg_id, src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Per cent of messages lost, bounds of the jitter, extra delay at the slow node (ms), and whether messages are reordered.
#: Fixed values of the scenarios, as are the outages below.
SCENARIOS = (
    ("packet_loss", 25, 0, 0, 0, False), ("jitter", 0, 30, 80, 0, False), ("slow_follower", 0, 0, 0, 250, False), ("leader_crash", 0, 0, 0, 0, False),
    ("split_brain", 0, 0, 0, 0, False), ("reorder", 0, 0, 0, 0, True), ("correlated_crash", 0, 0, 0, 0, False), ("flapping", 0, 0, 0, 0, False),
    ("disk_fault", 0, 0, 0, 0, False), ("baseline", 0, 0, 0, 0, False),
)
#: Messages of a round, and between which of them (from, until) nodes are down. Of a flapping node there are four crashes.
ROUND = 100
DOWN, FLAPS = ((30, 60),), ((10, 16), (22, 28), (34, 40), (46, 52))
REORDER = (5, 49)


def outages(scenario: str, nodes: tuple[str, ...], leader: str) -> list[tuple[str, tuple[tuple[int, int], ...]]]:
    """Which nodes are down, and when, under a scenario: the leader, a follower, or as many followers as a majority can
    spare."""
    followers = [n for n in nodes if n != leader]
    if scenario == "leader_crash":
        return [(leader, DOWN)]
    if scenario == "correlated_crash":
        return [(n, DOWN) for n in followers[: max(1, (len(nodes) - 1) // 2)]]
    if scenario == "flapping":
        return [(followers[0], FLAPS)]
    return [(followers[0], DOWN)] if scenario == "disk_fault" else []


def reachable(nodes: DataFrame) -> DataFrame:
    """src, dst, reachable of all node pairs, for nodes (node_id, is_isolated, part): isolated nodes reach nobody, a node
    of a partition reaches that partition only, and a node in none reaches all. Nodes are few."""
    a, b = nodes.alias("a"), nodes.alias("b")
    meets = F.col("a.part").isNull() | F.col("a.part").eqNullSafe(F.col("b.part"))
    ok = ~F.col("a.is_isolated") & ~F.col("b.is_isolated") & meets
    return a.join(F.broadcast(b), F.col("a.node_id") != F.col("b.node_id")).select(F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"), ok.alias("reachable"))


def draw(column: str, salt: int, n: int):
    """A number in [0, n) that depends on the message and the salt only."""
    return F.pmod(F.col(column) * 7919 + salt * 104729, F.lit(1_000_003)) % n


def faulty(trace: DataFrame, scenario: str, slow: str = "n3", blocked: tuple[tuple[str, str], ...] = (), nodes: tuple[str, ...] = ("n1", "n2", "n3"), leader: str = "n1", loss: float | None = None) -> DataFrame:
    """trace with dropped and delay_ms under a scenario.

    Blocked directions always drop, as do messages from or to a node that is down and, in a split, those between the
    leader and the others. ``loss`` replaces the scenario's share of lost messages; it counts as 0 to 1.
    """
    _, percent, low, high, extra, reorder = next(s for s in SCENARIOS if s[0] == scenario)
    percent = percent if loss is None else 100 * min(1.0, max(0.0, loss))
    at, wall = F.pmod(F.col("msg_id"), F.lit(ROUND)), F.lit(False)
    for src, dst in blocked:
        wall = wall | ((F.col("src") == src) & (F.col("dst") == dst))
    for node, times in outages(scenario, nodes, leader):
        for start, end in times:
            wall = wall | (((F.col("src") == node) | (F.col("dst") == node)) & at.between(start, end - 1))
    if scenario == "split_brain":
        wall = wall | (((F.col("src") == leader) != (F.col("dst") == leader)) & at.between(DOWN[0][0], DOWN[0][1] - 1))
    delay = F.lit(low) + (draw("msg_id", 2, high - low + 1) if high > low else F.lit(0))
    delay = delay + F.when(F.col("src") == slow, extra).otherwise(0) + F.when(F.col("dst") == slow, extra).otherwise(0)
    if reorder:
        delay = delay + REORDER[0] + draw("msg_id", 3, REORDER[1] - REORDER[0] + 1)
    return trace.withColumn("dropped", wall | (draw("msg_id", 1, 100) < percent)).withColumn("delay_ms", F.when(F.col("dropped"), 0).otherwise(delay).cast("bigint"))


def transported(trace: DataFrame, nodes: DataFrame) -> DataFrame:
    """trace with dropped: messages whose ends don't reach each other or that go to a node that isn't there. Nodes are few."""
    pairs = reachable(nodes)
    return trace.join(F.broadcast(pairs), ["src", "dst"], "left").withColumn("dropped", ~F.coalesce("reachable", F.lit(False))).drop("reachable")


def suite(trace: DataFrame, nodes: tuple[str, ...] = ("n1", "n2", "n3"), leader: str = "n1") -> DataFrame:
    """Per scenario over one trace: sent, dropped, delayed, longest delay, rounds, rounds_held and passed. A round holds
    if nodes that make up a majority exchanged messages in it. The rounds are aggregated before they are judged."""
    rounds = None
    for name, *_ in SCENARIOS:
        seen = faulty(trace, name, slow=nodes[-1], nodes=nodes, leader=leader).withColumn("round", F.floor(F.col("msg_id") / ROUND))
        arrived = [F.max(F.when(~F.col("dropped") & ((F.col("src") == n) | (F.col("dst") == n)), 1).otherwise(0)) for n in nodes]
        one = seen.groupBy("round").agg(
            F.count(F.lit(1)).alias("sent"), F.count_if("dropped").alias("dropped"), F.count_if(F.col("delay_ms") > 0).alias("delayed"), F.max("delay_ms").alias("longest"),
            (sum(arrived[1:], arrived[0]) >= len(nodes) // 2 + 1).alias("held"),
        )
        one = one.withColumn("scenario", F.lit(name))
        rounds = one if rounds is None else rounds.unionByName(one)
    out = rounds.groupBy("scenario").agg(
        F.sum("sent").alias("sent"), F.sum("dropped").alias("dropped"), F.sum("delayed").alias("delayed"), F.max("longest").alias("longest_ms"),
        F.count(F.lit(1)).alias("rounds"), F.count_if("held").alias("rounds_held"),
    )
    return out.withColumn("passed", F.col("rounds") == F.col("rounds_held"))


def counters(trace: DataFrame) -> DataFrame:
    return trace.agg(F.count(F.lit(1)).alias("sent"), F.count_if("dropped").alias("dropped"), F.count_if(F.col("delay_ms") > 0).alias("delayed"))


def summary(results: DataFrame) -> DataFrame:
    """Over scenario results (scenario, passed): passed, total, percent, all_passed."""
    ok, n = F.count_if("passed"), F.count(F.lit(1))
    return results.agg(ok.alias("passed"), n.alias("total"), F.when(n == 0, 100.0).otherwise(ok * 100.0 / n).alias("percent"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def report(results: DataFrame, checks: DataFrame | None = None, figures: DataFrame | None = None) -> str:
    """A Markdown report of scenario results (scenario, passed and, if there, duration_ms and details), of checks of keys
    over nodes (key, node_id, value, consistent) and of measured figures (metric, value, unit). All are few."""
    total = summary(results).first()
    verdict = "strictly consistent" if total["all_passed"] else "violations found"
    lines = [f"{total['passed']} of {total['total']} passed ({total['percent']:.0f} %): {verdict}", "", "| scenario | result | ms | details |", "|---|---|---|---|"]
    for r in results.orderBy("scenario").collect():
        row = r.asDict()
        lines.append(f"| {row['scenario']} | {'pass' if row['passed'] else 'FAIL'} | {row.get('duration_ms', '')} | {row.get('details', '')} |")
    if checks is not None:
        lines += ["", "| key | values | consistent |", "|---|---|---|"]
        values = F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "node_id", "value"))), ", ")
        for r in checks.groupBy("key").agg(values.alias("v"), F.bool_and("consistent").alias("c")).orderBy("key").collect():
            lines.append(f"| {r['key']} | {r['v']} | {'yes' if r['c'] else 'NO'} |")
    if figures is not None:
        lines += ["", "| metric | value | unit |", "|---|---|---|", *(f"| {r['metric']} | {r['value']:.2f} | {r['unit']} |" for r in figures.orderBy("metric").collect())]
    return "\n".join(lines) + "\n"
