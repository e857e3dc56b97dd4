"""Replicated logs as tables (node_id, index, term, cmd, key, value columns): commit, apply, conflict, votes, reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ordered import as_of, numbered

#: Proposals that are written as one batch, and the share of the shortest election timeout that a lease lasts. Fixed values.
GROUP_COMMIT = 128
LEASE_SHARE = 0.8


def quorum(n_nodes: Column | int) -> Column:
    return F.floor((n_nodes if isinstance(n_nodes, Column) else F.lit(n_nodes)) / 2) + 1


def log_slice(log: DataFrame, start: int) -> DataFrame:
    return log.filter(F.col("index") >= max(start, 1))


def truncated(log: DataFrame, start: int) -> DataFrame:
    """The log before ``start``."""
    return log.filter(F.col("index") < start)


def terms_at(indexes: DataFrame, log: DataFrame) -> DataFrame:
    """index, term of each asked index; 0 outside the log."""
    return indexes.join(log.select("index", "term"), "index", "left").select("index", F.coalesce("term", F.lit(0)).cast("bigint").alias("term"))


def replicas(log: DataFrame) -> DataFrame:
    """node_id, last_index, last_term."""
    return log.groupBy("node_id").agg(F.max("index").alias("last_index"), F.max_by("term", "index").alias("last_term"))


def match_indexes(log: DataFrame, leader: str) -> DataFrame:
    """node_id, last_index, match_index: how far each replica agrees with the leader's log, entry by entry from the start.

    Both sides are joined on the index by shuffle, as either log is long; what is left is a row per node.
    """
    of_leader = log.filter(F.col("node_id") == leader).select("index", F.col("term").alias("_term"))
    both = log.select("node_id", "index", "term").join(of_leader, "index", "left")
    wrong = F.min(F.when(F.col("_term").isNull() | (F.col("_term") != F.col("term")), F.col("index")))
    return both.groupBy("node_id").agg(F.max("index").alias("last_index"), F.coalesce(wrong - 1, F.max("index")).alias("match_index"))


def commit_index(log: DataFrame, leader: str, committed: int = 0, n_nodes: int | None = None) -> DataFrame:
    """commit_index: the largest index of the leader's current term up to which a majority agrees with the leader;
    ``committed`` if there is none beyond it. n_nodes: members of the cluster, if some of them have no entry."""
    held = F.sort_array(F.collect_list("match_index"), asc=False)
    reach = match_indexes(log, leader).agg(F.get(held, quorum(F.count(F.lit(1)) if n_nodes is None else n_nodes).cast("int") - 1).alias("_held"))
    own = log.filter(F.col("node_id") == leader)
    term = own.agg(F.max_by("term", "index").alias("_term"))
    own = own.join(F.broadcast(reach)).join(F.broadcast(term))  # one row each
    ok = (F.col("index") <= F.col("_held")) & (F.col("term") == F.col("_term")) & (F.col("index") > committed)
    return own.agg(F.coalesce(F.max(F.when(ok, F.col("index"))), F.lit(committed)).cast("bigint").alias("commit_index"))


def applied(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Per node the live keys after its committed puts and deletes in index order; other commands do nothing."""
    verbs = log.filter(F.upper("cmd").isin("PUT", "DELETE") & (F.lit(True) if upto is None else F.col("index") <= upto))
    best = verbs.groupBy("node_id", "key").agg(F.max_by(F.struct("index", F.upper("cmd").alias("cmd"), "v_double"), "index").alias("v"))
    return best.filter("v.cmd = 'PUT'").select("node_id", "key", F.col("v.index").alias("index"), F.col("v.v_double").alias("v_double"))


def applied_to_commit(log: DataFrame, leader: str) -> DataFrame:
    """``applied`` up to the commit index that the log itself gives for this leader."""
    upto = commit_index(log, leader)  # one row
    return applied(log.join(F.broadcast(upto)).filter(F.col("index") <= F.col("commit_index")).drop("commit_index"))


def consistency(state: DataFrame, nodes: list[str]) -> DataFrame:
    """key, n_values, consistent: whether all nodes hold the same value; a node without the key differs."""
    seen = state.groupBy("key").agg(F.countDistinct("v_double").alias("n_values"), F.countDistinct("node_id").alias("_nodes"))
    return seen.select("key", "n_values", ((F.col("n_values") == 1) & (F.col("_nodes") == len(nodes))).alias("consistent"))


def values_by_node(state: DataFrame, keys: DataFrame, nodes: list[str]) -> DataFrame:
    """node_id, key, value of each key on each node, 'OFFLINE' where a node has none."""
    grid = keys.select("key").distinct().withColumn("node_id", F.explode(F.array(*map(F.lit, nodes))))
    return grid.join(state, ["node_id", "key"], "left").select("node_id", "key", F.coalesce(F.col("v_double").cast("string"), F.lit("OFFLINE")).alias("value"))


def first_conflict(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """conflict_index: the first index on which both logs have an entry of another term; null if there is none."""
    both = local.select("index", F.col("term").alias("_a")).join(incoming.select("index", F.col("term").alias("_b")), "index")
    return both.agg(F.min(F.when(F.col("_a") != F.col("_b"), F.col("index"))).alias("conflict_index"))


def accepts(local: DataFrame, incoming: DataFrame, prev_index: int, prev_term: int) -> DataFrame:
    """accepted: whether a node takes entries that follow on prev_index. Its log has to have that entry with that term
    (0 is the start of every log), and the entries have to follow one another from there without a gap."""
    known = F.lit(prev_index == 0) if prev_index <= 0 else F.coalesce(F.bool_or((F.col("index") == prev_index) & (F.col("term") == prev_term)), F.lit(False))
    known = local.agg(known.alias("_known"))
    last, n = F.coalesce(F.max("index"), F.lit(prev_index)), F.countDistinct("index")
    closed = incoming.agg(((last - prev_index == n) & (F.coalesce(F.min("index"), F.lit(prev_index + 1)) == prev_index + 1)).alias("_closed"))
    return known.join(F.broadcast(closed)).select((F.col("_known") & F.col("_closed")).alias("accepted"))


def reconciled(local: DataFrame, incoming: DataFrame, prev_index: int, prev_term: int) -> DataFrame:
    """The local log after an append on prev_index: cut where the first conflict is, then what it lacks of the incoming
    entries. A refused append changes nothing."""
    verdict = F.broadcast(accepts(local, incoming, prev_index, prev_term).join(first_conflict(local, incoming)))  # one row
    own = local.join(verdict)
    kept = own.filter(~F.col("accepted") | F.col("conflict_index").isNull() | (F.col("index") < F.col("conflict_index"))).select(*local.columns)
    new = incoming.join(verdict).filter("accepted").join(kept.select("index"), "index", "left_anti")
    return kept.unionByName(new.select(*local.columns))


def follower_commit(local: DataFrame, incoming: DataFrame, prev_index: int, prev_term: int, leader_commit: int, committed: int = 0) -> DataFrame:
    """accepted, last_index, commit_index of a follower after an append: what the leader has committed, as far as the
    follower's log goes. It never goes back, and a refused append leaves it."""
    after = reconciled(local, incoming, prev_index, prev_term).agg(F.coalesce(F.max("index"), F.lit(0)).cast("bigint").alias("last_index"))
    out = accepts(local, incoming, prev_index, prev_term).join(F.broadcast(after))
    commit = F.when(F.col("accepted"), F.greatest(F.lit(committed), F.least(F.lit(leader_commit), F.col("last_index")))).otherwise(F.lit(committed))
    return out.select("accepted", "last_index", commit.cast("bigint").alias("commit_index"))


def took_office(log: DataFrame, leader: str) -> DataFrame:
    """node_id, next_index, match_index that a new leader assumes of each of its peers."""
    last = log.filter(F.col("node_id") == leader).agg(F.coalesce(F.max("index"), F.lit(0)).alias("_last"))
    peers = log.filter(F.col("node_id") != leader).select("node_id").distinct()
    return peers.join(F.broadcast(last)).select("node_id", (F.col("_last") + 1).cast("bigint").alias("next_index"), F.lit(0).cast("bigint").alias("match_index"))


def replication_trace(log: DataFrame, leader: str) -> DataFrame:
    """node_id, round, prev_index, success, match_index: how a new leader finds each peer's log. It offers entries after
    prev_index, first its last one; a refusal steps back by one, and a success brings the peer up to the leader's end.

    The place where a peer first agrees is the largest index that both have with one term, 0 if there is none.
    """
    of_leader = log.filter(F.col("node_id") == leader).select("index", F.col("term").alias("_term"))
    both = log.filter(F.col("node_id") != leader).select("node_id", "index", "term").join(of_leader, "index", "left")
    found = both.groupBy("node_id").agg(F.coalesce(F.max(F.when(F.col("term") == F.col("_term"), F.col("index"))), F.lit(0)).alias("_agrees"))
    last = of_leader.agg(F.coalesce(F.max("index"), F.lit(0)).alias("_last"))
    steps = found.join(F.broadcast(last)).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("_last") - F.col("_agrees"))))
    prev = F.col("_last") - F.col("round")
    success = prev == F.col("_agrees")
    return steps.select("node_id", F.col("round").cast("bigint").alias("round"), prev.cast("bigint").alias("prev_index"), success.alias("success"), F.when(success, F.col("_last")).otherwise(F.lit(0)).cast("bigint").alias("match_index"))


def proposed(proposals: DataFrame, nodes: DataFrame, last_index: int, batch: int = GROUP_COMMIT) -> DataFrame:
    """proposals (proposal_no, node_id, ...) with accepted, index and batch_no. Only a leader (nodes: node_id, role) takes
    them, in order of their number, after its last index; ``batch`` of them at a time are written together."""
    taken = proposals.join(F.broadcast(nodes.select("node_id", (F.col("role") == "LEADER").alias("accepted"))), "node_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    of_leader = numbered(taken.filter("accepted"), "proposal_no", out="_no")
    of_leader = of_leader.withColumn("index", last_index + F.col("_no")).withColumn("batch_no", F.floor((F.col("_no") - 1) / batch)).drop("_no")
    others = taken.filter(~F.col("accepted"))
    return of_leader.unionByName(others.withColumn("index", F.lit(None).cast("bigint")).withColumn("batch_no", F.lit(None).cast("bigint")))


def votes(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Decisions on vote requests (candidate, term, last_term, last_index) by nodes (node_id, current_term, voted_for,
    last_term, last_index): a stale term or an older log is refused, as is a second vote in a term."""
    r, s = requests.alias("r"), states.alias("s")
    newer = F.col("r.term") > F.col("s.current_term")
    free = newer | F.col("s.voted_for").isNull() | (F.col("s.voted_for") == F.col("r.candidate"))
    current = F.struct(F.col("r.last_term"), F.col("r.last_index")) >= F.struct(F.col("s.last_term").alias("last_term"), F.col("s.last_index").alias("last_index"))
    granted = (F.col("r.term") >= F.col("s.current_term")) & free & current
    return r.join(F.broadcast(s)).select(F.col("r.candidate").alias("candidate"), F.col("r.term").alias("term"), F.col("s.node_id").alias("node_id"), granted.alias("granted"))


def elections(decisions: DataFrame, n_nodes: int) -> DataFrame:
    """candidate, term, n_votes, elected; a vote counts once per node."""
    n = F.countDistinct(F.when(F.col("granted"), F.col("node_id")))
    return decisions.groupBy("candidate", "term").agg(n.alias("n_votes")).withColumn("elected", F.col("n_votes") >= quorum(n_nodes))


def observed_terms(messages: DataFrame) -> DataFrame:
    """node_id, term: the highest term each node has seen, as of (node_id, term)."""
    return messages.groupBy("node_id").agg(F.max("term").alias("term"))


def step_downs(messages: DataFrame) -> DataFrame:
    """messages (node_id, msg_no, term) with current_term, the node's term after each, and steps_down: whether it became a
    follower by it, with its vote and its lease cleared, because the term was higher than any before."""
    before = Window.partitionBy("node_id").orderBy("msg_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("term").over(before), F.lit(0))
    return messages.withColumn("current_term", F.greatest(seen, "term")).withColumn("steps_down", F.col("term") > seen)


def settled(proposals: DataFrame, messages: DataFrame, commit: int) -> DataFrame:
    """proposals (node_id, msg_no, index) with outcome: committed up to the commit index, else failed if the node stepped
    down after it, else pending."""
    last = step_downs(messages).filter("steps_down").groupBy("node_id").agg(F.max("msg_no").alias("_down"))
    outcome = F.when(F.col("index") <= commit, "committed").when(F.col("_down") > F.col("msg_no"), "failed").otherwise("pending")
    return proposals.join(last, "node_id", "left").withColumn("outcome", outcome).drop("_down")


def status(log: DataFrame, commit: int | DataFrame) -> DataFrame:
    """The log with is_committed; commit: an index, or the one row that commit_index gives."""
    if isinstance(commit, DataFrame):
        return log.join(F.broadcast(commit)).withColumn("is_committed", F.col("index") <= F.col("commit_index")).drop("commit_index")
    return log.withColumn("is_committed", F.col("index") <= commit)


def read_modes(reads: DataFrame) -> DataFrame:
    """mode of each read (read_ts, lease_expiry, is_leader): only a leader answers, within its lease at once and
    otherwise after a round of acknowledgements."""
    mode = F.when(~F.col("is_leader"), "error").when(F.col("read_ts") < F.col("lease_expiry"), "lease").otherwise("read_index")
    return reads.withColumn("mode", mode)


def lease_expiry(confirmed_at: Column, least_timeout: int = 150) -> Column:
    """When a lease ends that a majority confirmed at a time (ms)."""
    return confirmed_at + int(LEASE_SHARE * least_timeout)


def confirmed(acks: DataFrame, n_nodes: int) -> DataFrame:
    """round, confirmed: whether the leader and those who answered (round, peer, success) are a majority."""
    return acks.groupBy("round").agg((F.count_if("success") + 1 >= quorum(n_nodes)).alias("confirmed"))


def values_at(reads: DataFrame, log: DataFrame) -> DataFrame:
    """reads (read_no, key, at_index) with value, as a put or delete of one node's log left it at that index; null where
    the key wasn't there. Both are sorted by key and index over ranges, so that a hot key is shared out."""
    verbs = log.filter(F.upper("cmd").isin("PUT", "DELETE")).select(F.struct("key", F.col("index").alias("at")).alias("_place"), "v_double", F.upper("cmd").alias("_cmd"))
    probes = reads.withColumn("_probe_at", F.struct("key", F.col("at_index").cast("bigint").alias("at")))
    found = as_of(probes, verbs.withColumn("_version", F.col("_place")), "_probe_at", "_place", ["_version", "v_double", "_cmd"])
    hit = (F.col("_version.key") == F.col("key")) & (F.col("_version.at") <= F.col("at_index")) & (F.col("_cmd") == "PUT")
    return found.select(*reads.columns, F.when(hit, F.col("v_double")).alias("value"))


def linearizable_reads(reads: DataFrame, log: DataFrame, commit: DataFrame) -> DataFrame:
    """reads (read_no, key, read_mode, is_leader, in_lease, confirmed, barrier_index) with served (how: lease, read_index,
    barrier or error) and value.

    Only a leader answers. A lease read is served at once within the lease and else as a read_index one, which needs the
    majority's confirmation; both see the log up to the commit index (commit: one row). A barrier read sees it up to the
    barrier's own entry, once that is committed.
    """
    reads = reads.join(F.broadcast(commit))
    lease = (F.col("read_mode") == "lease") & F.col("in_lease")
    barrier = (F.col("read_mode") == "barrier") & (F.col("barrier_index") <= F.col("commit_index"))
    indexed = (F.col("read_mode") != "barrier") & F.col("confirmed")
    served = F.when(~F.col("is_leader"), "error").when(lease, "lease").when(indexed, "read_index").when(barrier, "barrier").otherwise("error")
    at = F.when(served == "barrier", F.col("barrier_index")).when(served != "error", F.col("commit_index")).otherwise(0)
    asked = reads.select("read_no", "key", served.alias("served"), at.cast("bigint").alias("at_index"))
    return values_at(asked, log).select("read_no", "key", "served", "value")


def local_reads(reads: DataFrame, log: DataFrame, applied_to: DataFrame) -> DataFrame:
    """reads (read_no, key, node_id) answered by the node itself, leader or not, from what it has applied (applied_to:
    node_id, applied_index): node by node possibly stale."""
    places = reads.join(F.broadcast(applied_to.select("node_id", F.col("applied_index").alias("at_index"))), "node_id")
    of_node = lambda c: F.concat_ws("\x00", "node_id", c)
    out = values_at(places.withColumn("_key", F.col("key")).withColumn("key", of_node("_key")), log.withColumn("key", of_node("key")))
    return out.select("read_no", F.col("_key").alias("key"), "node_id", "value")


def leader(nodes: DataFrame) -> DataFrame:
    """The first node (by name) that leads and isn't isolated."""
    return nodes.filter((F.col("role") == "LEADER") & ~F.col("is_isolated")).orderBy("node_id").limit(1)


def election_timeouts(nodes: DataFrame, least: int = 150, most: int = 300, seed: int = 0) -> DataFrame:
    """A timeout in [least, most] ms per (node_id, term), the same on every run."""
    return nodes.withColumn("timeout_ms", least + F.pmod(F.xxhash64(F.lit(seed), "node_id", "term"), F.lit(most - least + 1)))
