"""Queries over replicated logs, segments, replica status and votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import commands as C
from ..operators import logs as L
from ..operators.strides import sum_before
from ..shared import settle
from . import bases as B
from .bases import sql, table

CATALOG: dict = {}


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def wal_log(spark, sf):
    """Log records in file order; some rewind and overwrite what was there."""
    k = F.col("k")
    back = F.when(k % 7 == 0, k % 5).otherwise(0)
    w = Window.partitionBy("_s").orderBy("event_id")
    rows = B.raw(spark, sf).select("event_id", k, back.alias("back"), F.floor(F.col("event_id") / 4096).alias("_s"))
    base = sum_before(rows.groupBy("_s").agg(F.sum("back").alias("n")), [], "_s", "n", "base").drop("n")
    run = F.sum("back").over(w) + F.col("base")
    return rows.join(base, "_s").select(F.col("event_id").alias("pos"), F.greatest(F.lit(1), F.col("event_id") + 1 - run).alias("idx"), (1 + F.floor(F.col("event_id") / 2000)).alias("term"), (F.col("k") == 42).alias("hard_state"))


WAL = B.RAW + """, wal AS (SELECT event_id AS pos, greatest(1, CAST(event_id + 1 - sum(CASE WHEN k % 7 = 0 THEN k % 5 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT)) AS idx, 1 + event_id // 2000 AS term, k = 42 AS hard_state FROM raw),
kept AS (SELECT pos, idx, term FROM (SELECT *, min(idx) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM wal) WHERE later IS NULL OR later > idx)"""

add("log_replay", lambda s, d: L.replay(wal_log(s, d)).select("pos", "idx", "term"), sql(WAL, "SELECT pos, idx, term FROM kept"))


def log_gaps(spark, sf):
    """Gaps that a filtered log shows: entries of some terms are missing."""
    return L.gaps(L.replay(wal_log(spark, sf)).where("idx % 97 NOT IN (3, 4, 50)"), stride=1000).select("idx", "previous")


add("log_gaps", log_gaps, sql(WAL, """SELECT idx, previous FROM (SELECT idx, lag(idx) OVER (ORDER BY idx) AS previous FROM kept WHERE idx % 97 NOT IN (3, 4, 50)) WHERE idx - previous <> 1"""))


def segments(spark, sf, log=None):
    c = B.cmds(spark, sf) if log is None else log
    return c.groupBy("shard", (F.floor(F.col("log_index") / 500) + 1).alias("seq")).agg(F.min("log_index").alias("tag"), F.sum(F.octet_length("key")).alias("bytes"))


SEGMENTS = B.CMDS + ", segments AS (SELECT shard, log_index // 500 + 1 AS seq, min(log_index) AS tag, CAST(sum(octet_length(encode(key))) AS BIGINT) AS bytes FROM cmds GROUP BY 1, 2)"
add("wal_size", lambda s, d: segments(s, d).groupBy("shard").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes")), sql(SEGMENTS, "SELECT shard, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes FROM segments GROUP BY shard"))
SNAPSHOT_AT = 1200


def wal_gc_candidates(spark, sf):
    """Segments wholly below a snapshot: the next one begins at or before the index after it."""
    following = F.lead("tag").over(Window.partitionBy("shard").orderBy("seq"))
    return segments(spark, sf).withColumn("next_tag", following).where(F.col("next_tag") <= SNAPSHOT_AT + 1).select("shard", "seq", "tag", "next_tag")


add("wal_gc_candidates", wal_gc_candidates, sql(SEGMENTS, f"""SELECT shard, seq, tag, next_tag FROM (SELECT *, lead(tag) OVER (PARTITION BY shard ORDER BY seq) AS next_tag FROM segments) WHERE next_tag <= {SNAPSHOT_AT} + 1"""))


def newest_snapshot(spark, sf):
    """Snapshot files by name: fixed-width hex sorts as numbers."""
    s = segments(spark, sf).select(F.concat(F.lit("snap-"), X.hex16("tag"), F.lit("-"), F.col("shard")).alias("name"), "shard", "tag")
    return s.groupBy("shard").agg(F.max_by("name", "name").alias("name"), F.max_by("tag", "name").alias("last_included"))


add("newest_snapshot", newest_snapshot, sql(SEGMENTS, "SELECT shard, max('snap-' || lpad(lower(to_hex(tag)), 16, '0') || '-' || shard) AS name, max(tag) AS last_included FROM segments GROUP BY shard"))


def applied_entries(spark, sf):
    """Entries that reach the state machine: no-ops do not."""
    return wal_log(spark, sf).where(~F.col("hard_state")).groupBy("term").agg(F.count("*").alias("entries"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


add("applied_entries", applied_entries, sql(WAL, "SELECT term, count(*) AS entries, min(idx) AS first_idx, max(idx) AS last_idx FROM wal WHERE NOT hard_state GROUP BY term"))

REPLICAS = 5
#: A stretch that diverges in every so many entries, and what the fifth replica lacks at the end.
PERIOD, DIVERGES, MISSING = 2000, (1200, 1299), 300


def replica_log(spark, sf):
    """Five replicas of one log, an entry an event; the fourth diverges over a stretch of every
    ``PERIOD`` entries, the fifth stops early."""
    i = F.col("idx")
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id") + 1).scalar()
    rows = events.select((F.col("event_id") + 1).alias("idx")).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1))))
    term = 1 + F.floor(i / 500) - ((F.col("replica") == 3) & (i % PERIOD).between(*DIVERGES)).cast("int")
    return rows.where((F.col("replica") != 4) | (i <= last - MISSING)).select("replica", "idx", term.cast("bigint").alias("term"), F.concat(F.lit("req-"), i).alias("request"))


REPLICA = f"""replica_log AS (SELECT CAST(r.replica AS INTEGER) AS replica, e.event_id + 1 AS idx, 1 + (e.event_id + 1) // 500 - CASE WHEN r.replica = 3 AND (e.event_id + 1) % {PERIOD} BETWEEN {DIVERGES[0]} AND {DIVERGES[1]} THEN 1 ELSE 0 END AS term, 'req-' || (e.event_id + 1) AS request
FROM events e, range({REPLICAS}) r(replica) WHERE r.replica <> 4 OR e.event_id + 1 <= (SELECT max(event_id) + 1 FROM events) - {MISSING})"""


def replica_divergence(spark, sf):
    """Positions at which a replica differs from the leader's log, or lacks it."""
    log = replica_log(spark, sf)
    lead = log.where("replica = 0").select("idx", F.col("term").alias("leader_term"))
    others = lead.withColumn("replica", F.explode(F.array(*[F.lit(r) for r in range(1, REPLICAS)])))
    both = others.join(log.where("replica > 0").select("replica", "idx", "term"), ["replica", "idx"], "full")
    return both.where(~F.col("term").eqNullSafe(F.col("leader_term"))).select("replica", "idx", "leader_term", "term")


add("replica_divergence", replica_divergence, sql(REPLICA, f"""SELECT CAST(r.replica AS INTEGER) AS replica, l.idx, l.term AS leader_term, o.term FROM (SELECT * FROM replica_log WHERE replica = 0) l, range(1, {REPLICAS}) r(replica)
LEFT JOIN replica_log o ON o.replica = r.replica AND o.idx = l.idx WHERE o.term IS DISTINCT FROM l.term"""))


def log_conflicts(spark, sf):
    """First conflicting index of each replica with the leader."""
    return replica_divergence(spark, sf).where("term IS NOT NULL").groupBy("replica").agg(F.min("idx").alias("first_conflict"), F.count("*").alias("conflicts"))


add("log_conflicts", log_conflicts, sql(REPLICA, """SELECT o.replica, min(o.idx) AS first_conflict, count(*) AS conflicts FROM replica_log o JOIN replica_log l ON l.replica = 0 AND l.idx = o.idx AND l.term <> o.term GROUP BY o.replica"""))
add(
    "term_bounds",
    lambda s, d: replica_log(s, d).groupBy("replica", "term").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")),
    sql(REPLICA, "SELECT replica, term, min(idx) AS first_idx, max(idx) AS last_idx FROM replica_log GROUP BY replica, term"),
)


def next_index(spark, sf):
    """Where a leader resumes after a refusal: before the hint, never past the log, never below 1."""
    last = replica_log(spark, sf).groupBy("replica").agg(F.max("idx").alias("last"), F.min(F.when(F.col("term") == 2, F.col("idx"))).alias("hint"))
    return last.select("replica", "last", F.greatest(F.lit(1).cast("bigint"), F.least(F.coalesce("hint", F.lit(0)), F.col("last") + 1)).alias("next"))


add("next_index", next_index, sql(REPLICA, "SELECT replica, last, greatest(1, least(coalesce(hint, 0), last + 1)) AS next FROM (SELECT replica, max(idx) AS last, min(idx) FILTER (WHERE term = 2) AS hint FROM replica_log GROUP BY replica)"))


def lost_writes(spark, sf):
    """Acknowledged requests that a replica never applied."""
    log = replica_log(spark, sf)
    return log.where("replica = 0").select("request").subtract(log.where("replica = 4").select("request"))


add("lost_writes", lost_writes, sql(REPLICA, "SELECT request FROM replica_log WHERE replica = 0 EXCEPT SELECT request FROM replica_log WHERE replica = 4"))


def phantom_writes(spark, sf):
    """Requests of entries that lost their term, yet appear in the leader's log under another."""
    log = replica_log(spark, sf)
    return replica_divergence(spark, sf).where("term IS NOT NULL").select(F.concat(F.lit("req-"), "idx").alias("request")).intersect(log.where("replica = 0").select("request"))


add("phantom_writes", phantom_writes, sql(REPLICA, """SELECT o.request FROM replica_log o JOIN replica_log l ON l.replica = 0 AND l.idx = o.idx AND l.term <> o.term INTERSECT SELECT request FROM replica_log WHERE replica = 0"""))


def proposal_outcomes(spark, sf):
    """Proposals waiting on replica 3 against what the leader has applied, all but the last hundred
    entries: same term committed, another lost."""
    log = replica_log(spark, sf)
    mine = log.where("replica = 3").select("idx", F.col("term").alias("proposed"))
    last = table(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    lead = log.where((F.col("replica") == 0) & (F.col("idx") <= last - 100)).select("idx", "term")
    out = F.when(F.col("term").isNull(), "unknown").when(F.col("term") == F.col("proposed"), "committed").otherwise("lost")
    return mine.join(lead, "idx", "left").groupBy("proposed", out.alias("outcome")).agg(F.count("*").alias("n"))


add("proposal_outcomes", proposal_outcomes, sql(REPLICA, """SELECT m.term AS proposed, CASE WHEN l.term IS NULL THEN 'unknown' WHEN l.term = m.term THEN 'committed' ELSE 'lost' END AS outcome, count(*) AS n
FROM replica_log m LEFT JOIN (SELECT * FROM replica_log WHERE replica = 0 AND idx <= (SELECT max(event_id) + 1 FROM events) - 100) l ON l.idx = m.idx WHERE m.replica = 3 GROUP BY 1, 2"""))


PEERS = 9


def status(spark, sf, log=None):
    """shard, last index and a map of peers to match indexes; three shards of three peers, a fixed cluster."""
    # indexes are dense, so the last is the count, which needs no positions
    last = (B.unplaced(spark, sf) if log is None else log).groupBy("shard").agg(F.count("*").alias("last"))
    p = F.col("id")
    peers = spark.range(PEERS).select((F.floor(p / 3)).cast("int").alias("shard"), F.concat(F.lit("n"), p % 3 + 1).alias("peer"), (p * 37 % 100).alias("behind"))
    rows = last.join(peers, "shard").select("shard", "last", "peer", (F.col("last") - F.col("behind")).alias("match"))
    return rows.groupBy("shard", "last").agg(F.map_from_entries(F.collect_list(F.struct("peer", "match"))).alias("match_index"))


STATUS = B.CMDS + f""", lasts AS (SELECT shard, count(*) AS last FROM cmds GROUP BY shard),
status AS (SELECT l.shard, l.last, concat('n', p % 3 + 1) AS peer, l.last - p * 37 % 100 AS match FROM lasts l JOIN range({PEERS}) peers(p) ON p // 3 = l.shard)"""


def quorum_commit_index(spark, sf):
    return status(spark, sf).select("shard", L.quorum_index(F.map_values("match_index")).alias("commit"), L.quorum(F.size(F.map_keys("match_index"))).alias("quorum"))


add("quorum_commit_index", quorum_commit_index, sql(STATUS, "SELECT shard, list_sort(list(match))[count(*) - (count(*) // 2 + 1) + 1] AS commit, CAST(count(*) // 2 + 1 AS INTEGER) AS quorum FROM status GROUP BY shard"))


def quorum_health(spark, sf):
    """Whether a quorum has acknowledged within 60 entries of the end."""
    recent = F.size(F.filter(F.map_values("match_index"), lambda m: m >= F.col("last") - 60))
    return status(spark, sf).select("shard", recent.alias("recent"), (recent >= L.quorum(F.size(F.map_keys("match_index")))).alias("healthy"))


add("quorum_health", quorum_health, sql(STATUS, "SELECT shard, CAST(count(*) FILTER (WHERE match >= last - 60) AS INTEGER) AS recent, count(*) FILTER (WHERE match >= last - 60) >= count(*) // 2 + 1 AS healthy FROM status GROUP BY shard"))
add(
    "replication_lag",
    lambda s, d: status(s, d).select("shard", "last", F.explode("match_index").alias("peer", "match")).select("shard", "peer", (F.col("last") - F.col("match")).alias("lag")),
    sql(STATUS, "SELECT shard, peer, last - match AS lag FROM status"),
)


def match_progress(spark, sf):
    """Match indexes as replies arrive out of order: never going back."""
    replies = B.raw(spark, sf).select(F.col("user_id").alias("peer"), "event_id", (F.col("event_id") * 3 + F.col("k") * 17 % 400).alias("reply"))
    upto = F.max("reply").over(Window.partitionBy("peer").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return replies.withColumn("match", upto)


add("match_progress", match_progress, sql(B.RAW, "SELECT user_id AS peer, event_id, event_id * 3 + k * 17 % 400 AS reply, max(event_id * 3 + k * 17 % 400) OVER (PARTITION BY user_id ORDER BY event_id) AS match FROM raw"))
MAX_LAG = 64


def rebalance_candidates(spark, sf):
    """Shards led by another than the preferred peer, which has caught up enough to take over."""
    preferred = F.concat(F.lit("n"), F.col("shard") % 3 + 1)
    s = status(spark, sf).select("shard", "last", F.lit("n1").alias("leader"), preferred.alias("preferred"), F.element_at("match_index", preferred).alias("match"))
    return s.where((F.col("leader") != F.col("preferred")) & (F.col("last") - F.col("match") <= MAX_LAG)).select("shard", "leader", "preferred", (F.col("last") - F.col("match")).alias("lag"))


add("rebalance_candidates", rebalance_candidates, sql(STATUS, f"SELECT shard, 'n1' AS leader, peer AS preferred, last - match AS lag FROM status WHERE peer = concat('n', shard % 3 + 1) AND peer <> 'n1' AND last - match <= {MAX_LAG}"))


def shard_status(spark, sf):
    """One row a shard: live keys, log bytes, positions and leader.  The log is placed once and read thrice."""
    log = settle(B.cmds(spark, sf), "commands")
    records = C.state(C.fold(C.executed(C.with_anchors(log, B.DEDUP))))
    keys = records.groupBy("shard").agg(F.count_if(~F.col("deleted")).alias("keys"))
    wal = segments(spark, sf, log).groupBy("shard").agg(F.sum("bytes").alias("wal_bytes"))
    commit = status(spark, sf, log).select("shard", "last", L.quorum_index(F.map_values("match_index")).alias("commit"))
    return commit.join(keys, "shard").join(wal, "shard").select("shard", F.concat(F.lit("n"), F.col("shard") % 3 + 1).alias("leader"), "last", "commit", "keys", "wal_bytes")


add("shard_status", shard_status, sql(B.STATE + SEGMENTS[len(B.CMDS):] + STATUS[len(B.CMDS):], """SELECT l.shard, concat('n', l.shard % 3 + 1) AS leader, l.last,
 (SELECT list_sort(list(match))[count(*) - (count(*) // 2 + 1) + 1] FROM status s WHERE s.shard = l.shard) AS commit,
 (SELECT count(*) FROM state s WHERE s.shard = l.shard AND NOT deleted) AS keys, (SELECT CAST(sum(bytes) AS BIGINT) FROM segments s WHERE s.shard = l.shard) AS wal_bytes FROM lasts l"""))


def votes(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.floor(c / 5).alias("term"), (c % 5).alias("voter"), (F.col("c_acctbal") > 4000).alias("granted"))


def election_outcome(spark, sf):
    """A candidate's own vote and those granted, against the quorum of six."""
    won = F.count_if("granted") + 1
    return votes(spark, sf).groupBy("term").agg(won.alias("votes"), (won >= 4).alias("elected"))


_VOTES = "votes AS (SELECT c_custkey // 5 AS term, c_custkey % 5 AS voter, c_acctbal > 4000 AS granted FROM customer)"
add("election_outcome", election_outcome, sql(_VOTES, "SELECT term, count(*) FILTER (WHERE granted) + 1 AS votes, count(*) FILTER (WHERE granted) + 1 >= 4 AS elected FROM votes GROUP BY term"))


def split_brain_check(spark, sf):
    """Terms with more than one leader; leaders are made of orders, so some terms have two."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 3000).alias("term"), (F.col("o_custkey") % 3).alias("node"))
    return o.groupBy("term").agg(F.countDistinct("node").alias("leaders")).where("leaders > 1")


add("split_brain_check", split_brain_check, "SELECT o_orderkey % 3000 AS term, count(DISTINCT o_custkey % 3) AS leaders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(DISTINCT o_custkey % 3) > 1")


def vote_eligibility(spark, sf):
    """Candidates whose log is as new as each replica's: the later term, then the longer log.

    A candidate's log ends somewhere in the leader's, some of them past it.
    """
    tip = replica_log(spark, sf).groupBy("replica").agg(F.max(F.struct("term", "idx")).alias("tip"))
    last = table(spark, sf, "events").agg(F.max("event_id") + 501).scalar()
    idx = 1 + F.col("c_custkey") * 53 % last
    candidates = table(spark, sf, "customer").select("c_custkey", (1 + F.floor(idx / 500)).alias("term"), idx.alias("idx"))
    asked = candidates.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1))))
    # one row a replica
    return asked.join(F.broadcast(tip), "replica").select("c_custkey", "replica", X.up_to_date(F.col("term"), F.col("idx"), F.col("tip.term"), F.col("tip.idx")).alias("eligible"))


add("vote_eligibility", vote_eligibility, sql(REPLICA, """SELECT c_custkey, replica, (1 + c.idx // 500, c.idx) >= (t.term, t.idx) AS eligible FROM
(SELECT c_custkey, 1 + c_custkey * 53 % (SELECT max(event_id) + 501 FROM events) AS idx FROM customer) c,
(SELECT replica, max(term) AS term, max(idx) FILTER (WHERE term = m) AS idx FROM (SELECT *, max(term) OVER (PARTITION BY replica) AS m FROM replica_log) GROUP BY replica) t"""))

ROUND = 5


def commit_advance(spark, sf):
    """A leader's commit index after each round of replies: the index that a quorum holds, if it is
    beyond the old one and its entry is of the leader's own term; else the old one.

    Five replies make a round, the leader's term and the old commit index go with it.
    """
    r, e = F.col("round"), F.col("event_id")
    replies = B.raw(spark, sf).select(F.floor(e / ROUND).alias("round"), (F.floor(e / ROUND) * 3 + F.col("k") * 4).alias("match"))
    rounds = replies.groupBy("round").agg(L.quorum_index(F.collect_list("match")).alias("candidate"))
    old, own = r * 3 + 150, 1 + F.floor((r * 3 + 200) / 400)
    judged = rounds.select("round", old.alias("old"), "candidate", (1 + F.floor(F.col("candidate") / 400)).alias("entry_term"), own.alias("own_term"))
    return judged.withColumn("commit", L.advanced_commit(F.col("candidate"), F.col("old"), F.col("entry_term"), F.col("own_term")))


add("commit_advance", commit_advance, sql(B.RAW, f"""SELECT *, CASE WHEN candidate > old AND entry_term = own_term THEN candidate ELSE old END AS commit FROM (
SELECT round, round * 3 + 150 AS old, candidate, 1 + candidate // 400 AS entry_term, 1 + (round * 3 + 200) // 400 AS own_term FROM (
SELECT event_id // {ROUND} AS round, list_sort(list(event_id // {ROUND} * 3 + k * 4))[count(*) - (count(*) // 2 + 1) + 1] AS candidate FROM raw GROUP BY 1))"""))
