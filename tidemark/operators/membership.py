"""Membership news (id, incarnation, severity): merging, refutation, suspicion and gossip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIVE, SUSPECT, DEAD = 0, 1, 2
STATES = ["alive", "suspect", "dead"]
SUSPICION_TICKS, MAX_PIGGYBACK, FANOUT = 4, 6, 3


def state_name(severity: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATES)), severity)


def merge(rumours: DataFrame) -> DataFrame:
    """The winning news of each member: higher incarnation, then higher severity. Order and repeats do not matter."""
    return rumours.groupBy("id").agg(F.max(F.struct("incarnation", "severity")).alias("r")).select("id", "r.*")


def apply_news(rumours: DataFrame, self_id: str, self_incarnation: int) -> DataFrame:
    """As `merge`, but ``self_id`` refutes rumours that it is not alive: it outbids the highest of them. The member itself
    is always there, also where no rumour names it."""
    rumours = rumours.select("id", "incarnation", "severity").unionByName(rumours.sparkSession.createDataFrame([(self_id, self_incarnation, ALIVE)], "id string, incarnation bigint, severity int"))
    own = F.col("id") == self_id
    worst = F.max(F.when(own & (F.col("severity") != ALIVE), F.col("incarnation")))
    rows = rumours.groupBy("id").agg(F.max(F.struct("incarnation", "severity")).alias("r"), worst.alias("worst"))
    refuted = F.when(F.coalesce(F.col("worst"), F.lit(-1)) >= self_incarnation, F.col("worst") + 1).otherwise(F.lit(self_incarnation)).cast("bigint")
    return rows.select("id", F.when(own, refuted).otherwise(F.col("r.incarnation")).alias("incarnation"), F.when(own, ALIVE).otherwise(F.col("r.severity")).alias("severity"))


def expire(members: DataFrame, tick: int, after: int = SUSPICION_TICKS) -> DataFrame:
    """Members (id, incarnation, severity, since) at a tick: suspects of at least ``after`` ticks are dead."""
    gone = (F.col("severity") == SUSPECT) & (F.lit(tick) - F.col("since") >= after)
    return members.withColumn("severity", F.when(gone, DEAD).otherwise(F.col("severity")))


def gossip(members: DataFrame, most: int = MAX_PIGGYBACK) -> DataFrame:
    """The news to send next (id, left): most sends left first, then by id."""
    return members.where(F.col("left") > 0).orderBy(F.desc("left"), "id").limit(most)


def outgoing(members: DataFrame, self_id: str, peer: str, most: int = MAX_PIGGYBACK) -> DataFrame:
    """A message to a peer: gossip, the sender itself, and news that the peer is not alive."""
    cols = ["id", "incarnation", "severity"]
    own = members.where(F.col("id") == self_id).select(cols)
    about = members.where((F.col("id") == peer) & (F.col("severity") != ALIVE)).select(cols)
    return gossip(members, most).select(cols).unionByName(own).unionByName(about)


def suspect(members: DataFrame, failed: DataFrame, self_id: str, tick: int, fanout: int = FANOUT) -> DataFrame:
    """Members (id, incarnation, severity, since, left) after probes that failed (id): those that were alive are suspects of
    the same incarnation from this tick on, and news to send. Unknown members and ``self_id`` are not suspected."""
    bad = failed.select("id", F.lit(True).alias("_failed")).distinct()
    now = F.coalesce("_failed", F.lit(False)) & (F.col("id") != self_id) & (F.col("severity") < SUSPECT)
    changed = lambda c, v: F.when(now, F.lit(v)).otherwise(F.col(c)).cast(members.schema[c].dataType).alias(c)
    # As many rows as members, which a message can name.
    return members.join(F.broadcast(bad), "id", "left").select("id", "incarnation", changed("severity", SUSPECT), changed("since", tick), changed("left", fanout))


def gossip_round(members: DataFrame, most: int = MAX_PIGGYBACK) -> DataFrame:
    """Members after a message: the news that went with it has one send less left."""
    sent = gossip(members, most).select("id", F.lit(1).alias("_sent"))
    left = (F.col("left") - F.coalesce("_sent", F.lit(0))).cast(members.schema["left"].dataType)
    return members.join(F.broadcast(sent), "id", "left").withColumn("left", left).drop("_sent")


def random_peers(members: DataFrame, self_id: str, k: int, exclude: str | None, seed: int, round_: int = 0) -> DataFrame:
    """At most ``k`` members that are neither dead, ``self_id`` nor excluded, by a hash that changes with seed and round."""
    others = probe_order(members, self_id, seed, round_)
    return (others if exclude is None else others.where(F.col("id") != exclude)).limit(max(k, 0))


def protocol_round(members: DataFrame, links: DataFrame, self_id: str, tick: int, seed: int, relays: int = 2, after: int = SUSPICION_TICKS, fanout: int = FANOUT) -> DataFrame:
    """Members after a round of ``self_id``: suspects of long standing die, one member is probed, directly and then through a
    few relays, and is a suspect if no probe reaches it. ``links`` (src, dst) are the pairs that reach each other.

    The probed member is the first of the round's probe order; relays are random peers that the member itself reaches.
    """
    died = expire(members, tick, after)
    left = F.when((F.col("severity") == DEAD) & (F.col("_was") != DEAD), F.lit(fanout)).otherwise(F.col("left")).cast(members.schema["left"].dataType)
    members = died.join(members.select("id", F.col("severity").alias("_was")), "id").withColumn("left", left).drop("_was")
    target = probe_order(members, self_id, seed, tick).limit(1).select(F.col("id").alias("target"))
    direct = target.join(links.where(F.col("src") == self_id), F.col("target") == F.col("dst"), "left_anti")
    others = probe_order(members, self_id, seed, -tick).join(direct, F.col("id") != F.col("target")).orderBy(F.xxhash64("id", F.lit(seed), F.lit(-tick)), "id").limit(relays).select(F.col("id").alias("relay"))
    heard = others.join(links.where(F.col("src") == self_id).select(F.col("dst").alias("relay")), "relay", "left_semi")
    through = links.join(heard.withColumnRenamed("relay", "src"), "src", "left_semi")
    failed = direct.join(through.select(F.col("dst").alias("target")), "target", "left_anti").select(F.col("target").alias("id"))
    return suspect(members, failed, self_id, tick, fanout)


def known(members: DataFrame, id_: str) -> DataFrame:
    """What is known of one member: no row, or its incarnation and severity."""
    return members.where(F.col("id") == id_).select("id", "incarnation", "severity")


def negative_news(members: DataFrame, id_: str) -> DataFrame:
    return known(members, id_).where(F.col("severity") != ALIVE)


def alive_count(members: DataFrame) -> DataFrame:
    return members.agg(F.count_if(F.col("severity") == ALIVE).alias("n"))


def probe_order(members: DataFrame, self_id: str, seed: int, round_: int) -> DataFrame:
    """Every other member that is not dead, once, in an order that changes with seed and round."""
    return members.where((F.col("id") != self_id) & (F.col("severity") != DEAD)).orderBy(F.xxhash64("id", F.lit(seed), F.lit(round_)), "id")


def state_counts(members: DataFrame) -> DataFrame:
    """``state, n`` of all three states, zeros as well; one pass over the members."""
    counts = members.agg(*(F.count_if(F.col("severity") == k).alias(s) for k, s in enumerate(STATES)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES))))
