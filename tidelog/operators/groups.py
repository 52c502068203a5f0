"""Consumer offsets and group membership."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IllegalGeneration, InconsistentProtocol, LogError, RebalanceInProgress, UnknownMember
from ..limits import METADATA_BYTES

KEY = ["group", "topic", "partition"]


def latest_commits(commits: DataFrame) -> DataFrame:
    """The last committed offset and metadata of each key; revision orders commits."""
    last = commits.groupBy(*KEY).agg(F.max_by(F.struct("offset", "metadata", "revision"), "revision").alias("c"))
    return last.select(*KEY, "c.offset", "c.metadata", "c.revision")


def fetch_offsets(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requested keys in their order (pos); absent ones have offset -1 and null metadata."""
    found = requests.join(current.select(*KEY, "offset", "metadata"), KEY, "left")
    return found.select("pos", *KEY, F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"), "metadata")


def validate_commits(commits: DataFrame, topics: DataFrame) -> DataFrame:
    """Per commit: an error code, NONE if it may be stored."""
    known = commits.join(topics, "topic", "left")
    code = (
        F.when(F.col("partition_count").isNull() | ~F.col("partition").between(0, F.col("partition_count") - 1), "UNKNOWN_TOPIC_OR_PARTITION")
        .when(F.col("offset") < 0, "INVALID_COMMIT_OFFSET_SIZE")
        .when(F.octet_length("metadata") > METADATA_BYTES, "OFFSET_METADATA_TOO_LARGE")
        .otherwise("NONE")
    )
    return known.select(*KEY, "offset", code.alias("error"))


def offsets_by_topic(current: DataFrame) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("partition", "offset")))
    return current.groupBy("group", "topic").agg(entries.alias("entries"))


def select_protocol(members: DataFrame) -> DataFrame:
    """The leader's first protocol that all members of a group support.

    members(group, member, position, protocol, leader): a row per member and protocol, in preference order.
    """
    sizes = members.groupBy("group").agg(F.count_distinct("member").alias("members"))
    shared = members.groupBy("group", "protocol").agg(F.count_distinct("member").alias("supporters"), F.min(F.when(F.col("leader"), F.col("position"))).alias("position"))
    fit = shared.join(sizes, "group").where("supporters = members and position is not null")
    chosen = fit.groupBy("group").agg(F.min_by("protocol", "position").alias("protocol"))
    return sizes.join(chosen, "group", "left").select("group", "members", "protocol")


def assignment_exact(current: DataFrame, submitted: DataFrame) -> DataFrame:
    """Whether the members that a leader assigns are exactly the group's; duplicates count against it."""
    once = submitted.groupBy("group", "member").agg(F.count("*").alias("times"))
    both = current.select("group", "member", F.lit(1).alias("now")).join(once, ["group", "member"], "full")
    bad = F.col("now").isNull() | F.col("times").isNull() | (F.col("times") > 1)
    return both.groupBy("group").agg(F.count_if(bad).alias("mismatches")).select("group", "mismatches", (F.col("mismatches") == 0).alias("exact"))


def session_expiries(beats: DataFrame, timeout_s: int, end) -> DataFrame:
    """beats(member, at): where a member's next sign of life comes at its deadline or later."""
    order = Window.partitionBy("member").orderBy("at")
    deadline = F.col("at") + F.expr(f"INTERVAL {timeout_s} SECOND")
    nxt = F.coalesce(F.lead("at").over(order), end)
    return beats.withColumn("_next", nxt).where(deadline <= F.col("_next")).select("member", F.col("at").alias("last_seen"), deadline.alias("expired_at"))


@dataclass
class Member:
    protocols: tuple
    session_ms: int
    rebalance_ms: int
    deadline: int
    joined: int = -1
    assignment: bytes | None = None


@dataclass
class Group:
    """Membership of one group, driven by calls that carry the time; nothing here waits.

    joining: members are asked to join again; awaiting: all have joined, the leader's assignment is
    due; stable: assignments are in force.
    """

    state: str = "empty"
    generation: int = 0
    round: int = 0
    leader: str | None = None
    protocol: str | None = None
    phase_deadline: int = 0
    members: dict[str, Member] = field(default_factory=dict)

    def tick(self, now: int) -> None:
        """What time alone changes: sessions that have ended, and phases that are overdue."""
        gone = [m for m, x in self.members.items() if x.deadline <= now]
        if gone:
            self._drop(gone)
            if self.state in ("awaiting", "stable"):
                self._ask_all(now)
        if self.state == "joining":
            if self.phase_deadline <= now:
                self._drop([m for m, x in self.members.items() if x.joined != self.round])
            self._settle(now)
        elif self.state == "awaiting" and self.phase_deadline <= now:
            self._ask_all(now)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            del self.members[name]
        if not self.members:
            self.state, self.generation, self.round, self.leader, self.protocol = "empty", 0, 0, None, None
        elif self.leader not in self.members:
            self.leader = min(self.members)

    def _patience(self, now: int) -> int:
        return max(now + m.rebalance_ms for m in self.members.values())

    def _ask_all(self, now: int) -> None:
        """A new round, in which every member has to join again."""
        self.state, self.round, self.protocol = "joining", self.round + 1, None
        for m in self.members.values():
            m.assignment = None
        self.phase_deadline = self._patience(now)

    def _settle(self, now: int) -> None:
        """A new generation, once everybody has joined."""
        if self.state != "joining" or any(m.joined != self.round for m in self.members.values()):
            return
        shared = set.intersection(*(set(m.protocols) for m in self.members.values()))
        self.protocol = next(p for p in self.members[self.leader].protocols if p in shared)
        self.state, self.generation = "awaiting", self.generation + 1
        self.phase_deadline = self._patience(now)
        for m in self.members.values():
            m.assignment, m.deadline = None, now + m.session_ms

    def join(self, name: str, protocols: tuple, session_ms: int, rebalance_ms: int, now: int, new: bool = False) -> None:
        """new: the member had no name and gets this one. Others must be members still."""
        self.tick(now)
        if not new and name not in self.members:
            raise UnknownMember()
        others = [set(m.protocols) for n, m in self.members.items() if n != name]
        if not protocols or not set(protocols).intersection(*others):
            raise InconsistentProtocol()
        if self.state == "empty":
            self.state, self.round, self.leader = "joining", 1, name
        elif self.state != "joining":
            self._ask_all(now)
        self.members[name] = Member(tuple(protocols), session_ms, rebalance_ms, now + session_ms, self.round)
        self.phase_deadline = self._patience(now)
        self._settle(now)

    def _active(self, name: str, generation: int) -> Member:
        if name not in self.members:
            raise UnknownMember()
        if generation != self.generation:
            raise IllegalGeneration()
        return self.members[name]

    def sync(self, name: str, generation: int, assignments: dict[str, bytes] | None, now: int) -> bytes | None:
        """The member's assignment, or None while the leader's is awaited. Only the leader submits
        assignments, exactly one for each member, and once for a generation."""
        self.tick(now)
        m = self._active(name, generation)
        if self.state == "joining":
            raise RebalanceInProgress()
        if assignments:
            if name != self.leader or set(assignments) != set(self.members):
                raise LogError("not the assignments of this group", "INVALID_REQUEST")
            if self.state == "stable" and any(self.members[n].assignment != x for n, x in assignments.items()):
                raise LogError("another assignment is in force", "INVALID_REQUEST")
        if self.state == "awaiting" and name == self.leader:
            if not assignments:
                raise LogError("the leader's assignments are missing", "INVALID_REQUEST")
            for n, x in assignments.items():
                self.members[n].assignment, self.members[n].deadline = x, now + self.members[n].session_ms
            self.state = "stable"
        m.deadline = now + m.session_ms
        return m.assignment

    def heartbeat(self, name: str, generation: int, now: int) -> None:
        self.tick(now)
        m = self._active(name, generation)
        m.deadline = now + m.session_ms
        if self.state != "stable":
            raise RebalanceInProgress()

    def leave(self, name: str, now: int) -> None:
        self.tick(now)
        if name not in self.members:
            raise UnknownMember()
        self._drop([name])
        if self.state == "joining":
            self._settle(now)
        elif self.members:
            self._ask_all(now)

    def may_commit(self, name: str, generation: int, now: int) -> None:
        self.tick(now)
        self._active(name, generation)
        if self.state != "stable":
            raise RebalanceInProgress()


REPLAYED = "group string, n long, at_ms long, kind string, member string, result string, state string, generation long, members long, leader string"


REPLAYED_NAMES = [c.split()[0] for c in REPLAYED.split(", ")]


def step(g: Group, e) -> tuple:
    """One call, as a row of `replay`'s input, and its REPLAYED row."""
    try:
        if e.kind in ("join", "enter"):
            g.join(e.member, tuple(e.protocols.split(",")), e.session_ms, e.rebalance_ms, e.at_ms, e.kind == "enter")
        elif e.kind == "sync":
            g.sync(e.member, e.generation, {m: b"" for m in g.members} if e.member == g.leader else None, e.at_ms)
        elif e.kind == "heartbeat":
            g.heartbeat(e.member, e.generation, e.at_ms)
        elif e.kind == "leave":
            g.leave(e.member, e.at_ms)
        elif e.kind == "commit":
            g.may_commit(e.member, e.generation, e.at_ms)
        else:
            g.tick(e.at_ms)
        result = "NONE"
    except LogError as error:
        result = error.code
    return e.group, e.n, e.at_ms, e.kind, e.member, result, g.state, g.generation, len(g.members), g.leader


def replay(events: DataFrame) -> DataFrame:
    """events(group, n, at_ms, kind, member, generation, protocols, session_ms, rebalance_ms) in order n,
    each with its outcome and the group's state after it. kind: enter (join without a name, which this
    one is given), join, sync, heartbeat, leave, commit or tick."""
    def run(batches):
        last, g = None, None
        for pdf in batches:
            rows = []
            for e in pdf.itertuples(index=False):
                if g is None or e.group != last:
                    last, g = e.group, Group()
                rows.append(step(g, e))
            yield pd.DataFrame(rows, columns=REPLAYED_NAMES)

    cols = ["group", "n", "at_ms", "kind", "member", "generation", "protocols", "session_ms", "rebalance_ms"]
    return events.select(*cols).repartition("group").sortWithinPartitions("group", "n").mapInPandas(run, REPLAYED)
