import pytest

from tidelog import errors
from tidelog.operators.groups import Group, replay


def test_two_members_and_an_expiry():
    g = Group()
    g.join("a", ("range", "sticky"), 50, 100, 0, new=True)
    assert (g.state, g.generation) == ("awaiting", 1)
    g.sync("a", 1, {"a": b"1"}, 1)
    with pytest.raises(errors.UnknownMember):
        g.join("b", ("sticky",), 500, 100, 2)
    g.join("b", ("sticky",), 500, 100, 2, new=True)
    assert g.state == "joining"
    with pytest.raises(errors.RebalanceInProgress):
        g.heartbeat("a", 1, 3)
    with pytest.raises(errors.InconsistentProtocol):
        g.join("c", ("range",), 50, 100, 3, new=True)
    g.join("a", ("range", "sticky"), 50, 100, 4)
    assert (g.state, g.generation, g.protocol, g.leader) == ("awaiting", 2, "sticky", "a")
    assert g.sync("b", 2, None, 5) is None
    for name, wrong in (("a", {"a": b"x"}), ("a", None), ("b", {"a": b"", "b": b""})):
        with pytest.raises(errors.LogError) as e:
            g.sync(name, 2, wrong, 6)
        assert e.value.code == "INVALID_REQUEST"
    g.sync("a", 2, {"a": b"x", "b": b"y"}, 6)
    assert g.sync("b", 2, None, 7) == b"y" and g.sync("a", 2, {"a": b"x", "b": b"y"}, 7) == b"x"
    with pytest.raises(errors.LogError):
        g.sync("a", 2, {"a": b"z", "b": b"y"}, 7)
    g.may_commit("b", 2, 8)
    with pytest.raises(errors.IllegalGeneration):
        g.may_commit("b", 1, 8)
    with pytest.raises(errors.UnknownMember):
        g.heartbeat("c", 9, 8)
    with pytest.raises(errors.RebalanceInProgress):
        g.heartbeat("b", 2, 57)  # a's session has ended
    assert sorted(g.members) == ["b"] and g.leader == "b"


def test_an_expiry_while_others_wait_settles_the_round():
    g = Group()
    g.join("a", ("range",), 50, 1000, 0, new=True)
    g.sync("a", 1, {"a": b""}, 1)
    g.join("b", ("range",), 500, 1000, 2, new=True)
    g.tick(50)
    assert g.state == "joining"
    g.tick(51)
    assert (g.state, g.generation, g.leader, sorted(g.members)) == ("awaiting", 2, "b", ["b"])


def test_an_empty_group_starts_anew():
    g = Group()
    g.join("a", ("range",), 50, 100, 0, new=True)
    g.leave("a", 1)
    assert (g.state, g.generation) == ("empty", 0)
    g.join("a", ("range",), 50, 100, 2, new=True)
    assert g.generation == 1


def test_stragglers_are_dropped_at_the_deadline():
    g = Group()
    g.join("a", ("range",), 1000, 20, 0, new=True)
    g.sync("a", 1, {"a": b""}, 1)
    g.join("b", ("range",), 1000, 20, 2, new=True)
    g.tick(21)
    assert sorted(g.members) == ["a", "b"]
    g.tick(22)
    assert sorted(g.members) == ["b"] and (g.state, g.generation, g.leader) == ("awaiting", 2, "b")


def test_a_leader_that_never_syncs_is_asked_again():
    g = Group()
    g.join("a", ("range",), 1000, 20, 0, new=True)
    g.tick(20)
    assert (g.state, g.generation) == ("joining", 1)


def test_replay(spark):
    calls = [("g", 0, 0, "enter", "a", 0), ("g", 1, 1, "sync", "a", 1), ("g", 2, 2, "heartbeat", "a", 1), ("g", 3, 3, "commit", "z", 1), ("h", 0, 0, "heartbeat", "a", 0)]
    df = spark.createDataFrame([(*c, "range", 50, 50) for c in calls], "group string, n long, at_ms long, kind string, member string, generation long, protocols string, session_ms long, rebalance_ms long")
    got = {(r.group, r.n): (r.result, r.state) for r in replay(df).collect()}
    assert got == {("g", 0): ("NONE", "awaiting"), ("g", 1): ("NONE", "stable"), ("g", 2): ("NONE", "stable"), ("g", 3): ("UNKNOWN_MEMBER_ID", "stable"), ("h", 0): ("UNKNOWN_MEMBER_ID", "empty")}


def test_coordinator(spark, tmp_path):
    from tidelog.sources.coordinator import Coordinator
    from tidelog.sources.log import EventLog

    clock = [0]
    log = EventLog(spark, str(tmp_path))
    log.create_topic("t")
    c = Coordinator(log, lambda: clock[0])
    a = c.join("g", "", {"range": b"a"}, 50, 50)
    assert (a.state, a.generation, a.members) == ("awaiting", 1, {a.member: b"a"})
    assert c.sync("g", a.member, 1, {a.member: b"all"}) == b"all"
    assert c.commit("g", a.member, 1, {("t", 0): (3, "m"), ("t", 1): (4, None)}) == {("t", 0): "NONE", ("t", 1): "UNKNOWN_TOPIC_OR_PARTITION"}
    assert [tuple(r) for r in c.committed("g").collect()] == [("t", 0, 3, "m")]
    b = c.join("g", "", {"range": b"b"}, 200, 80)
    assert b.state == "joining" and c.poll("g", b.member).members == {}
    with pytest.raises(errors.RebalanceInProgress):
        c.commit("g", a.member, 1, {("t", 0): (9, None)})
    clock[0] = 50  # the first member's session ends; the second is left as leader
    got = c.poll("g", b.member)
    assert (got.state, got.generation, got.leader, got.members) == ("awaiting", 2, b.member, {b.member: b"b"})
    with pytest.raises(errors.UnknownMember):
        c.heartbeat("g", a.member, 1)
    with pytest.raises(errors.UnknownMember):
        c.join("g", "never-seen", {"range": b""}, 50, 50)
    with pytest.raises(errors.InvalidSessionTimeout):
        c.join("g", "", {"range": b""}, 0, 50)
    with pytest.raises(errors.InconsistentProtocol):
        c.join("g", "", {"other": b""}, 50, 50)
    c.leave("g", b.member)
    assert c.join("g", "", {"range": b""}, 50, 50).generation == 1
