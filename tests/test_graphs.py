"""Paths, snapshots, threat models and finding contexts against brute force and cases worked out by hand."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest

from tidewatch.operators import findings as fd
from tidewatch.operators import graph as g
from tidewatch.operators import threatmodel as tm

EDGE = "from_type string, from_value string, to_type string, to_value string, relation string, status string"
ASSET = "entity_ref string, entity_type string, name string, criticality string, environment string, internet_exposed boolean"
T0 = datetime(2030, 5, 6, 7)


def edges(spark, rows):
    return spark.createDataFrame([("n", a, "n", b, rel, state) for a, b, rel, state in rows], EDGE)


def all_shortest(links, a, b, hops):
    """Every shortest path by breadth-first search over walks."""
    walks = [[a]]
    for _ in range(hops):
        walks = [[*w, y] for w in walks for x, y in links if x == w[-1] and y not in w]
        hit = sorted(w for w in walks if w[-1] == b)
        if hit:
            return hit
    return []


def test_shortest_paths_match_brute_force(spark):
    rng = random.Random(3)
    names = [f"n{i:02}" for i in range(14)]
    rows = list({(a, b, "r", rng.choice(["observed", "inferred"])) for a, b in (rng.sample(names, 2) for _ in range(30))})
    both = sorted({(f"n:{a}", f"n:{b}") for a, b, *_ in rows} | {(f"n:{b}", f"n:{a}") for a, b, *_ in rows})
    pairs = [(f"n:{a}", f"n:{b}") for a, b in product(names[:4], names)] + [("n:n00", "n:absent")]
    for n in (3, 100):
        got = {}
        for r in g.shortest_paths(edges(spark, rows), spark.createDataFrame(pairs, "a string, b string"), 4, n=n).collect():
            assert r.hops == len(r.states) == len(r.nodes) - 1
            got.setdefault((r.a, r.b), []).append(r.nodes)
        want = {p: all_shortest(both, *p, 4)[:n] for p in pairs if p[0] != p[1]}
        assert {p: sorted(x) for p, x in got.items()} == {p: x for p, x in want.items() if x}


def test_a_hub_does_not_multiply_walks(spark):
    """Two nodes on either side of a hub with thousands of neighbours: one path, and no more rows than nodes on the way."""
    rows = [("hub", f"leaf{i}", "r", "observed") for i in range(10_000)] + [("a", "hub", "r", "observed"), ("leaf7", "z", "r", "observed"), ("leaf8", "z", "r", "inferred")]
    got = g.shortest_paths(edges(spark, rows), spark.createDataFrame([("n:a", "n:z")], "a string, b string")).collect()
    assert sorted(r.nodes for r in got) == [["n:a", "n:hub", "n:leaf7", "n:z"], ["n:a", "n:hub", "n:leaf8", "n:z"]]
    near = {r.node: r.paths for r in g.entity_neighbors(edges(spark, rows), "n:a").where("node in ('n:a', 'n:leaf3')").collect()}
    assert near == {"n:a": 1, "n:leaf3": 1}


@pytest.mark.parametrize("seed", range(4))
def test_potential_paths_match_brute_force(spark, seed):
    """Each critical asset's first shortest way from a compromised node other than itself, never through another critical asset."""
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(16)]
    rows = list({(a, b): (a, b, "r", rng.choice(["observed", "inferred", "potential", "blocked"])) for a, b in (rng.sample(names, 2) for _ in range(34))}.values())
    goals, bad = set(rng.sample(names, 5)), set(rng.sample(names, 4))
    assets = spark.createDataFrame([(f"n:{x}", "host", x, "critical" if x in goals else "low", None, False) for x in names], ASSET)
    compromise = spark.createDataFrame([(f"n:{x}", "compromised_observed") for x in bad] + [("n:n99", "at_risk_potential")], "node string, state string")
    links = {(a, b): s for a, b, _, s in rows if s != "blocked"}
    want = {}
    walks = [[x] for x in sorted(bad)]
    for d in range(1, 5):
        walks = [[*w, b] for w in walks for (a, b) in links if a == w[-1] and b not in w and (len(w) == 1 or w[-1] not in goals)]
        for w in walks:
            if w[-1] in goals:
                want.setdefault(w[-1], []).append((d, w[0], w))
    want = {t: min(x) for t, x in want.items()}
    got = {r.target[2:]: (r.hops, r.source[2:], [x[2:] for x in r.nodes]) for r in g.potential_paths(edges(spark, rows), compromise, assets).collect()}
    assert got == want


def test_snapshot_is_bounded_and_overlaid(spark):
    rows = [("r", f"a{i}", "connects_to", "inferred" if i % 2 else "observed") for i in range(6)] + [(f"a{i}", f"b{i}", "connects_to", "observed") for i in range(6)]
    assets = spark.createDataFrame([("n:a0", "host", "a0", "high", "dmz", False)], ASSET)
    compromise = spark.createDataFrame([("n:a0", "compromised_observed")], "node string, state string")
    root = spark.createDataFrame([("n:r",)], "node string")
    nodes, links = g.snapshot(edges(spark, rows), root, compromise, assets, nodes=7, n_edges=4)
    assert {(r.node, r.depth) for r in nodes.collect()} == {("n:r", 0), *((f"n:a{i}", 1) for i in range(6))}
    assert [(r.node, r.compromise, r.criticality) for r in nodes.where("compromise is not null").collect()] == [("n:a0", "compromised_observed", "high")]
    # Observed links come first; those to nodes that fell away are no part of it.
    assert sorted((r.dst, r.state, r.crosses, r.compromise) for r in links.collect()) == [("n:a0", "observed", True, "compromised_observed"), ("n:a1", "inferred", False, None), ("n:a2", "observed", False, None), ("n:a4", "observed", False, None)]


def model(spark, assets, rows):
    a = spark.createDataFrame(assets, ASSET)
    e = spark.createDataFrame(rows, EDGE)
    nodes, links = tm.tm_nodes(a, e), tm.tm_edges(a, e)
    return nodes, links, tm.tm_threats(a, nodes, links)


SHOP = ("host:shop", "host", "shop", "critical", "dmz", True)
VAULT = ("host:vault", "DB", "vault", "high", "corp", False)
ROWS = [
    ("ip", "8.8.4.4", "host", "shop", "connected_to", "observed"), ("ip", "8.8.4.4", "host", "shop", "connects_to", "inferred"), ("host", "shop", "host", "vault", "lateral_movement", "observed"),
    ("host", "shop", "database", "ledger", "reads", "inferred"), ("host", "vault", "host", "vault", "executed", "observed"), ("user", "amy", "host", "shop", "auth_from", "potential"),
]


def test_threat_model(spark):
    nodes, links, threats = model(spark, [SHOP, VAULT], ROWS)
    assert {(r.node, r.kind, r.basis) for r in nodes.collect()} == {
        ("host:shop", "asset", "observed"), ("host:vault", "data_store", "observed"), ("ep:host:shop", "entry_point", "observed"), ("tb:internet", "trust_boundary", "inferred"),
        ("tb:dmz", "trust_boundary", "assumed"), ("tb:corp", "trust_boundary", "assumed"), ("ext:ip:8.8.4.4", "asset", "inferred"), ("ext:database:ledger", "data_store", "inferred"),
    }
    # An exposed asset's entry point lies in the internet; the other one in its zone.  No loops, nothing that only could be.
    assert {(r.src, r.dst, r.relation, r.basis) for r in links.collect()} == {
        ("ep:host:shop", "host:shop", "exposes", "observed"), ("ep:host:shop", "tb:internet", "resides_in", "inferred"), ("host:vault", "tb:corp", "resides_in", "assumed"),
        ("ext:ip:8.8.4.4", "host:shop", "flows_to", "observed"), ("host:shop", "host:vault", "lateral_movement", "observed"), ("host:shop", "ext:database:ledger", "reads", "inferred"),
    }
    got = {(r.node or r.edge, r.stride): (r.likelihood, r.impact, r.basis) for r in threats.collect()}
    assert got == {
        ("host:shop", "spoofing"): ("possible", "critical", "assumed"), ("host:shop", "information_disclosure"): ("possible", "critical", "assumed"),
        ("host:shop", "elevation_of_privilege"): ("possible", "high", "assumed"), ("host:shop", "denial_of_service"): ("possible", "medium", "assumed"),
        **{(n, s): ("possible", "high", "assumed") for n in ("host:vault", "ext:database:ledger") for s in ("tampering", "information_disclosure")},
        ("ext:ip:8.8.4.4→host:shop", "elevation_of_privilege"): ("likely", "high", "inferred"), ("host:shop→host:vault", "elevation_of_privilege"): ("likely", "high", "inferred"),
    }
    spoof = threats.where("stride = 'spoofing'").first()
    assert (spoof.techniques, spoof.mitigations) == (["T1110", "T1078", "T1568"], ["DF_43", "DF_48", "DF_53"])
    assert {r.control_id for r in tm.tm_controls(threats.where("stride = 'spoofing'")).collect()} == {"ctl_mfa", "ctl_password", "ctl_lockout"}
    assert set(tm.CONTROLS) >= {m for t in tm.TECHNIQUES.values() for x in t for m in tm.DEFENCES[x]}


def test_drift_of_every_kind(spark):
    before = model(spark, [(*SHOP[:3], "low", *SHOP[4:]), VAULT], ROWS)
    after = model(spark, [SHOP, ("host:new", "host", "new", "low", "corp", True)], ROWS[:2])
    got = {}
    for r in tm.tm_drift(before, after).collect():
        got.setdefault((r.kind, r.change), set()).add(r.item)
    assert got[("node", "added")] == {"host:new", "ep:host:new"} and got[("node", "removed")] == {"host:vault", "ext:database:ledger"}
    assert "host:shop→host:vault:lateral_movement" in got[("edge", "removed")] and "ep:host:new→host:new:exposes" in got[("edge", "added")]
    ids = {r.threat_id: (r.node, r.edge, r.stride) for m in (before, after) for r in m[2].collect()}
    named = {k: {ids[x] for x in v} for k, v in got.items() if k[0] in ("threat", "risk")}
    new = {("host:new", None, s) for s in ("spoofing", "information_disclosure", "elevation_of_privilege", "denial_of_service")}
    assert named[("threat", "added")] == new
    # A new threat of medium impact is no risk; two known ones have grown with the asset's criticality.
    assert named[("risk", "added")] == (new - {("host:new", None, "denial_of_service")}) | {("host:shop", None, "spoofing"), ("host:shop", None, "information_disclosure")}
    assert named[("risk", "removed")] == named[("threat", "removed")] and len(named[("risk", "removed")]) == 5
    assert tm.tm_drift(after, after).count() == 0


def test_finding_context(spark):
    group = spark.createDataFrame([("k", 2, T0, T0, "amy", "h1", "1.2.3.4", None)], "group_key string, n long, first_seen timestamp_ntz, last_seen timestamp_ntz, user string, host string, source_ip string, destination_ip string")
    f = fd.new_findings(group, "r", "Rule", "high", "persistence", "T1")
    fid = f.first().id
    ev = [(f"e{i}", T0 + timedelta(minutes=i), "app", "amy", f"h{i}", "1.2.3.4", "5.6.7.8", "p", '{"domain": "d.example", "md5": "ff"}' if i == 4 else None) for i in range(5)]
    events = spark.createDataFrame(ev, "id string, timestamp timestamp_ntz, source string, user string, host string, source_ip string, destination_ip string, process string, attributes string")
    links = spark.createDataFrame([(fid, f"e{i}") for i in range(5)], "finding_id string, event_id string")
    seen = spark.createDataFrame([("e1", "T9", "impact"), ("e4", "T2", "impact"), ("e0", "T7", "recon")], "id string, technique string, tactic string")
    hits = spark.createDataFrame([("e4", n) for n in range(12)], "id string, indicator_id long")
    related = spark.createDataFrame([(fid, "other")], "finding_id string, other_id string")
    cover = spark.createDataFrame([("h1", ["net.dns"]), ("h2", ["net.ids", "net.dns"]), ("h4", ["x"])], "host string, missing array<string>")
    r = fd.finding_context(f, links, events, seen, hits, related, cover, n_events=3).first()
    assert r.event_ids == ["e2", "e3", "e4"] and r.hosts == ["h1", "h2", "h3", "h4"] and r.ips == ["1.2.3.4", "5.6.7.8"] and r.domains == ["d.example"] and r.hashes == ["ff"] and r.files == []
    # Only the newest three events count: one technique of another tactic outweighs the finding's own, which none of them shows.
    assert r.techniques == ["T2"] and r.dominant_tactic == "impact" and len(r.indicators) == 10 and r.related == ["other"]
    assert r.gaps == ["net.dns on h1", "net.dns on h2", "net.ids on h2"]  # of the first three hosts
    bare = fd.finding_context(f, links.limit(0), events, seen, hits, related.limit(0)).first()
    assert bare.dominant_tactic == "persistence" and bare.event_ids == [] and bare.users == ["amy"]
