"""The entity graph: nodes and edges from events, identities, traversal, compromise states and attack paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..scratch import saved

# Relations that give access, and the write path's names for them.
ACCESS = ("authenticates", "auth", "login", "logon", "exec", "execs", "executes", "runs", "accesses", "reads", "writes", "transfers", "lateral_movement", "connects_to", "connects")
WRITE_PATH = {"connected_to": "connects_to", "auth_from": "auth", "executed": "executes", "accessed": "accesses"}
STEP_WEIGHT = {"observed": 1.0, "inferred": 0.6, "potential": 0.3, "blocked": 0.0}
CRITICALITY_FACTOR = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2}


def _cut(df: DataFrame) -> DataFrame:
    """A written table in the shared folder: one per level keeps lineage short."""
    return saved(df, "graph")


def entities_from_events(events: DataFrame) -> DataFrame:
    """(type, value, first_seen, last_seen, count)."""
    cols = (("ip", "source_ip"), ("ip", "destination_ip"), ("user", "user"), ("host", "host"), ("process", "process"), ("file", "file_path"), ("trace", "trace_id"))
    refs = [F.struct(F.lit(k).alias("type"), F.col(x).alias("value")) for k, x in cols if x in events.columns]
    each = events.select("timestamp", F.explode(F.array(*refs)).alias("e")).where("e.value is not null and e.value != ''")
    return each.groupBy("e.type", "e.value").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("count"))


def _edges(events: DataFrame) -> Column:
    def edge(a, x, b, y, rel):
        return F.struct(F.lit(a).alias("from_type"), F.col(x).alias("from_value"), F.lit(b).alias("to_type"), F.col(y).alias("to_value"), F.lit(rel).alias("relation"))

    all_ = [("ip", "source_ip", "ip", "destination_ip", "connected_to"), ("user", "user", "host", "host", "auth_from"), ("host", "host", "process", "process", "executed"), ("host", "host", "file", "file_path", "accessed")]
    return F.array(*[edge(*e) for e in all_ if e[1] in events.columns and e[3] in events.columns])


_KEY = ["from_type", "from_value", "to_type", "to_value", "relation"]


def _edge_rows(events: DataFrame, *keep) -> DataFrame:
    return events.select(*keep, F.explode(_edges(events)).alias("e")).select(*keep, "e.*").where("from_value is not null and from_value != '' and to_value is not null and to_value != ''")


def relationships_from_events(events: DataFrame) -> DataFrame:
    return _edge_rows(events, "timestamp").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("timestamp").alias("created_at"))


def edge_states(events: DataFrame, analyst: DataFrame | None = None) -> DataFrame:
    """The state that an edge's first event gives: blocked for refused connections and sign-ins, else observed; an analyst's word wins."""
    e = _edge_rows(events, "timestamp", "id", "outcome")
    state = F.when(X.is_blocked_outcome("outcome") & F.col("relation").isin("connected_to", "auth_from"), "blocked").otherwise("observed")
    out = e.groupBy(*_KEY).agg(F.min_by(state, F.struct("timestamp", "id")).alias("status"))
    if analyst is not None:
        out = out.join(analyst.select(*_KEY, F.col("status").alias("s")), _KEY, "left").withColumn("status", F.coalesce("s", "status")).drop("s")
    return out


def extract_entities(events: DataFrame) -> DataFrame:
    """(id, type, value, alias): entities in the attributes and the process and user columns, in normal form with the raw form."""
    at = lambda k: F.get_json_object("attributes", f"$['{k}']")
    raw = [("domain", at("domain"), X.normalize_domain), ("url", at("url"), X.normalize_url), ("email", at("email"), X.normalize_email), ("hash", at("hash"), X.normalize_hash), ("file", F.coalesce(at("file"), at("path")), lambda x: x), ("process", F.col("process"), X.normalize_process), ("user", F.col("user"), X.normalize_user)]
    refs = F.array(*[F.struct(F.lit(k).alias("type"), norm(x).alias("value"), x.alias("alias")) for k, x, norm in raw])
    return events.select("id", F.explode(refs).alias("e")).select("id", "e.*").where("value is not null and value != ''")


def aliases(events: DataFrame) -> DataFrame:
    """(canonical_type, canonical_value, alias_type, alias_value, status, confidence, first_seen, last_seen)."""
    own = extract_entities(events).join(events.select("id", "timestamp"), "id").where("alias != value")
    own = own.select(F.col("type").alias("canonical_type"), F.col("value").alias("canonical_value"), F.col("type").alias("alias_type"), F.col("alias").alias("alias_value"), F.lit("confirmed").alias("status"), F.lit(1.0).alias("confidence"), "timestamp")
    near = events.where("host is not null and source_ip is not null and host != '' and source_ip != ''").select(F.lit("host").alias("canonical_type"), X.normalize_host("host").alias("canonical_value"), F.lit("ip").alias("alias_type"), F.col("source_ip").alias("alias_value"), F.lit("probable").alias("status"), F.lit(0.8).alias("confidence"), "timestamp")
    return merge_identities(own.unionByName(near).withColumn("first_seen", F.col("timestamp")).withColumnRenamed("timestamp", "last_seen"))


def identity_rank(status: Column) -> Column:
    return F.when(status == "confirmed", 3).when(status == "probable", 2).when(status == "possible", 1).otherwise(0)


def merge_identities(rows: DataFrame) -> DataFrame:
    """The strongest status and the largest confidence of each pair; a weaker word never lowers either."""
    return rows.groupBy("canonical_type", "canonical_value", "alias_type", "alias_value").agg(F.max_by("status", identity_rank(F.col("status"))).alias("status"), F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def resolve(names: DataFrame, entities: DataFrame, identities: DataFrame) -> DataFrame:
    """(name, type, value, confidence): by value first, else by the best confirmed or probable alias."""
    direct = names.join(entities.select("type", "value"), F.lower("name") == F.lower("value")).select("name", "type", "value", F.lit(1.0).alias("confidence"))
    known = identities.where("status in ('confirmed', 'probable')")
    via = names.join(known, F.lower("name") == F.lower("alias_value")).select("name", F.col("canonical_type").alias("type"), F.col("canonical_value").alias("value"), "confidence")
    w = Window.partitionBy("name").orderBy(F.desc("confidence"), "type", "value")
    return direct.unionByName(via).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def relationships_of(edges: DataFrame, kind: str, value: str, n: int) -> DataFrame:
    hit = ((F.col("from_type") == kind) & (F.col("from_value") == value)) | ((F.col("to_type") == kind) & (F.col("to_value") == value))
    return edges.where(hit).orderBy(F.desc("created_at"), *_KEY).limit(n)


def links(edges: DataFrame, states: tuple[str, ...] | None = None, directed: bool = False) -> DataFrame:
    """(src, dst, relation, state) with nodes as 'type:value', in both directions unless ``directed``."""
    state = F.coalesce("status", F.lit("observed")) if "status" in edges.columns else F.lit("observed")
    e = edges.select(F.concat_ws(":", "from_type", "from_value").alias("src"), F.concat_ws(":", "to_type", "to_value").alias("dst"), "relation", state.alias("state"))
    if states:
        e = e.where(F.col("state").isin(*states))
    return e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "state"))


def bfs(edges: DataFrame, roots: DataFrame, depth: int = 4, states: tuple[str, ...] | None = None, directed: bool = False) -> DataFrame:
    """(node, depth): the first level, up to ``depth``, at which each node is met from ``roots`` (node)."""
    e = _cut(links(edges, states, directed).select("src", "dst").distinct())  # each level reads it again
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        frontier = _cut(nxt)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 4, states: tuple[str, ...] | None = None, n: int = 20) -> DataFrame:
    """(a, b, hops, nodes, states): the shortest undirected paths of each pair, the first ``n`` in order of their nodes.

    Levels of nodes around each start are searched, not walks, so that a hub is met once.  From the ends back, the links between one level
    and the next that lie on a shortest path make a graph of their own; the paths are unrolled from it, ``n`` beginnings of each pair at
    a time, all of which lead to the end.  A pair of one node has no path.
    """
    e = _cut(links(edges, states).where("src != dst").groupBy("src", "dst").agg(F.min("state").alias("state")))
    want = _cut(pairs.select("a", "b").where("a != b").distinct())
    seen = want.select("a", F.col("a").alias("node"), F.lit(0).alias("level")).distinct()
    frontier, open_, found = seen, want, None
    for d in range(1, hops + 1):
        step = frontier.select("a", "node").join(e, F.col("node") == F.col("src")).select("a", F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(seen, ["a", "node"], "left_anti").withColumn("level", F.lit(d)))
        seen = seen.unionByName(frontier)
        hit = _cut(open_.join(frontier.select("a", F.col("node").alias("b")), ["a", "b"]).withColumn("hops", F.lit(d)))
        found = hit if found is None else found.unionByName(hit)
        open_ = _cut(open_.join(hit, ["a", "b"], "left_anti"))
        frontier = frontier.join(open_.select("a").distinct(), "a", "left_semi")  # starts that have found all their ends are done
        if frontier.isEmpty():
            break
    back = found.select("a", "b", F.col("b").alias("node"), F.col("hops").alias("level"))
    ways = []
    for _ in range(d):
        own = back.join(e, F.col("node") == F.col("dst")).select("a", "b", "src", "dst", "state", (F.col("level") - 1).alias("level"))
        ways.append(_cut(own.join(seen.select("a", F.col("node").alias("src"), "level"), ["a", "src", "level"])))
        back = ways[-1].where("level > 0").select("a", "b", F.col("src").alias("node"), "level").distinct()
    dag = ways[0]
    for way in ways[1:]:
        dag = dag.unionByName(way)
    dag = _cut(dag)
    walk = found.select("a", "b", "hops", F.col("a").alias("at"), F.array("a").alias("nodes"), F.array().cast("array<string>").alias("states"))
    done = None
    first = Window.partitionBy("a", "b").orderBy("nodes")
    for step in range(1, d + 1):
        on = dag.where(F.col("level") == step - 1).select("a", "b", F.col("src").alias("at"), "dst", "state")
        longer = walk.join(on, ["a", "b", "at"]).select("a", "b", "hops", F.col("dst").alias("at"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("states", F.col("state")).alias("states"))
        walk = _cut(longer.withColumn("n", F.row_number().over(first)).where(F.col("n") <= n).drop("n"))
        hit = walk.where(F.col("hops") == step).select("a", "b", "hops", "nodes", "states")
        done = hit if done is None else done.unionByName(hit)
    return done


def _asset_sides(edges: DataFrame, assets: DataFrame) -> DataFrame:
    dim = assets.select("entity_ref", "criticality", "internet_exposed", "environment")
    src = dim.select(F.col("entity_ref").alias("src"), F.col("internet_exposed").alias("s_exposed"), F.col("environment").alias("s_env"))
    dst = dim.select(F.col("entity_ref").alias("dst"), F.col("internet_exposed").alias("d_exposed"), F.col("environment").alias("d_env"), F.col("criticality").alias("d_criticality"))
    return edges.join(src, "src", "left").join(dst, "dst", "left")


def crosses_boundary(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Directed links with ``crosses``: from exposed or unknown into an internal asset, or between environments."""
    e = _asset_sides(links(edges, directed=True), assets)
    internal = F.col("d_exposed").isNotNull() & ~F.col("d_exposed")
    crosses = (F.coalesce("s_exposed", F.lit(False)) & internal) | F.coalesce(F.col("s_env") != F.col("d_env"), F.lit(False)) | (F.col("s_exposed").isNull() & internal)
    return e.withColumn("crosses", crosses)


def access_relation(mapped: bool = True) -> Column:
    rel = F.col("relation")
    if mapped:
        for k, v in WRITE_PATH.items():
            rel = F.when(F.col("relation") == k, v).otherwise(rel)
    return rel.isin(*ACCESS)


def compromise_state(edges: DataFrame, assets: DataFrame, hops: int = 4, map_relations: bool = True) -> DataFrame:
    """(node, state, via): compromised by an observed or inferred access over a boundary, else at risk within ``hops`` of one."""
    c = crosses_boundary(edges, assets).where(access_relation(map_relations) & F.col("crosses") & F.col("state").isin("observed", "inferred"))
    rank = F.when(F.col("state") == "observed", 2).otherwise(1)
    hit = c.groupBy(F.col("dst").alias("node")).agg(F.max(rank).alias("r"), F.min_by("src", F.struct(-rank, "src")).alias("via"))
    hit = _cut(hit.select("node", F.when(F.col("r") == 2, "compromised_observed").otherwise("compromised_inferred").alias("state"), "via"))
    directed = edges.where(access_relation(map_relations))
    near = bfs(directed, hit, hops, ("observed", "inferred", "potential"), directed=True).join(hit, "node", "left_anti")
    return hit.unionByName(near.select("node", F.lit("at_risk_potential").alias("state"), F.lit(None).cast("string").alias("via")))


def potential_paths(edges: DataFrame, compromise: DataFrame, assets: DataFrame, hops: int = 4, n: int = 50) -> DataFrame:
    """(source, target, hops, nodes, states): the shortest directed path from a compromised node to each critical asset; a path stops at a target.

    Of paths that are equally short, the first by source and nodes.  A node carries its two best ways from different sources, of which one
    does not begin at the target, so that all sources are searched at once and a hub does not multiply walks.
    """
    goal = _cut(assets.where("criticality = 'critical'").select(F.col("entity_ref").alias("target")).distinct())
    e = _cut(links(edges, ("observed", "inferred", "potential"), directed=True).where("src != dst").groupBy("src", "dst").agg(F.min("state").alias("state")))
    none = F.array().cast("array<string>")
    ways = compromise.where(F.col("state").startswith("compromised")).select("node", F.col("node").alias("source"), F.lit(0).alias("hops"), F.array("node").alias("nodes"), none.alias("states")).dropDuplicates(["node"])
    known = frontier = _cut(ways)
    order = Window.partitionBy("node").orderBy("hops", "source", "nodes", "states")
    for d in range(1, hops + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        step = step.select(F.col("dst").alias("node"), "source", F.lit(d).alias("hops"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("states", F.col("state")).alias("states"))
        best = step.groupBy("node", "source", "hops").agg(F.min(F.struct("nodes", "states")).alias("p")).select("node", "source", "hops", "p.nodes", "p.states")
        new = best.join(known, ["node", "source"], "left_anti")
        # The ways that are known already stay; new ones fill up to two.
        ranked = known.unionByName(new).withColumn("n", F.row_number().over(order)).where("n <= 2").drop("n")
        known = _cut(ranked)
        frontier = known.where(F.col("hops") == d).join(goal, F.col("node") == F.col("target"), "left_anti")
        if frontier.isEmpty():
            break
    reached = known.where("hops > 0").join(goal, F.col("node") == F.col("target"))
    best = reached.groupBy("target").agg(F.min(F.struct("hops", "source", "nodes", "states")).alias("p"))
    return best.select("p.source", "target", "p.hops", "p.nodes", "p.states").orderBy("hops", "target").limit(n)


def observed_paths(edges: DataFrame, compromise: DataFrame) -> DataFrame:
    """(source, target, hops, nodes, states): for each compromised node the link that compromised it, as an observed path."""
    c = compromise.where("via is not null").select(F.col("via").alias("a"), F.col("node").alias("b"))
    p = shortest_paths(edges, c, 4, ("observed",), 1)
    direct = c.join(p.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(1).alias("hops"), F.array("a", "b").alias("nodes"), F.array(F.lit("inferred")).alias("states"))
    return p.unionByName(direct).select(F.col("a").alias("source"), F.col("b").alias("target"), "hops", "nodes", "states")


def path_risk(paths: DataFrame, assets: DataFrame) -> DataFrame:
    """Paths with risk: the weights of their steps times the target's criticality."""
    weight = F.create_map(*[x for k, v in STEP_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    factor = F.create_map(*[x for k, v in CRITICALITY_FACTOR.items() for x in (F.lit(k), F.lit(v))])
    total = F.aggregate("states", F.lit(0.0), lambda a, s: a + F.coalesce(weight[s], F.lit(0.0)))
    dim = assets.select(F.col("entity_ref").alias("target"), "criticality").dropDuplicates(["target"])
    return paths.join(dim, "target", "left").withColumn("risk", F.round(total * F.coalesce(factor[F.col("criticality")], F.lit(0.4)), 4))


#: Most nodes and edges of a snapshot.
SNAPSHOT_NODES, SNAPSHOT_EDGES = 1000, 5000


def snapshot(edges: DataFrame, roots: DataFrame, compromise: DataFrame, assets: DataFrame, depth: int = 2, nodes: int = SNAPSHOT_NODES, coverage: DataFrame | None = None, n_edges: int = SNAPSHOT_EDGES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the subgraph around some roots: what a screen can show, with overlays.

    Nodes, the nearest first, have their compromise state, asset columns and, from ``coverage`` (host, pct), how well they are watched.
    Edges between them have their state, whether they cross a boundary, and the state of their end; where there are more than
    ``n_edges``, those between near nodes come first, then the surer ones.
    """
    n = _cut(bfs(edges, roots, depth).orderBy("depth", "node").limit(nodes))
    dim = assets.select(F.col("entity_ref").alias("node"), "criticality", "environment", "internet_exposed").dropDuplicates(["node"])
    state = compromise.select("node", F.col("state").alias("compromise"))
    out = n.join(state, "node", "left").join(dim, "node", "left")
    if coverage is not None:
        out = out.join(coverage.select(F.concat(F.lit("host:"), "host").alias("node"), F.col("pct").alias("coverage_pct")), "node", "left")
    inside = lambda side: F.broadcast(n.select(F.col("node").alias(side), F.col("depth").alias(f"{side}_depth")))  # noqa: E731  a thousand rows at most
    e = crosses_boundary(edges, assets).select("src", "dst", "relation", "state", "crosses").join(inside("src"), "src").join(inside("dst"), "dst")
    sure = F.when(F.col("state") == "observed", 0).when(F.col("state") == "inferred", 1).when(F.col("state") == "potential", 2).otherwise(3)
    e = e.orderBy(F.greatest("src_depth", "dst_depth"), F.least("src_depth", "dst_depth"), sure, "src", "dst", "relation").limit(n_edges).drop("src_depth", "dst_depth")
    return out, e.join(state.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", "relation", "state", "crosses", "compromise")


def node_what_next(edges: DataFrame, steps: DataFrame, node: str) -> DataFrame:
    """(kind, what): expected techniques of the node's active runs, and where its access edges lead."""
    host = node.split(":", 1)[-1]
    a = steps.where((F.col("host") == host) & (F.col("status") == "expected")).select(F.lit("technique").alias("kind"), F.col("technique").alias("what"))
    b = links(edges.where(access_relation()), directed=True).where(F.col("src") == node).select(F.lit("edge").alias("kind"), F.col("dst").alias("what"))
    return a.unionByName(b).distinct()


def graph_brief(edges: DataFrame, compromise: DataFrame, hosts: list[str], n: int = 25) -> DataFrame:
    """(src, dst, relation, state, compromise): edges that touch the hosts, with the destination's compromise state."""
    refs = [f"host:{h}" for h in hosts]
    e = links(edges, directed=True).where(F.col("src").isin(*refs) | F.col("dst").isin(*refs))
    return e.join(compromise.select(F.col("node").alias("dst"), F.col("state").alias("compromise")), "dst", "left").orderBy("src", "dst", "relation").limit(n)


def entity_neighbors(edges: DataFrame, node: str) -> DataFrame:
    """(node, paths): neighbours of neighbours with the number of ways to them; links of the same ends are counted before they are joined."""
    e = links(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    one = e.where(F.col("src") == node).select(F.col("dst").alias("mid"), F.col("m").alias("w"))
    return one.join(e, F.col("mid") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("m")).alias("paths"))
