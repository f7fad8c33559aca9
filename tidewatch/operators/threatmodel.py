"""Threat models from what is observed: nodes, edges and threats with a basis, controls for them, and the drift between two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import WRITE_PATH, links

# Node kinds of entity types, and model relations of observed ones; all others are assets, and stay as they are.
KINDS = {"database": "data_store", "db": "data_store", "application": "application", "app": "application", "cloud_resource": "cloud_resource", "cloud": "cloud_resource"}
RELATIONS = {"connects_to": "flows_to", "connects": "flows_to", "network_flow": "flows_to", "login": "authenticates", "logon": "authenticates", "auth": "authenticates"}

# Techniques of a threat category, defences against a technique, and the control that is each defence.
TECHNIQUES = {
    "spoofing": ("T1110", "T1078", "T1568"),
    "tampering": ("T1070", "T1562", "T1602"),
    "repudiation": ("T1070", "T1490", "T1621"),
    "information_disclosure": ("T1005", "T1039", "T1213", "T1530"),
    "denial_of_service": ("T1499",),
    "elevation_of_privilege": ("T1068", "T1548", "T1547"),
}
DEFENCES = {
    "T1005": ("DF_74", "DF_85"), "T1039": ("DF_74",), "T1041": ("DF_31", "DF_66"), "T1059": ("DF_14", "DF_40"), "T1068": ("DF_02", "DF_13"),
    "T1070": ("DF_54", "DF_94"), "T1071": ("DF_31", "DF_98"), "T1078": ("DF_43", "DF_48"), "T1105": ("DF_14", "DF_31"),
    "T1110": ("DF_43", "DF_48", "DF_53"), "T1132": ("DF_31", "DF_66"), "T1190": ("DF_22", "DF_14"), "T1213": ("DF_85", "DF_74"), "T1485": ("DF_64",),
    "T1490": ("DF_54", "DF_94"), "T1499": ("DF_31", "DF_04"), "T1530": ("DF_74", "DF_64"), "T1543": ("DF_40", "DF_85"), "T1547": ("DF_40",),
    "T1548": ("DF_02", "DF_13"), "T1562": ("DF_94",), "T1566": ("DF_14", "DF_49"), "T1567": ("DF_64",), "T1568": ("DF_43", "DF_48"),
    "T1571": ("DF_31", "DF_66"), "T1583": ("DF_94",), "T1587": ("DF_85",), "T1592": ("DF_31",), "T1595": ("DF_31", "DF_98"), "T1602": ("DF_94",),
    "T1621": ("DF_54", "DF_94"),
}
CONTROLS = {
    "DF_02": "ctl_access_control", "DF_04": "ctl_rate_limit", "DF_13": "ctl_least_privilege", "DF_14": "ctl_app_filtering", "DF_22": "ctl_waf",
    "DF_31": "ctl_net_filtering", "DF_40": "ctl_code_signing", "DF_43": "ctl_mfa", "DF_48": "ctl_password", "DF_49": "ctl_email_filtering",
    "DF_53": "ctl_lockout", "DF_54": "ctl_logging", "DF_64": "ctl_backup", "DF_66": "ctl_net_encryption", "DF_74": "ctl_file_isolation",
    "DF_85": "ctl_file_monitoring", "DF_94": "ctl_anti_tamper", "DF_98": "ctl_net_anomaly",
}
# Templates by where they apply: category, phase, likelihood, impact and basis.  An impact of None goes by the asset's criticality.
TEMPLATES = {
    "exposed": (
        ("spoofing", "exploitation", "possible", None, "assumed"), ("information_disclosure", "exploitation", "possible", None, "assumed"),
        ("elevation_of_privilege", "exploitation", "possible", "high", "assumed"), ("denial_of_service", "exploitation", "possible", "medium", "assumed"),
    ),
    "data_store": (
        ("tampering", "actions_on_objectives", "possible", "high", "assumed"), ("information_disclosure", "actions_on_objectives", "possible", "high", "assumed"),
    ),
    "flow": (("elevation_of_privilege", "actions_on_objectives", "likely", "high", "inferred"),),
}
#: Impacts from the least.
IMPACTS = ("low", "medium", "high", "critical")


def _named(value: Column, names: dict[str, str], other: Column) -> Column:
    out = F
    for name in dict.fromkeys(names.values()):
        out = out.when(F.lower(value).isin(*[k for k, v in names.items() if v == name]), name)
    return out.otherwise(other)


def node_kind(entity_type: Column) -> Column:
    return _named(entity_type, KINDS, F.lit("asset"))


def model_relation(relation: Column, mapped: bool = True) -> Column:
    """The model's name of a relation; ``mapped``: from the names that events give."""
    if mapped:
        relation = _named(relation, WRITE_PATH, relation)
    return _named(relation, RELATIONS, relation)


def _known(edges: DataFrame) -> DataFrame:
    """Observed and inferred links; what only could be is no part of a model."""
    return links(edges, ("observed", "inferred"), directed=True)


def tm_nodes(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kind, label, entity_ref, basis) of a model: assets, their entry points, trust boundaries, and entities that only links name.

    ``assets`` has entity_ref, entity_type, name, environment and internet_exposed.  Every node comes once.
    """
    a = assets.select(F.col("entity_ref").alias("node"), node_kind(F.col("entity_type")).alias("kind"), F.col("name").alias("label"), "entity_ref", F.lit("observed").alias("basis")).dropDuplicates(["node"])
    exposed = assets.where("internet_exposed")
    entry = exposed.select(F.concat(F.lit("ep:"), "entity_ref").alias("node"), F.lit("entry_point").alias("kind"), F.concat(F.lit("Entry point: "), "name").alias("label"), "entity_ref", F.lit("observed").alias("basis")).dropDuplicates(["node"])
    none = F.lit(None).cast("string")
    internet = exposed.select(F.lit("tb:internet").alias("node"), F.lit("trust_boundary").alias("kind"), F.lit("Internet").alias("label"), none.alias("entity_ref"), F.lit("inferred").alias("basis")).distinct()
    zone = assets.where("environment is not null and environment != ''").select("environment").distinct()
    zone = zone.select(F.concat(F.lit("tb:"), "environment").alias("node"), F.lit("trust_boundary").alias("kind"), F.concat(F.lit("Boundary: "), "environment").alias("label"), none.alias("entity_ref"), F.lit("assumed").alias("basis"))
    ref = F.col("entity_ref")
    outside = _known(edges).select(F.explode(F.array("src", "dst")).alias("entity_ref")).distinct().join(assets.select("entity_ref"), "entity_ref", "left_anti")
    value = F.expr("substring(entity_ref, instr(entity_ref, ':') + 1)")
    ext = outside.select(F.concat(F.lit("ext:"), ref).alias("node"), node_kind(F.substring_index(ref, ":", 1)).alias("kind"), value.alias("label"), "entity_ref", F.lit("inferred").alias("basis"))
    return a.unionByName(entry).unionByName(internet).unionByName(zone).unionByName(ext)


def tm_edges(assets: DataFrame, edges: DataFrame, mapped: bool = True) -> DataFrame:
    """(src, dst, relation, basis): exposes, resides_in and the known links, once each and without loops; an observed basis wins."""
    ref, exposed = F.col("entity_ref"), F.coalesce("internet_exposed", F.lit(False))
    entry = F.concat(F.lit("ep:"), ref)
    open_ = assets.where(exposed)
    x = open_.select(entry.alias("src"), ref.alias("dst"), F.lit("exposes").alias("relation"), F.lit("observed").alias("basis"))
    outside = open_.select(entry.alias("src"), F.lit("tb:internet").alias("dst"), F.lit("resides_in").alias("relation"), F.lit("inferred").alias("basis"))
    inside = assets.where(~exposed & (F.coalesce("environment", F.lit("")) != "")).select(ref.alias("src"), F.concat(F.lit("tb:"), "environment").alias("dst"), F.lit("resides_in").alias("relation"), F.lit("assumed").alias("basis"))
    known = assets.select(ref.alias("known")).distinct()
    own = _known(edges)
    for side in ("src", "dst"):
        own = own.join(known, F.col(side) == F.col("known"), "left").withColumn(side, F.when(F.col("known").isNull(), F.concat(F.lit("ext:"), side)).otherwise(F.col(side))).drop("known")
    own = own.select("src", "dst", model_relation(F.col("relation"), mapped).alias("relation"), F.col("state").alias("basis")).where("src != dst")
    rank = F.when(F.col("basis") == "observed", 0).when(F.col("basis") == "inferred", 1).otherwise(2)
    every = x.unionByName(outside).unionByName(inside).unionByName(own)
    return every.groupBy("src", "dst", "relation").agg(F.min_by("basis", rank).alias("basis"))


def _array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _template(name: str) -> Column:
    fields = ("stride", "phase", "likelihood", "impact", "basis")
    rows = []
    for t in TEMPLATES[name]:
        techniques = TECHNIQUES[t[0]]
        defences = list(dict.fromkeys(d for x in techniques for d in DEFENCES.get(x, ())))
        rows.append(F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, t, strict=True)], _array(techniques).alias("techniques"), _array(defences).alias("mitigations")))
    return F.array(*rows)


def tm_threats(assets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(threat_id, node, edge, stride, phase, techniques, mitigations, likelihood, impact, basis) of a model's nodes and edges.

    Four threats to each exposed asset, of which two grow with its criticality, two to each data store, and one for each flow or lateral
    movement that was observed.  Techniques go by category, mitigations by technique, the first mention first.
    """
    none = F.lit(None).cast("string")
    exposed = assets.where("internet_exposed").dropDuplicates(["entity_ref"]).select(F.col("entity_ref").alias("node"), none.alias("edge"), "criticality", F.explode(_template("exposed")).alias("t"))
    stores = nodes.where("kind = 'data_store'").select("node", none.alias("edge"), none.alias("criticality"), F.explode(_template("data_store")).alias("t"))
    moves = edges.where("relation in ('lateral_movement', 'flows_to') and basis = 'observed'").select("src", "dst").distinct()
    flows = moves.select(none.alias("node"), F.concat("src", F.lit("→"), "dst").alias("edge"), none.alias("criticality"), F.explode(_template("flow")).alias("t"))
    out = exposed.unionByName(stores).unionByName(flows).select("node", "edge", "criticality", "t.*")
    impact = F.coalesce("impact", F.when(F.col("criticality") == "critical", "critical").otherwise("high"))
    # An exposed data store has two different threats of one category: the phase tells them apart.
    key = [F.coalesce(F.col(c), F.lit("")) for c in ("stride", "node", "edge", "phase")]
    threat = F.concat(F.lit("thr-"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 16))
    return out.select(threat.alias("threat_id"), "node", "edge", "stride", "phase", "techniques", "mitigations", "likelihood", impact.alias("impact"), "basis")


def tm_controls(threats: DataFrame, controls: dict[str, str] | None = None) -> DataFrame:
    """(threat_id, control_id, mapping_state): the controls that are a threat's mitigations, each once."""
    names = F.create_map(*[F.lit(x) for kv in (controls or CONTROLS).items() for x in kv])
    each = threats.select("threat_id", F.explode(F.array_distinct(F.transform("mitigations", lambda m: names[F.upper(m)]))).alias("control_id"))
    return each.where("control_id is not null").select("threat_id", "control_id", F.lit("assumed").alias("mapping_state"))


def _rank(impact: Column) -> Column:
    return F.coalesce(F.array_position(_array(IMPACTS), impact), F.lit(0))


def tm_drift(prev: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(kind, change, item) between two models, each its nodes, edges and threats.

    Nodes, edges (``src→dst:relation``) and threats are added or removed.  Of kind risk, a threat is added that is new and high or worse,
    or whose impact has grown, and one is removed that was high or worse and is gone.
    """
    edge = lambda e: e.select(F.concat("src", F.lit("→"), "dst", F.lit(":"), "relation").alias("item"))
    items = []
    for kind, a, b in (("node", prev[0].select(F.col("node").alias("item")), new[0].select(F.col("node").alias("item"))), ("edge", edge(prev[1]), edge(new[1]))):
        j = a.distinct().withColumn("old", F.lit(True)).join(b.distinct().withColumn("now", F.lit(True)), "item", "full_outer").where("old is null or now is null")
        items.append(j.select(F.lit(kind).alias("kind"), F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"), "item"))
    a, b = (t.select(F.col("threat_id").alias("item"), _rank(F.col("impact")).alias(n)).dropDuplicates(["item"]) for t, n in ((prev[2], "old"), (new[2], "now")))
    j = a.join(b, "item", "full_outer")
    high = IMPACTS.index("high") + 1
    change = lambda kind, word: F.struct(F.lit(kind).alias("kind"), F.lit(word).alias("change"))
    rules = F.array(
        F.when(F.col("old").isNull(), change("threat", "added")), F.when(F.col("now").isNull(), change("threat", "removed")),
        F.when(F.coalesce(F.col("now") > F.col("old"), F.col("old").isNull() & (F.col("now") >= high)), change("risk", "added")),
        F.when(F.col("now").isNull() & (F.col("old") >= high), change("risk", "removed")),
    )
    items.append(j.select("item", F.explode(F.array_compact(rules)).alias("c")).select("c.kind", "c.change", "item"))
    return items[0].unionByName(items[1]).unionByName(items[2])


__all__ = ["CONTROLS", "DEFENCES", "TECHNIQUES", "model_relation", "node_kind", "tm_controls", "tm_drift", "tm_edges", "tm_nodes", "tm_threats"]
