"""Queries of threat models: assets of several types over the customers, links of the events, some of them to data stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import threatmodel as tm
from .security import graph

# Every sixth asset is a database, every tenth an application; every eleventh lies in no environment.
_TYPED = """ta AS (SELECT entity_ref, name, criticality, internet_exposed, k, CASE WHEN k % 6 = 1 THEN 'database' WHEN k % 10 = 2 THEN 'application' ELSE 'host' END AS entity_type, CASE WHEN k % 11 <> 0 THEN environment END AS environment FROM assets)"""
# Two processes are databases that hosts read.
_EDGES = """le AS (SELECT from_type || ':' || from_value AS src, CASE WHEN to_type = 'process' AND to_value IN ('p1', 'p3') THEN 'database' ELSE to_type END || ':' || to_value AS dst,
  CASE WHEN to_type = 'process' AND to_value IN ('p1', 'p3') THEN 'reads' ELSE relation END AS relation, status FROM state)"""


def _typed(assets: DataFrame) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 6 == 1, "database").when(k % 10 == 2, "application").otherwise("host")
    return assets.withColumns({"entity_type": kind, "environment": F.when(k % 11 != 0, F.col("environment"))})


def _edges(edges: DataFrame) -> DataFrame:
    store = (F.col("to_type") == "process") & F.col("to_value").isin("p1", "p3")
    return edges.withColumns({"to_type": F.when(store, "database").otherwise(F.col("to_type")), "relation": F.when(store, "reads").otherwise(F.col("relation"))})


def _model(assets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, links = tm.tm_nodes(assets, edges), tm.tm_edges(assets, edges)
    return nodes, links, tm.tm_threats(assets, nodes, links)


def _model_sql(n: str, assets: str = "ta", edges: str = "le") -> str:
    """CTEs nd, eg and th with a suffix: a model of assets and edges."""
    kind = "CASE lower({0}) WHEN 'database' THEN 'data_store' WHEN 'db' THEN 'data_store' WHEN 'application' THEN 'application' WHEN 'app' THEN 'application' WHEN 'cloud_resource' THEN 'cloud_resource' WHEN 'cloud' THEN 'cloud_resource' ELSE 'asset' END"
    end = f"CASE WHEN {{0}} IN (SELECT entity_ref FROM {assets}) THEN {{0}} ELSE 'ext:' || {{0}} END"
    return f"""kn{n} AS (SELECT src, dst, relation, status FROM {edges} WHERE status IN ('observed', 'inferred')),
 nd{n} AS (SELECT entity_ref AS node, {kind.format("entity_type")} AS kind, name AS label, entity_ref, 'observed' AS basis FROM {assets}
  UNION ALL SELECT 'ep:' || entity_ref, 'entry_point', 'Entry point: ' || name, entity_ref, 'observed' FROM {assets} WHERE internet_exposed
  UNION ALL SELECT DISTINCT 'tb:internet', 'trust_boundary', 'Internet', NULL, 'inferred' FROM {assets} WHERE internet_exposed
  UNION ALL SELECT DISTINCT 'tb:' || environment, 'trust_boundary', 'Boundary: ' || environment, NULL, 'assumed' FROM {assets} WHERE environment IS NOT NULL
  UNION ALL SELECT 'ext:' || r, {kind.format("split_part(r, ':', 1)")}, substr(r, instr(r, ':') + 1), r, 'inferred' FROM (SELECT src AS r FROM kn{n} UNION SELECT dst FROM kn{n}) WHERE r NOT IN (SELECT entity_ref FROM {assets})),
 eg{n} AS (SELECT src, dst, relation, CASE min(CASE basis WHEN 'observed' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END) WHEN 0 THEN 'observed' WHEN 1 THEN 'inferred' ELSE 'assumed' END AS basis FROM (
  SELECT 'ep:' || entity_ref AS src, entity_ref AS dst, 'exposes' AS relation, 'observed' AS basis FROM {assets} WHERE internet_exposed
  UNION ALL SELECT 'ep:' || entity_ref, 'tb:internet', 'resides_in', 'inferred' FROM {assets} WHERE internet_exposed
  UNION ALL SELECT entity_ref, 'tb:' || environment, 'resides_in', 'assumed' FROM {assets} WHERE NOT internet_exposed AND environment IS NOT NULL
  UNION ALL SELECT {end.format("src")}, {end.format("dst")}, CASE relation WHEN 'connected_to' THEN 'flows_to' WHEN 'auth_from' THEN 'authenticates' WHEN 'executed' THEN 'executes' ELSE relation END, status FROM kn{n}) WHERE src <> dst GROUP BY 1, 2, 3),
 t0{n} AS (SELECT entity_ref AS node, NULL AS edge, u.* FROM {assets}, LATERAL (VALUES ('spoofing', 'exploitation', 'possible', CASE criticality WHEN 'critical' THEN 'critical' ELSE 'high' END, 'assumed'),
   ('information_disclosure', 'exploitation', 'possible', CASE criticality WHEN 'critical' THEN 'critical' ELSE 'high' END, 'assumed'),
   ('elevation_of_privilege', 'exploitation', 'possible', 'high', 'assumed'), ('denial_of_service', 'exploitation', 'possible', 'medium', 'assumed')) u(stride, phase, likelihood, impact, basis) WHERE internet_exposed
  UNION ALL SELECT node, NULL, u.* FROM nd{n}, (VALUES ('tampering', 'actions_on_objectives', 'possible', 'high', 'assumed'), ('information_disclosure', 'actions_on_objectives', 'possible', 'high', 'assumed')) u(stride, phase, likelihood, impact, basis) WHERE kind = 'data_store'
  UNION ALL SELECT DISTINCT NULL, src || '→' || dst, 'elevation_of_privilege', 'actions_on_objectives', 'likely', 'high', 'inferred' FROM eg{n} WHERE relation IN ('lateral_movement', 'flows_to') AND basis = 'observed'),
 th{n} AS (SELECT *, concat_ws('|', stride, coalesce(node, ''), coalesce(edge, ''), phase) AS item FROM t0{n})"""


# Techniques and mitigations of the categories that the templates use, the first mention first.
_CROSSWALK = """cw(stride, techniques, mitigations) AS (VALUES ('spoofing', 'T1110,T1078,T1568', 'DF_43,DF_48,DF_53'), ('tampering', 'T1070,T1562,T1602', 'DF_54,DF_94'),
  ('information_disclosure', 'T1005,T1039,T1213,T1530', 'DF_74,DF_85,DF_64'), ('denial_of_service', 'T1499', 'DF_31,DF_04'), ('elevation_of_privilege', 'T1068,T1548,T1547', 'DF_02,DF_13,DF_40'))"""
_CONTROL_NAMES = """ct(ref, control_id) AS (VALUES ('DF_43', 'ctl_mfa'), ('DF_48', 'ctl_password'), ('DF_53', 'ctl_lockout'), ('DF_54', 'ctl_logging'), ('DF_94', 'ctl_anti_tamper'), ('DF_74', 'ctl_file_isolation'), ('DF_85', 'ctl_file_monitoring'),
  ('DF_64', 'ctl_backup'), ('DF_31', 'ctl_net_filtering'), ('DF_04', 'ctl_rate_limit'), ('DF_02', 'ctl_access_control'), ('DF_13', 'ctl_least_privilege'), ('DF_40', 'ctl_code_signing'))"""
_BASE = f"{_TYPED}, {_EDGES}, {_model_sql('')}"

graph("M5_tm_nodes", f"WITH {_BASE} SELECT node, kind, label, entity_ref, basis FROM nd")(lambda e, n, a_: _model(_typed(a_), _edges(e))[0])
graph("M6_tm_edges", f"WITH {_BASE} SELECT * FROM eg")(lambda e, n, a_: _model(_typed(a_), _edges(e))[1])
graph("M7_tm_threats", f"WITH {_BASE}, {_CROSSWALK} SELECT node, edge, stride, phase, techniques, mitigations, likelihood, impact, basis FROM th JOIN cw USING (stride)")(
    lambda e, n, a_: _model(_typed(a_), _edges(e))[2].drop("threat_id").withColumns({c: F.array_join(c, ",") for c in ("techniques", "mitigations")}))
graph("M8_tm_controls", f"WITH {_BASE}, {_CROSSWALK}, {_CONTROL_NAMES} SELECT control_id, mapping_state, count(*) AS n FROM (SELECT DISTINCT item, control_id, 'assumed' AS mapping_state FROM (SELECT item, unnest(string_split(mitigations, ',')) AS ref FROM th JOIN cw USING (stride)) JOIN ct USING (ref)) GROUP BY 1, 2")(
    lambda e, n, a_: tm.tm_controls(_model(_typed(a_), _edges(e))[2]).groupBy("control_id", "mapping_state").agg(F.count(F.lit(1)).alias("n")))

# Before: without every tenth asset, with others that are gone now, each a step less critical, and with no links of users.
_BEFORE = """pa AS (SELECT * REPLACE (CASE criticality WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END AS criticality) FROM ta WHERE k % 10 <> 3),
 na AS (SELECT * FROM ta WHERE k % 10 <> 5), pe AS (SELECT * FROM le WHERE NOT starts_with(src, 'user:')), ne AS (SELECT * FROM le WHERE NOT ends_with(dst, ':p3'))"""
_DRIFT = f"""WITH {_TYPED}, {_EDGES}, {_BEFORE}, {_model_sql("_p", "pa", "pe")}, {_model_sql("_n", "na", "ne")},
 rk AS (SELECT item, o.r AS old, w.r AS now FROM (SELECT item, list_position(['low', 'medium', 'high', 'critical'], impact) AS r FROM th_p) o FULL JOIN (SELECT item, list_position(['low', 'medium', 'high', 'critical'], impact) AS r FROM th_n) w USING (item)),
 pg AS (SELECT src || '→' || dst || ':' || relation AS item FROM eg_p), ng AS (SELECT src || '→' || dst || ':' || relation AS item FROM eg_n)
 SELECT 'node' AS kind, 'added' AS change, node AS item FROM nd_n WHERE node NOT IN (SELECT node FROM nd_p) UNION ALL SELECT 'node', 'removed', node FROM nd_p WHERE node NOT IN (SELECT node FROM nd_n)
 UNION ALL SELECT 'edge', 'added', item FROM ng WHERE item NOT IN (SELECT item FROM pg) UNION ALL SELECT 'edge', 'removed', item FROM pg WHERE item NOT IN (SELECT item FROM ng)
 UNION ALL SELECT 'threat', 'added', item FROM rk WHERE old IS NULL UNION ALL SELECT 'threat', 'removed', item FROM rk WHERE now IS NULL
 UNION ALL SELECT 'risk', 'added', item FROM rk WHERE (old IS NULL AND now >= 3) OR now > old UNION ALL SELECT 'risk', 'removed', item FROM rk WHERE now IS NULL AND old >= 3"""


@graph("M9_tm_drift", _DRIFT)
def _drift(e, n, a_):
    assets, edges = _typed(a_), _edges(e)
    lower = F.when(F.col("criticality") == "critical", "high").when(F.col("criticality") == "high", "medium").otherwise("low")
    prev = _model(assets.where("k % 10 != 3").withColumn("criticality", lower), edges.where("from_type != 'user'"))
    new = _model(assets.where("k % 10 != 5"), edges.where("to_value != 'p3'"))
    # A threat's id is a digest; here it is named by what it is a digest of.
    named = lambda m: (m[0], m[1], m[2].withColumn("threat_id", F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("stride", "node", "edge", "phase")])))
    return tm.tm_drift(named(prev), named(new))
