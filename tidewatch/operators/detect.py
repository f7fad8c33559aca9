"""Detections over event tables: thresholds, sequences, correlations, baselines, novelty, travel, predicate rules, scenarios."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket_start, haversine_km, span_seconds
from .filters import field, tokens
from .ordered import previous, time_window
from .sequences import pending_sequences, sequence_rule  # noqa: F401  part of this module's detections


def micros(x="timestamp") -> Column:
    return F.unix_micros(F.col(x).cast("timestamp"))


def threshold_rule(df: DataFrame, test: Column, count: int | None, window, by: list[str], now) -> DataFrame:
    """Groups with at least ``count`` matching events in the window before ``now``; without keys one group 'global'."""
    lo = now - F.expr(f"interval {span_seconds(window)} seconds")
    hit = df.where(test & (F.col("timestamp") >= lo) & (F.col("timestamp") <= now))
    key = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in by]) if by else F.lit("global")
    firsts = [F.min_by(x, F.struct("timestamp", "id")).alias(x) for x in ("user", "host", "source_ip", "destination_ip") if x in df.columns and x not in by]
    out = hit.withColumn("group_key", key).groupBy("group_key", *by).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), *firsts)
    return out.where(F.col("n") >= (count or 1))


def threshold_rule_windowed(df: DataFrame, test: Column, count: int, window, by: list[str], slide=None) -> DataFrame:
    """The threshold over all of history in tumbling or sliding windows."""
    w = F.window("timestamp", f"{span_seconds(window)} seconds", f"{span_seconds(slide)} seconds" if slide else None)
    out = df.where(test).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def row_rule(result: DataFrame, threshold: float, measure: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of any result whose measure reaches the threshold, by the values of their text columns, with the entities they name."""
    kinds = dict(result.dtypes)
    keys = keys or sorted(x for x in result.columns if x != measure and kinds[x] == "string")
    known = {"user": "user", "host": "host", "source_ip": "ip", "destination_ip": "ip", "src_ip": "ip", "dest_ip": "ip", "process": "process", "service": "service"}
    refs = [F.concat(F.lit(known[k] + ":"), F.col(k)) for k in keys if k in known]
    group = F.concat_ws(",", *[F.concat(F.lit(k + "="), F.coalesce(F.col(k), F.lit(""))) for k in keys]) if keys else F.lit("global")
    out = result.where(F.col(measure) >= threshold).groupBy(group.alias("group_key")).agg(F.max(measure).alias(measure), F.count(F.lit(1)).alias("rows"), F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*refs))))).alias("entities") if refs else F.array().cast("array<string>").alias("entities"))
    return out


def correlation_rule(df: DataFrame, key: str, tests: dict[str, tuple[Column, int]], window, require: str = "all", min_match: int | None = None, base: float = 0.7) -> DataFrame:
    """(key, timestamp, id, matched, confidence): where enough conditions hold over the trailing window, once per episode."""
    names = list(tests)
    need = len(names) if require == "all" else (min_match or len(names) - 1)
    length = span_seconds(window) * 1_000_000
    counts = {f"n_{k}": F.sum(F.when(t, 1).otherwise(0)) for k, (t, _) in tests.items()}
    e = time_window(df.where(F.col(key).isNotNull()), [key], micros(), length, counts)
    matched = reduce(lambda a, b: a + b, [(F.col(f"n_{k}") >= tests[k][1]).cast("int") for k in names])
    e = e.select(key, "timestamp", "id", "__block", matched.alias("matched")).withColumn("on", F.col("matched") >= need)
    e = previous(e, [key], ["timestamp", "id"], "on", "before").withColumn("before", F.coalesce("before", F.lit(False)))
    confidence = F.least(F.lit(0.95), F.lit(base) + 0.05 * (F.col("matched") - need))
    return e.where("on and not before").select(F.col(key).alias("key"), "timestamp", "id", "matched", F.round(confidence, 4).alias("confidence"))


def hourly_baselines(hourly: DataFrame, entity_type: str, feature: str, days: int = 30) -> DataFrame:
    """Mean, deviation, nearest-rank p95 and number of hours from (entity_value, hour, x)."""
    out = hourly.groupBy("entity_value").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("stddev"), F.expr("percentile_disc(0.95) within group (order by x)").cast("double").alias("p95"), F.count(F.lit(1)).alias("sample_count"))
    return out.select(F.lit(entity_type).alias("entity_type"), "entity_value", F.lit(feature).alias("feature"), F.lit(days).alias("window_days"), "mean", "stddev", "p95", "sample_count")


def hourly(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(F.col(key).alias("entity_value"), bucket_start("timestamp", 3600).alias("hour")).agg(value.cast("double").alias("x")).where("entity_value is not null and entity_value != ''")


def login_baselines(df: DataFrame, now, days: int = 30, active_days: int = 7) -> DataFrame:
    """Sign-ins per hour of the users seen in the last week."""
    recent = df.where(F.col("timestamp") > now - F.expr(f"interval {active_days} days")).select("user").distinct()
    past = df.where((F.col("event_type") == "authentication") & (F.col("timestamp") >= now - F.expr(f"interval {days} days")) & (F.col("timestamp") < now)).join(recent, "user", "left_semi")
    return hourly_baselines(hourly(past, "user", F.count(F.lit(1))), "user", "logins_per_hour", days)


def bytes_baselines(df: DataFrame, now, days: int = 30) -> DataFrame:
    past = df.where((F.col("timestamp") >= now - F.expr(f"interval {days} days")) & (F.col("timestamp") < now) & F.col("bytes").isNotNull())
    return hourly_baselines(hourly(past, "host", F.sum("bytes")), "host", "bytes_per_hour", days)


def z_anomalies(observed: DataFrame, baselines: DataFrame) -> DataFrame:
    """Upward deviations from trusted baselines (20 hours or more): bands 2, 3 and 4 give 5, 10 and 15 points."""
    j = observed.join(baselines.where("sample_count >= 20 and window_days >= 14"), ["entity_type", "entity_value", "feature"])
    z = F.when(F.col("stddev") < 1e-9, F.when(F.col("observed") > F.col("mean"), 4.0).otherwise(0.0)).otherwise((F.col("observed") - F.col("mean")) / F.col("stddev"))
    j = j.withColumn("z", z)
    return j.where("z >= 2").withColumn("points", F.when(F.col("z") >= 4, 15).when(F.col("z") >= 3, 10).otherwise(5)).select("entity_type", "entity_value", "feature", "observed", "mean", "stddev", "z", "points")


def novelty(df: DataFrame, entity: str, value: str, feature: str, now, hours: int = 24, points: int = 5) -> DataFrame:
    """Pairs first seen in the last day: one anomaly per entity, its newest pair."""
    first = df.where(F.col(entity).isNotNull() & F.col(value).isNotNull()).groupBy(entity, value).agg(F.min("timestamp").alias("first_seen"))
    new = first.where(F.col("first_seen") >= now - F.expr(f"interval {hours} hours"))
    out = new.groupBy(F.col(entity).alias("entity_value")).agg(F.max_by(value, F.struct("first_seen", value)).alias("value"), F.max("first_seen").alias("first_seen"))
    return out.select(F.lit(entity).alias("entity_type"), "entity_value", F.lit(feature).alias("feature"), "value", "first_seen", F.lit(points).alias("points"))


def impossible_travel(df: DataFrame, speed: float = 900.0) -> DataFrame:
    """Consecutive located sign-ins of a user (latitude, longitude, vpn) faster than ``speed`` km/h; a VPN on either side scores 0."""
    w = Window.partitionBy("user").orderBy("timestamp", "id")
    prev = {f"p_{x}": F.lag(x).over(w) for x in ("latitude", "longitude", "vpn", "timestamp", "id")}
    e = df.where("user is not null and latitude is not null and longitude is not null").withColumns(prev).where("p_id is not null")
    km = haversine_km("p_latitude", "p_longitude", "latitude", "longitude")
    hours = (micros() - micros("p_timestamp")) / 3_600_000_000.0
    e = e.withColumn("km", km).withColumn("hours", hours).where(F.col("km") > speed * F.col("hours"))
    vpn = F.coalesce("vpn", F.lit(False)) | F.coalesce("p_vpn", F.lit(False))
    return e.select("user", "id", "p_id", "timestamp", "km", "hours", F.when(vpn, 0).otherwise(15).alias("points"), F.when(vpn, F.lit("vpn")).alias("suppressed_reason"))


# --- predicate rules -------------------------------------------------------------------------------------------------------

LEVELS = {"informational": "low", "low": "low", "medium": "medium", "high": "high", "critical": "critical"}


class UnsupportedRule(ValueError):
    """A construct that would be dropped silently otherwise."""


def _one(df: DataFrame, key: str, value) -> Column:
    name, *mods = key.split("|")
    x = field(df, name).cast("string")
    unknown = set(mods) - {"contains", "startswith", "endswith", "all"}
    if unknown:
        raise UnsupportedRule(f"modifier {sorted(unknown)}")

    def test(v):
        low, y = str(v).lower(), F.lower(x)
        if "contains" in mods:
            return y.contains(low)
        if "startswith" in mods:
            return y.startswith(low)
        if "endswith" in mods:
            return y.endswith(low)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return (y == low) | (x.try_cast("double") == float(v))
        return y == low if "*" not in low else x.ilike(low.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))

    if value is None:
        return x.isNull() | (x == "")
    values = value if isinstance(value, list) else [value]
    return F.coalesce(reduce(and_ if "all" in mods else or_, map(test, values)), F.lit(False))


def _selection(df: DataFrame, sel) -> Column:
    if isinstance(sel, list):
        return reduce(or_, [_selection(df, s) for s in sel])
    return reduce(and_, [_one(df, k, v) for k, v in sel.items()], F.lit(True))


def rule_condition(df: DataFrame, rule: dict) -> Column:
    """The predicate of a rule of selections and a condition (and, or, not, brackets, all/any/N of them or of name*)."""
    import re

    detection = dict(rule["detection"])
    words = re.findall(r"\(|\)|[^\s()]+", str(detection.pop("condition")))
    sels = {k: _selection(df, v) for k, v in detection.items() if k != "timeframe"}
    at = 0

    def peek():
        return words[at].lower() if at < len(words) else ""

    def take():
        nonlocal at
        at += 1
        return words[at - 1]

    def either():
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both():
        out = single()
        while peek() == "and":
            take()
            out = out & single()
        return out

    def single():
        w = take()
        if w.lower() == "not":
            return ~single()
        if w == "(":
            out = either()
            if take() != ")":
                raise UnsupportedRule("brackets")
            return out
        if peek() == "of":
            take()
            name = take()
            group = [v for k, v in sels.items() if name.lower() == "them" or re.fullmatch(name.replace("*", ".*"), k)]
            if not group:
                raise UnsupportedRule(f"no selection {name}")
            n = len(group) if w.lower() == "all" else 1 if w.lower() == "any" else int(w)
            return reduce(lambda a, b: a + b, [g.cast("int") for g in group]) >= n
        if w not in sels:
            raise UnsupportedRule(f"condition {w}")
        return sels[w]

    out = either()
    if at != len(words):
        raise UnsupportedRule(" ".join(words[at:]))
    product = (rule.get("logsource") or {}).get("product") or (rule.get("logsource") or {}).get("service")
    if product:
        out = out & F.coalesce(F.lower(field(df, "source_type")).contains(product.lower()), F.lit(False))
    return out


def rule_tags(rule: dict) -> tuple[str, str | None, str | None]:
    """(severity, tactic, technique) of a rule."""
    tags = [t.lower().removeprefix("attack.") for t in rule.get("tags", [])]
    technique = next((t.upper() for t in tags if t[:1] == "t" and t[1:5].isdigit()), None)
    tactic = next((t for t in tags if not (t[:1] == "t" and t[1:5].isdigit())), None)
    return LEVELS.get(str(rule.get("level", "medium")).lower(), "medium"), tactic, technique


def sigma_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(id, rule_id, severity, tactic, technique) for all rules in one pass over the events."""
    hits = []
    for r in rules:
        sev, tactic, technique = rule_tags(r)
        hits.append(F.when(rule_condition(df, r), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(tactic).cast("string").alias("tactic"), F.lit(technique).cast("string").alias("technique"))))
    return df.select("id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("id", "h.*")


# --- hunting catalog -------------------------------------------------------------------------------------------------------


def has(*words: str) -> Column:
    """All words are in the message or the attributes."""
    t = tokens("message", "attributes")
    return reduce(and_, [F.array_contains(t, w) for w in words])


def hunts(df: DataFrame) -> dict[str, tuple[Column, list[str], int, str, str, str | None]]:
    """name -> (test, keys, least count, window, severity, techniques).  Fields that are no columns are read from the attributes."""

    def eq(name, *values):
        return F.coalesce(field(df, name).isin(*values), F.lit(False))

    def text(*patterns, name="message"):
        return F.coalesce(reduce(or_, [field(df, name).ilike(x) for x in patterns]), F.lit(False))

    def source(*types):
        return eq("source_type", *types)

    failed, written = eq("outcome", "failure"), eq("action", "create", "modify")
    not_found = F.coalesce(field(df, "status_code").try_cast("double") >= 404, F.lit(False))
    # The catalog's source types, patterns, keys, counts, windows, severities and techniques.
    return {
        "brute_force_login": (eq("event_type", "authentication") & failed, ["source_ip", "user"], 5, "5m", "high", "T1110"),
        "intrusion_attempt": (eq("event_type", "intrusion_attempt"), [], 1, "1h", "critical", None),
        "linux_cron_persistence": (source("os.linux.auditd") & text("/etc/cron%", name="file_path") & written, ["host", "user"], 1, "15m", "high", "T1053.003"),
        "linux_ssh_brute_force": (source("os.linux.sshd") & failed, ["source_ip", "user"], 10, "10m", "medium", "T1110.001,T1021.004"),
        "macos_launchagent_persistence": (source("os.darwin.unified") & text("%/Library/LaunchAgents%", name="file_path") & written, ["host", "user"], 1, "15m", "high", "T1543.001"),
        "net_beaconing": (source("net.firewall.generic") & eq("outcome", "success"), ["host", "destination_ip"], 60, "1h", "high", "T1071"),
        "net_port_scanning": (source("net.firewall.generic") & failed, ["source_ip"], 100, "10m", "medium", "T1595.001"),
        "web_exploitation": (source("web.nginx.access") & text("%../%", "%union+select%", "%/etc/passwd%", r"%\%00%", "%<script%>", "%cmd.exe%"), ["source_ip", "host"], 1, "15m", "high", "T1190"),
        "web_scanning": (source("web.nginx.access") & not_found, ["source_ip"], 50, "10m", "medium", "T1595"),
        "win_lsass_access": (source("os.windows.sysmon") & text("%lsass.exe%", "%comsvcs.dll%") & text("%0x1010%"), ["host", "process"], 1, "15m", "critical", "T1003.001"),
        "win_rdp_lateral_movement": (source("os.windows.security") & eq("event_type", "authentication") & text("%4624%") & text("%10%"), ["user", "source_ip"], 3, "1h", "high", "T1021.001"),
        "win_scheduled_task_persistence": (source("os.windows.security") & eq("event_type", "admin") & text("%4698%", "%Task Scheduler%", "%schtasks%"), ["host", "user"], 1, "15m", "high", "T1053.005"),
        "win_suspicious_powershell": (
            source("os.windows.powershell") & eq("process", "powershell.exe") & text("%-enc%", "%-EncodedCommand%", "%-NonInteractive%", "%IEX%", "%FromBase64String%", "%DownloadString%"),
            ["host", "user"], 1, "15m", "high", "T1059.001,T1105",
        ),
    }


def hunting_catalog(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(rule, severity, technique, window_start, group_key, n) of all hunts in tumbling windows, in one scan and one aggregation.

    Techniques are joined by commas, null for a hunt without one; a hunt without keys has the one group 'global'.
    """
    hits = []
    for name, (test, keys, count, window, severity, technique) in hunts(df).items():
        if names is None or name in names:
            group = F.concat_ws("|", *[F.coalesce(field(df, k), F.lit("")) for k in keys]) if keys else F.lit("global")
            start = bucket_start("timestamp", span_seconds(window))
            hits.append(F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(technique).cast("string").alias("technique"), F.lit(count).alias("least"), start.alias("window_start"), group.alias("group_key"))))
    each = df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*")
    return each.groupBy("rule", "severity", "technique", "least", "window_start", "group_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("least")).drop("least")


# --- techniques and scenarios ----------------------------------------------------------------------------------------------


def mapping_condition(df: DataFrame, when: dict) -> Column:
    """ANDed conditions: contains, regex (both over the message, any case), source_type, event_type, outcome, attribute regexes."""
    tests = []
    for k, v in when.items():
        if k == "contains":
            tests.append(F.lower("message").contains(v.lower()))
        elif k == "regex":
            tests.append(F.col("message").rlike("(?i)" + v))
        elif k == "attribute":
            tests += [F.coalesce(F.get_json_object("attributes", f"$['{a}']").rlike("(?i)" + r), F.lit(False)) for a, r in v.items()]
        else:
            tests.append(F.lower(field(df, k)) == str(v).lower())
    return F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))


def attack_map(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(id, technique, tactic, confidence, rule): techniques of each event, of a repeated one the most confident rule."""
    hits = [F.when(mapping_condition(df, r["when"]), F.struct(F.lit(r["technique"]).alias("technique"), F.lit(float(r["confidence"])).alias("confidence"), F.lit(r["tactic"]).alias("tactic"), F.lit(r["id"]).alias("rule"))) for r in rules]
    found = F.array_compact(F.array(*hits))
    # Within a row: no shuffle is needed to keep the best of each technique.
    best = F.filter(found, lambda a: ~F.exists(found, lambda b: (b["technique"] == a["technique"]) & ((b["confidence"] > a["confidence"]) | ((b["confidence"] == a["confidence"]) & (b["rule"] < a["rule"])))))
    keep = [x for x in ("host", "user", "timestamp", "outcome") if x in df.columns]
    return df.select("id", *keep, F.explode(best).alias("m")).select("id", *keep, "m.technique", "m.tactic", "m.confidence", "m.rule")


def technique_events(mapped: DataFrame, technique: str, n: int) -> DataFrame:
    return mapped.where((F.col("technique") == technique) | F.col("technique").startswith(technique + ".")).orderBy(F.desc("timestamp"), "id").limit(n)


def scenario_runs(mapped: DataFrame, scenario: dict, now) -> DataFrame:
    """(run_id, scenario, host, started_at): hosts where the trigger technique was seen in the last six hours."""
    hit = mapped.where((F.col("technique") == scenario["trigger"]) & (F.col("timestamp") >= now - F.expr("interval 6 hours")) & (F.col("timestamp") <= now) & F.col("host").isNotNull())
    return hit.groupBy("host").agg(F.min("timestamp").alias("started_at")).select(F.concat(F.lit(scenario["id"] + ":"), "host").alias("run_id"), F.lit(scenario["id"]).alias("scenario"), "host", "started_at")


def scenario_steps(mapped: DataFrame, runs: DataFrame, techniques: list[str], coverage: DataFrame, now) -> DataFrame:
    """(run_id, technique, status, evidence, confidence) of each technique of each run.

    observed or blocked by the events since the start; else unknown where ``coverage`` (host, technique) has no telemetry,
    expected within two hours, missing after that.
    """
    each = runs.select("*", F.explode(F.array(*map(F.lit, techniques))).alias("technique"))
    m = mapped.select(F.col("host").alias("h"), F.col("technique").alias("q"), "timestamp", "id", "outcome")
    j = each.join(m, (F.col("host") == F.col("h")) & (F.col("technique") == F.col("q")) & (F.col("timestamp") >= F.col("started_at")) & (F.col("timestamp") <= now), "left")
    blocked = F.coalesce(F.lower("outcome").isin("deny", "denied", "block", "blocked", "failure", "failed", "fail"), F.lit(False))
    # Every id is evidence: those of one host since a start six hours ago at most.
    evidence = F.sort_array(F.collect_list("id")).alias("evidence")
    g = j.groupBy("run_id", "host", "started_at", "technique").agg(F.count("id").alias("n"), F.count_if(F.col("id").isNotNull() & ~blocked).alias("ok"), evidence)
    g = g.join(coverage.select("host", "technique", F.lit(True).alias("seen")).distinct(), ["host", "technique"], "left")
    status = F.when(F.col("ok") > 0, "observed").when(F.col("n") > 0, "blocked").when(F.col("seen").isNull(), "unknown").when(F.col("started_at") > now - F.expr("interval 2 hours"), "expected").otherwise("missing")
    confidence = F.when(F.col("n") > 0, F.least(F.lit(0.95), 0.6 + 0.1 * (F.col("n") - 1))).when(status == "missing", 0.6).otherwise(0.0)
    return g.select("run_id", "host", "started_at", "technique", status.alias("status"), "evidence", F.round(confidence, 4).alias("confidence"))


def scenario_scores(steps: DataFrame, coverage_share: Column, now, base: float = 40.0) -> DataFrame:
    """(run_id, state, risk, confidence)."""
    g = steps.groupBy("run_id", "started_at").agg(F.avg((F.col("status") == "observed").cast("double")).alias("frac"))
    state = F.when(F.col("frac") >= 1.0, "completed").when(F.col("started_at") < now - F.expr("interval 48 hours"), "stale").otherwise("active")
    return g.select("run_id", state.alias("state"), F.round(base * F.col("frac") * coverage_share, 4).alias("risk"), F.round(0.5 * F.col("frac"), 4).alias("confidence"))


def what_next(steps: DataFrame) -> DataFrame:
    pick = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("technique"))))
    return steps.groupBy("run_id").agg(pick("expected").alias("expected"), pick("unknown").alias("unknown"))


def technique_parent(technique) -> Column:
    """T1059.001 -> T1059, in upper case and with its T."""
    t = F.upper(F.trim(F.col(technique) if isinstance(technique, str) else technique))
    return F.substring_index(F.when(t.startswith("T"), t).otherwise(F.concat(F.lit("T"), t)), ".", 1)


def technique_names(df: DataFrame, catalog: DataFrame, column: str = "technique") -> DataFrame:
    """``df`` with technique_name and tactic_name from ``catalog`` (technique, name, tactic_name); a sub-technique without an entry takes its parent's."""
    dim = catalog.groupBy(F.upper("technique").alias("__t")).agg(F.min(F.struct("name", "tactic_name")).alias("__n"))
    own = df.join(dim, F.upper(column) == F.col("__t"), "left").drop("__t").withColumnRenamed("__n", "__own")
    out = own.join(dim, technique_parent(column) == F.col("__t"), "left").drop("__t")
    n = F.coalesce("__own", "__n")
    return out.withColumn("technique_name", n["name"]).withColumn("tactic_name", n["tactic_name"]).drop("__own", "__n")
