"""Verification of findings: false-positive score, verdict matrix, calibration, texts, manual cases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import evidence_integrity
from .investigate import lookup
from .joins import capped, entity_feedback, ioc_direct, ioc_flow_counts, prior_verdicts
from .ranges import last_within, micros, window_sums
from .sequence import sequence_coherent

# The finding types of each kind.
DEFINITE = ["CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN"]
AMBIGUOUS = ["BEHAVIOURAL_ANOMALY", "ANOMALOUS_PATTERN", "SIGMA_MATCH"]
NEGATIVE = ["NORMAL_BEHAVIOUR", "FALSE_POSITIVE"]


def fp_score(feedback: DataFrame, prior: DataFrame, similar: DataFrame, key: str = "investigation_id") -> DataFrame:
    """Per case: labels plus half (whole) of prior verdicts; fp / (fp + tp + 1) * (1 - similar / (similar + 1)); history over 0.6.

    feedback(key, label), prior(key, verdict), similar(key, similar_count): a row a case.
    """
    of = lambda c, v: F.count_if(F.col(c) == v)
    a = feedback.groupBy(key).agg(of("label", "false_positive").alias("f1"), of("label", "true_positive").alias("t1"))
    b = prior.groupBy(key).agg(of("verdict", "false_positive").alias("f2"), of("verdict", "true_positive").alias("t2"))
    both = similar.join(a, key, "left").join(b, key, "left")
    return with_fp(both, "f1", "t1", "f2", "t2", "similar_count").select(key, "fp", "tp", "similar", "fp_confidence", "has_fp_history")


def with_fp(df: DataFrame, labels_fp: str, labels_tp: str, prior_fp: str, prior_tp: str, similar: str) -> DataFrame:
    """df with fp, tp, similar, fp_confidence and has_fp_history from its counts; a null count is 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = df.withColumns({"fp": z(labels_fp) + F.floor(z(prior_fp) / 2), "tp": z(labels_tp) + F.floor(z(prior_tp) / 2), "similar": z(similar)})
    conf = F.when(F.col("fp") + F.col("tp") > 0, F.col("fp") / (F.col("fp") + F.col("tp") + 1)).otherwise(0.0) * (1 - F.col("similar") / (F.col("similar") + 1))
    return counts.withColumn("fp_confidence", conf).withColumn("has_fp_history", F.col("fp_confidence") > 0.6)


def verification_inputs(cases: DataFrame, anchors: DataFrame, network: DataFrame, ioc: DataFrame, arrivals: DataFrame, feedback: DataFrame, verdicts: DataFrame, as_of: datetime) -> DataFrame:
    """cases, a row each, with all evidence checks: anchors and chain, flows to indicators and the address itself, order of the host's events
    (arrivals(hostname, timestamp, received_at, seq)), verdicts on earlier cases of the host, and labels of host or address.

    similar_count is the number of those earlier cases that were confirmed.
    """
    of = lambda c, v: F.count_if(F.col(c) == v)
    integrity = evidence_integrity(cases.select(F.col("investigation_id").alias("case_id"), F.col("started_at").alias("at")), anchors).withColumnRenamed("case_id", "investigation_id")
    flows = ioc_flow_counts(cases.select("alert_id", F.col("hostname").alias("host"), F.col("started_at").alias("at")), network, ioc, as_of)
    direct = ioc_direct(cases.select("investigation_id", "source_ip"), ioc, as_of).groupBy("investigation_id").agg(F.max("ioc_confidence").alias("ioc_confidence"))
    order = sequence_coherent(arrivals, "hostname", "received_at").select("hostname", "out_of_order", "coherent")
    prior = prior_verdicts(cases, verdicts).groupBy("investigation_id").agg(of("verdict", "false_positive").alias("prior_fp"), of("verdict", "true_positive").alias("prior_tp"))
    labels = entity_feedback(cases, feedback).groupBy("investigation_id").agg(of("label", "false_positive").alias("label_fp"), of("label", "true_positive").alias("label_tp"))
    out = cases.join(integrity, "investigation_id").join(flows, "alert_id", "left").join(direct, "investigation_id", "left").join(order, "hostname", "left").join(prior, "investigation_id", "left").join(labels, "investigation_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("ioc_flows", "out_of_order", "prior_fp", "prior_tp", "label_fp", "label_tp")}
    out = out.withColumns({**zero, "coherent": F.coalesce("coherent", F.lit(True))})
    return out.withColumns({"ioc_corroborated": (F.col("ioc_flows") > 0) | F.col("ioc_confidence").isNotNull(), "similar_count": F.col("prior_tp")})


def evidence_boost() -> Column:
    intact = F.col("chain_intact")
    return F.when(F.col("evidence_verified") & intact, 1.0).when(F.col("coverage_gap") & intact, 0.5).otherwise(0.0)


def calibrated(confidence: Column) -> Column:
    """confidence * (0.40 + 0.20 evidence + 0.20 indicator + 0.10 (1 - fp) + 0.10 coherence), within 0..1."""
    factor = 0.40 + 0.20 * evidence_boost() + 0.20 * F.col("ioc_corroborated").cast("double") + 0.10 * (1 - F.col("fp_confidence")) + 0.10 * F.col("coherent").cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * factor))


def verdict() -> Column:
    """A struct verdict, confidence, priority, status, path: the first cell that fits.

    Reads finding_type, confidence, evidence_verified, chain_intact, coverage_gap, ioc_corroborated, has_fp_history, fp_confidence, coherent.
    """
    kind, conf, ioc = F.col("finding_type"), F.col("confidence"), F.col("ioc_corroborated")

    def cell(v: str, c: Column, priority: Column | str, status: str, path: str) -> Column:
        p = priority if isinstance(priority, Column) else F.lit(priority)
        return F.struct(F.lit(v).alias("verdict"), c.cast("double").alias("confidence"), p.alias("priority"), F.lit(status).alias("status"), F.lit(path).alias("path"))

    definite = kind.isin(DEFINITE)
    p1 = ((conf >= 0.80) & ioc) | (kind == "ACTIVE_CAMPAIGN")
    good = calibrated(conf)
    return (
        F.when(kind.isin(NEGATIVE), cell("false_positive", F.greatest(F.lit(0.7), 1.0 - conf), "P4", "false_positive", "negative finding"))
        .when(F.col("has_fp_history") & ~definite, cell("false_positive", F.col("fp_confidence"), "P4", "false_positive", "false-positive history"))
        .when(F.col("evidence_verified") & ~F.col("chain_intact"), cell("inconclusive", F.lit(0.5), "P2", "inconclusive", "chain broken"))
        .when(definite, cell("true_positive", good, F.when(p1, "P1").otherwise("P2"), "verified", "definite finding"))
        .when(kind.isin(AMBIGUOUS) & (conf >= 0.60) & ioc, cell("true_positive", good, "P2", "verified", "ambiguous with indicator"))
        .when(kind.isin(AMBIGUOUS) & (conf >= 0.60), cell("inconclusive", good, "P3", "inconclusive", "ambiguous without indicator"))
        .when(kind.isin(AMBIGUOUS), cell("inconclusive", conf * 0.8, "P3", "inconclusive", "low confidence"))
        .otherwise(cell("inconclusive", conf * 0.7, "P3", "inconclusive", "unknown finding"))
    )


VERDICT_ACTIONS = {
    "true_positive|P1": "Contain at once and page the incident lead.", "true_positive|P2": "Contain and open an incident.", "true_positive|P3": "Open an incident.", "true_positive|P4": "Open a ticket.",
    "false_positive|P4": "Close; consider tuning the rule.", "inconclusive|P2": "Preserve evidence and review integrity.", "inconclusive|P3": "Review by an analyst.",
}


def with_verdict(inputs: DataFrame) -> DataFrame:
    out = inputs.withColumn("v", verdict())
    action = lookup(VERDICT_ACTIONS, F.concat_ws("|", "v.verdict", "v.priority"), "Review by an analyst.")
    checks = F.to_json(F.struct("finding_type", "evidence_verified", "chain_intact", "ioc_corroborated", "fp_confidence", "coherent", F.col("v.path").alias("path")))
    return out.select("*", F.col("v.verdict"), F.col("v.confidence").alias("verdict_confidence"), F.col("v.priority"), F.col("v.status"), action.alias("verdict_action"), checks.alias("explanation")).drop("v")


def summary_text() -> Column:
    """One line a check."""
    yes = lambda c, a, b: F.when(F.col(c), a).otherwise(b)
    return F.concat_ws(
        "\n", F.format_string("Verdict: %s (%s), confidence %.2f", "verdict", "priority", "verdict_confidence"), F.concat(F.lit("Evidence: "), yes("evidence_verified", "anchored", "no anchor"), F.lit(", chain "), yes("chain_intact", "intact", "broken")),
        F.concat(F.lit("Indicators: "), yes("ioc_corroborated", "corroborated", "none")), F.concat(F.lit("Timeline: "), yes("coherent", "coherent", "out of order")), F.format_string("False-positive score: %.3f", "fp_confidence"),
    )


def timeline(cases: DataFrame, raw: DataFrame, scores: DataFrame, findings: DataFrame, window_s: float = 900) -> DataFrame:
    """Entries of each case's host around its time, capped at 200 raw, 100 score and 50 finding rows."""
    c = cases.select("case_id", "host", "at")
    parts = []
    for stage, df, ts, text, cap in (("raw", raw, "timestamp", "message", 200), ("triage", scores, "timestamp", "action", 100), ("hunter", findings, "started_at", "finding_type", 50)):
        rows = df.select(F.col("hostname").alias("e_host"), F.col(ts).alias("e_at"), F.col("seq").alias("e_seq"), F.col(text).alias("text"))
        near = last_within(c, rows, [("host", "e_host")], "at", "e_at", "e_seq", cap, window_s, window_s)
        parts.append(near.select("case_id", F.lit(stage).alias("stage"), F.col("e_at").alias("timestamp"), F.col("e_seq").alias("seq"), "text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def timeline_labels(entries: DataFrame) -> DataFrame:
    stage = F.col("stage")
    label = F.when(stage == "raw", F.concat(F.lit("Log: "), F.substring("text", 1, 80))).when(stage == "triage", F.concat(F.lit("Scored: "), "text")).otherwise(F.concat(F.lit("Finding: "), "text"))
    return entries.withColumn("label", label)


def label_counts(cases: DataFrame, entries: DataFrame, window_s: float = 900) -> DataFrame:
    """case_id, label, n: all entries(hostname, timestamp, stage, text) of each case's host around its time, by label; neither listed nor capped.

    A case asks for the labels that its host has in the window's buckets, once each.
    """
    rows, width = timeline_labels(entries).select("hostname", "label", micros(F.col("timestamp")).alias("t")), int(window_s * 1e6)
    bucket = lambda c: F.floor(c / (2 * width))
    at = micros(F.col("at"))
    labels = rows.select("hostname", "label", bucket(F.col("t")).alias("b")).distinct()
    asked = cases.select("case_id", F.col("host").alias("hostname"), "at", F.explode(F.sequence(bucket(at - width), bucket(at + width))).alias("b"))
    asked = asked.join(labels, ["hostname", "b"]).drop("b").distinct()
    return window_sums(asked, rows, [("hostname", "hostname"), ("label", "label")], ["case_id", "label"], at, F.col("t"), width, width, sums={"n": F.lit(1)}).filter("n > 0")


# Tactic of an alert category.
CATEGORY_TACTIC = {"auth": "credential-access", "malware": "execution", "exfiltration": "exfiltration", "network-attack": "discovery", "firewall": "defense-evasion", "privilege-escalation": "privilege-escalation", "lateral-movement": "lateral-movement"}


def create_cases(ids: DataFrame, security: DataFrame, scores: DataFrame, correlated: DataFrame) -> DataFrame:
    """A case for each alert id: its latest score, correlated ids (event_id, o_id), confidence, tactic and evidence as JSON."""
    latest = scores.groupBy("event_id").agg(F.max_by(F.struct("adjusted_score", "lgbm_score", "eif_score"), F.struct("timestamp", "seq")).alias("s"))
    near = correlated.groupBy("event_id").agg(F.array_sort(F.collect_list("o_id")).alias("correlated_events"))  # capped by the caller
    out = security.join(ids, "event_id", "left_semi").join(latest, "event_id", "left").join(near, "event_id", "left")
    models = F.filter(F.array("s.lgbm_score", "s.eif_score"), lambda x: x > 0)
    mean = F.when(F.size(models) > 0, F.aggregate(models, F.lit(0.0), lambda a, x: a + x) / F.size(models)).otherwise(0.0)
    confidence = F.greatest(F.coalesce("s.adjusted_score", F.lit(0.0)), F.coalesce(mean, F.lit(0.0)))
    tactic = F.coalesce(F.nullif("mitre_tactic", F.lit("")), lookup(CATEGORY_TACTIC, F.col("category"), "unknown"))
    related = F.coalesce("correlated_events", F.array().cast("array<string>"))
    return out.select("event_id", "hostname", confidence.alias("confidence"), tactic.alias("tactic"), related.alias("correlated_events"), F.to_json(F.struct("category", "severity", F.size(related).alias("correlated"))).alias("evidence_json"))


def verification_graph(cases: DataFrame, batches: DataFrame, indicators: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (alert_id, id, type, label, status) and edges (alert_id, src, dst, type) of the second stage.

    cases are those of with_verdict, with tactics (an array, in order of the chain); batches(alert_id, batch_id) and indicators(alert_id, ioc_value)
    are what the checks met, of which the last and the first `most` by name are drawn. Ids name what they stand for, so that a
    host is the first stage's node of the same host (evidence_graph) and the two graphs unite by id.
    """
    of = lambda kind: F.concat(F.lit(f"{kind}:"), "alert_id")
    host, ip = F.concat(F.lit("host:"), "hostname"), F.concat(F.lit("ip:"), F.coalesce("source_ip", F.lit("")))
    listed = lambda df, column, order: capped(df.select("alert_id", column).distinct(), ["alert_id"], most, order).groupBy("alert_id").agg(F.array_sort(F.collect_list(column)).alias(f"__{column}"))
    given = cases.join(listed(batches, "batch_id", F.desc("batch_id")), "alert_id", "left").join(listed(indicators, "ioc_value", F.asc("ioc_value")), "alert_id", "left")
    for c in ("batch_id", "ioc_value"):
        given = given.withColumn(f"__{c}", F.coalesce(f"__{c}", F.array().cast("array<string>")))
    tactics = F.coalesce("tactics", F.array().cast("array<string>"))
    node = lambda id_, kind, label, status=None: F.struct(id_.alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), (F.lit(None) if status is None else status).cast("string").alias("status"))
    told = lambda head, cond, yes, no: F.concat(F.lit(f"{head}: "), F.when(cond, yes).otherwise(no))
    ver, ioc, fine, history = F.col("evidence_verified"), F.col("ioc_corroborated"), F.col("coherent"), F.col("has_fp_history")
    checks = {
        "evidence": node(of("evidence"), "verification", told("Evidence", ver, "VERIFIED", "UNVERIFIED"), F.when(ver & F.col("chain_intact"), "pass").otherwise("fail")),
        "ioc_check": node(of("ioc_check"), "verification", told("IOC", ioc, "CORROBORATED", "NO MATCH"), F.when(ioc, "pass").otherwise("neutral")),
        "timeline": node(of("timeline"), "verification", told("Timeline", fine, "COHERENT", "OUT OF ORDER"), F.when(fine, "pass").otherwise("warn")),
        "fp_check": node(of("fp_check"), "verification", told("FP Check", history, "FLAGGED", "CLEAN"), F.when(history, "fail").otherwise("pass")),
    }
    core = [
        node(of("alert"), "alert", F.col("finding_type")), node(host, "host", F.col("hostname")), node(ip, "ip", F.col("source_ip")),
        node(of("hunter"), "hunter_verdict", F.concat(F.lit("Hunter: "), "finding_type")), *checks.values(),
        node(of("verdict"), "verdict", F.concat(F.lit("VERDICT: "), F.upper(F.replace("verdict", F.lit("_"), F.lit(" ")))), F.col("priority")),
    ]
    named = lambda kind, x: F.concat(F.lit(f"{kind}:"), "alert_id", F.lit(":"), x)
    many = [F.transform("__batch_id", lambda x: node(named("merkle_batch", x), "merkle_batch", x)), F.transform("__ioc_value", lambda x: node(named("ioc", x), "ioc", x))]
    places = F.transform(tactics, lambda x, i: node(named("tactic", i.cast("string")), "mitre_tactic", x))
    nodes = given.select("alert_id", F.explode(F.concat(F.array(*core), *many, places)).alias("n")).select("alert_id", "n.*")

    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    fixed_edges = [edge(of("alert"), host, "target"), edge(ip, host, "connection"), edge(of("alert"), of("hunter"), "investigation")]
    fixed_edges += [edge(of("hunter"), of(c), "verify") for c in checks] + [edge(of(c), of("verdict"), "contributes") for c in checks]
    met = [
        F.transform("__batch_id", lambda x: edge(of("evidence"), named("merkle_batch", x), "merkle_chain")),
        F.transform("__ioc_value", lambda x: edge(of("ioc_check"), named("ioc", x), "ioc_match")),
    ]
    chain = F.transform(tactics, lambda x, i: edge(F.when(i == 0, host).otherwise(named("tactic", (i - 1).cast("string"))), named("tactic", i.cast("string")), "kill_chain"))
    edges = given.select("alert_id", F.explode(F.concat(F.array(*fixed_edges), *met, chain)).alias("e")).select("alert_id", "e.*")
    return nodes, edges


def united_graph(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of both stages, each id and each edge once an alert; a node of both takes the later stage's label and status."""
    nodes = first[0].select("alert_id", "id", "type", "label", F.lit(None).cast("string").alias("status"), F.lit(1).alias("stage")).unionByName(second[0].withColumn("stage", F.lit(2)))
    best = nodes.groupBy("alert_id", "id").agg(F.max(F.struct("stage", "type", "label", "status")).alias("n"))
    edges = first[1].select("alert_id", "src", "dst", "type").unionByName(second[1])
    return best.select("alert_id", "id", "n.type", "n.label", "n.status"), edges.distinct()
