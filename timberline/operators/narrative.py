"""Deterministic incident narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import shortened

# Search words of the rules, confidences and texts.
# {blk} {user} {ip} {node} {req} {svc} {n} {first} {last} {ref} {msg} are filled per incident.
RULES = (
    {
        "name": "stream_termination",
        "confidence": 0.94,
        "title": "HDFS DataNode Stream Termination for {blk}",
        "summary": "Pipeline transmission failure observed on DataNode for {blk}. {n} related events detected between {first} and {last}.",
        "cause": "Premature PacketResponder thread termination recorded at {ref}. Caused by network packet acknowledgement timeout or premature client socket closure.",
        "action": "1. Run `hdfs fsck / -files -blocks` to verify replication integrity of {blk}.\n2. Check DataNode network bandwidth and TCP socket drop counters.",
    },
    {
        "name": "auth_failures",
        "confidence": 0.96,
        "title": "Security Alert: Repeated Auth Failures from {ip}",
        "summary": "Series of {n} rapid authentication failures for user '{user}' originating from {ip}.",
        "cause": "Potential credential stuffing or brute-force attack detected at {ref} targeting SSH daemon.",
        "action": "1. Blacklist offending IP {ip} on firewall / iptables.\n2. Enforce key-based authentication and disable PAM password auth in `/etc/ssh/sshd_config`.",
    },
    {
        "name": "hardware",
        "confidence": 0.91,
        "title": "Compute Node Hardware Parity Alert: {node}",
        "summary": "Hardware or kernel alert triggered on compute node {node}. Memory register anomalies logged across {n} events.",
        "cause": "Kernel panic / uncorrectable memory parity or bus error logged at {ref} on node {node}.",
        "action": "1. Isolate node {node} from scheduler pool.\n2. Run hardware diagnostics and inspect memory module telemetry.",
    },
    {
        "name": "cloud_lifecycle",
        "confidence": 0.88,
        "title": "OpenStack Service Lifecycle Disruption ({req})",
        "summary": "Service failure logged during request execution {req} across {n} correlated steps.",
        "cause": "Nova/Neutron execution error flagged at {ref} while handling request {req}.",
        "action": "1. Query Nova API for instance status corresponding to {req}.\n2. Inspect compute node hypervisor logs for resource exhaustion.",
    },
    {
        "name": "other",
        "confidence": 0.78,
        "title": "Operational Anomaly in {svc}",
        "summary": "Cluster of {n} anomalous events identified in {svc}.",
        "cause": "Service state irregularity initiated at {ref} with message: \"{msg}\".",
        "action": "Inspect surrounding process logs and verify service dependencies.",
    },
)
WORDS = (
    "packetresponder", "terminating", "authentication failure", "sshd", "kernel", "ddr", "fatal",
    "openstack", "nova", "req-",
)
NO_EVIDENCE_CAUSE = "Insufficient evidence collected (Abstention)."
NO_EVIDENCE_CONFIDENCE = 0.2
NO_EVIDENCE_ACTION = "Expand log collection window and check upstream services."


def _fill(text: str, slots: dict[str, Column]) -> Column:
    """``text`` with its {slots} as one concat."""
    pieces: list[Column] = []
    while text:
        head, mark, rest = text.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not mark:
            break
        name, _, text = rest.partition("}")
        pieces.append(slots[name])
    return F.concat(*pieces)


def incident_narrative(members: DataFrame, chars: int | None = None) -> DataFrame:
    """Rule, texts and confidence per incident, citing its first event.

    Which words occur is folded with ``max`` per incident; the first event and
    first address come from minima, so nothing is collected. The message is cited
    in full, or up to ``chars`` characters.
    """
    message = F.lower("message")
    ips = F.col("entities.ips")
    first = F.struct(
        F.col("timestamp_epoch").alias("epoch"), F.col("id"), F.col("timestamp").alias("ts"),
        "service", "host", shortened(F.col("message"), chars).alias("message"),
        F.col("entities.block_id").alias("block_id"), F.col("entities.user").alias("user"),
        F.col("entities.bgl_node").alias("bgl_node"), F.col("entities.req_id").alias("req_id"),
    )
    at = F.struct(F.col("timestamp_epoch").alias("epoch"), F.col("id"), F.col("timestamp").alias("ts"))
    by_ip = F.when(
        F.size(ips) > 0, F.struct(F.col("timestamp_epoch").alias("epoch"), F.col("id"), F.element_at(ips, 1).alias("ip"))
    )
    flags = {word: f"_has_{n}" for n, word in enumerate(WORDS)}
    folded = members.groupBy("dataset", "incident_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.max(at).alias("last"),
        F.min(by_ip).alias("ip"),
        *[F.max(message.contains(word)).alias(name) for word, name in flags.items()],
    )

    def seen(*words: str) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | F.col(flags[word])
        return out

    tests = (
        seen("packetresponder") & seen("terminating"),
        seen("authentication failure", "sshd"),
        seen("kernel", "ddr", "fatal"),
        seen("openstack", "nova", "req-"),
        F.lit(True),
    )
    f = F.col("first")
    slots = {
        "blk": F.coalesce(f["block_id"], F.lit("detected block")),
        "user": F.coalesce(f["user"], F.lit("unknown user")),
        "ip": F.coalesce(F.col("ip.ip"), F.lit("remote source")),
        "node": F.coalesce(f["bgl_node"], F.nullif(f["host"], F.lit("")), F.lit("node")),
        "req": F.coalesce(f["req_id"], F.lit("request")),
        "svc": f["service"],
        "n": F.col("n").cast("string"),
        "first": f["ts"],
        "last": F.col("last.ts"),
        "ref": F.concat(
            F.lit("[Line "), f["id"].cast("string"), F.lit(" @ "), F.coalesce(f["ts"], F.lit("T0")), F.lit("]")
        ),
        "msg": f["message"],
    }
    rule = F.lit(None).cast("int")
    for at_rule in reversed(range(len(RULES))):
        rule = F.when(tests[at_rule], F.lit(at_rule)).otherwise(rule)
    folded = folded.withColumn("_rule", rule)

    def pick(field: str) -> Column:
        out = None
        for at_rule, texts in enumerate(RULES):
            value = texts[field]
            value = F.lit(value) if field in ("confidence", "name") else _fill(value, slots)
            test = F.col("_rule") == at_rule
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    return folded.select(
        "dataset", "incident_id", pick("name").alias("rule"), pick("title").alias("title"),
        pick("summary").alias("summary"), pick("cause").alias("probable_root_cause"),
        pick("action").alias("recommended_action"), pick("confidence").alias("confidence"),
    )


def with_abstention(incidents: DataFrame, narratives: DataFrame) -> DataFrame:
    """Narrative where there is evidence; fixed texts and low confidence where none is left."""
    joined = incidents.select("dataset", "incident_id").join(narratives, ["dataset", "incident_id"], "left")
    missing = F.col("rule").isNull()
    return joined.select(
        "dataset", "incident_id", missing.alias("abstained"),
        F.when(missing, NO_EVIDENCE_CAUSE).otherwise(F.col("probable_root_cause")).alias("probable_root_cause"),
        F.when(missing, NO_EVIDENCE_ACTION).otherwise(F.col("recommended_action")).alias("recommended_action"),
        F.when(missing, NO_EVIDENCE_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
    )
