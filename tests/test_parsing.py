import hashlib
import random
import re

from pyspark.sql import functions as F

from timberline.functions import masking as M
from timberline.functions import parsing as X
from timberline.functions import patterns as P
from timberline.operators.normalize import detect_and_normalize, normalize

SAMPLES = {
    "hdfs": "081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_38865049064139660 terminating",
    "syslog": "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; logname= uid=0 rhost=218.188.2.4",
    "openstack": "2017-05-16 02:51:08.270 25746 INFO nova.osapi_compute.wsgi [req-38101a0b-2096] done",
    "bgl": "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 RAS KERNEL INFO instruction cache parity error corrected",
    "zookeeper": "2015-07-29 17:41:41,536 - INFO  [main:QuorumPeerConfig@101] - Reading configuration from: /etc/zoo.cfg",
    "hadoop": "2015-10-17 15:37:56,547 INFO [main] org.apache.hadoop.mapreduce.v2.app.MRAppMaster: Created MRAppMaster",
    "spark": "15/09/01 18:14:40 INFO executor.CoarseGrainedExecutorBackend: Registered signal handlers",
    "generic": "2024-01-01 00:00:01 ERROR api: request req-12345678 failed",
}


def test_dialects_headers_and_years(spark, to_lines):
    frames = [to_lines([line], dialect) for dialect, line in SAMPLES.items()]
    lines = frames[0]
    for more in frames[1:]:
        lines = lines.unionByName(more)
    rows = {r.dataset: r for r in normalize(lines, "dialect", 2005).collect()}
    got = {d: (r.service, r.host, r.pid) for d, r in rows.items()}
    assert got == {
        "hdfs": ("dfs.DataNode$PacketResponder", "local", "148"),
        "syslog": ("sshd(pam_unix)", "combo", "19939"),
        "openstack": ("nova.osapi_compute.wsgi", "local", "25746"),
        "bgl": ("KERNEL", "R02-M1-N0-C:J12-U11", None),
        "zookeeper": ("QuorumPeerConfig", "local", None),
        "hadoop": ("MRAppMaster", "local", None),
        "spark": ("CoarseGrainedExecutorBackend", "local", None),
        "generic": ("system", "local", None),
    }
    assert rows["hdfs"].timestamp == "2008-11-09T20:36:15"
    assert rows["syslog"].timestamp == "2005-06-14T15:16:01" and rows["syslog"].level == "ERROR"
    assert rows["bgl"].timestamp_epoch == 1117838570.0 and rows["bgl"].timestamp.endswith("+00:00")
    assert rows["bgl"].message == "instruction cache parity error corrected"
    assert rows["generic"].is_anomaly and rows["generic"].entities.req_id == "req-12345678"


def test_vote_finds_the_dialect(spark, to_lines):
    lines = to_lines([SAMPLES["hdfs"]] * 5 + ["noise"], "generic", "mystery").drop("dialect")
    assert {r.service for r in detect_and_normalize(lines, 2005).filter("id <= 5").collect()} == {
        "dfs.DataNode$PacketResponder"
    }


def test_edge_timestamps(spark, to_lines):
    texts = [
        "2024-03-10 14:22:01.123 Sample log line",
        "2024-01-01 00:00:00Z zone without fraction 1500000000 later",
        "85/02/03 04:05:06 old", "Feb 30 01:02:03 never", "no time at all", "2024-13-45 00:00:00 bad 081109 203615",
    ]
    rows = normalize(to_lines(texts), "dialect", 2023).orderBy("id").collect()
    assert [r.ts_format for r in rows] == ["iso", "epoch", "slash", "synthetic", "synthetic", "compact"]
    assert rows[0].message == "Sample log line"
    assert rows[2].timestamp == "1985-02-03T04:05:06"
    assert rows[4].timestamp_epoch == 1700000005.0


def test_redaction(spark):
    texts = [
        "User admin logged in with password=SuperSecretToken123! from contact@company.org",
        "Authorization: Bearer abcdefghijklmnop", "bearer: x y",
        "-----BEGIN RSA PRIVATE KEY-----AAAA-----END RSA PRIVATE KEY----- end", "naïve tokèn nothing",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.out for r in X.with_steps(df, *X.redaction_steps("text", "out")).collect()]
    assert got[0] == "User admin logged in with password=[REDACTED] from [EMAIL_REDACTED]"
    assert got[1] == "Authorization: [REDACTED_TOKEN]"
    assert got[2] == "bearer=[REDACTED] y"
    assert got[3] == "[PRIVATE_KEY_REDACTED] end"
    assert got[4] == texts[4]


def test_entities_and_identity(spark, to_lines):
    line = "serving block blk_987654321 and blk_-5 and blk_-5 to 192.168.1.50:50010 10.0.0.1 user admin 0xdeadbeef 0x1234"
    row = normalize(to_lines([f"  {line}  "]), "dialect", 2024).first()
    e = row.entities
    assert (e.block_id, e.all_block_ids, e.user) == ("blk_987654321", ["blk_987654321", "blk_-5"], "admin")
    assert (e.ips, e.memory_registers) == (["192.168.1.50", "10.0.0.1"], ["0xdeadbeef", "0x1234"])
    assert row.event_id == hashlib.sha256(f"generic\0{1}\0{line}".encode()).hexdigest()


def test_masking_matches_one_pass_substitution(spark):
    rng = random.Random(7)
    bits = ["10.0.0.1:80", "blk_-12", "req-12345678-", "R02-M1-N0-C:J12-U11", "0xAb12", "deadbeef99", "/var/x.y/blk_3",
            "42", "é7", "x9", " ", "  ", "-", "$1", "\\1", "user", "é", ":", "R", "req-", "\x01", "12345678", "٣٤"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    any_mask = re.compile("|".join(f"(?P<{n}>{p})" for n, p in P.MASKS))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.withColumn("pieces", M.mask_pieces(F.col("t")))
    rows = df.select("i", M.masked_text(F.col("pieces")).alias("m"), M.params_of(F.col("pieces")).alias("p")).collect()
    for row in rows:
        found: list[str] = []

        def mark(m):
            found.append(m.group(0))
            return f"<{m.lastgroup}>"

        assert (any_mask.sub(mark, texts[row.i]), found) == (row.m, row.p), texts[row.i]
