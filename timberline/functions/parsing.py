"""Columns of one log line: redaction, time, level, header, entities, identity.

``*_steps`` functions return named columns in order, each built from the ones
before it. They go into one ``select`` (later columns refer to earlier ones by
name), so the plan is analysed once, an expensive match is evaluated once, and
everything stays JVM-side. Names that start with an underscore are internal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import patterns as P
from timberline.functions.text import (
    contains_any,
    first_word,
    last_word,
    lookup,
    none_if_empty,
    strip,
    words,
)

ENTITY_TYPE = (
    "struct<block_id:string,all_block_ids:array<string>,req_id:string,bgl_node:string,"
    "ips:array<string>,user:string,memory_registers:array<string>>"
)


# --------------------------------------------------------------------------- #
# Redaction and compliance
# --------------------------------------------------------------------------- #
def redaction_steps(source: str, target: str) -> list[Column]:
    """Four rules in order; a cheap test skips lines a rule cannot match."""
    rules = (
        (P.uni_any_case(P.CREDENTIAL), "$1" + P.CREDENTIAL_MASK, P.CREDENTIAL_WORDS),
        (P.uni_any_case(P.AUTH_HEADER), P.AUTH_HEADER_MASK, P.AUTH_HEADER_WORDS),
        (P.uni(P.EMAIL), P.EMAIL_MASK, ("@",)),
        (P.PRIVATE_KEY, P.PRIVATE_KEY_MASK, ("-----begin ",)),
    )
    steps, last = [], source
    for at, (pattern, mask, needles) in enumerate(rules, start=1):
        text, name = F.col(last), target if at == len(rules) else f"_{target}_{at}"
        masked = F.when(may_hold(text, needles), F.regexp_replace(text, pattern, mask)).otherwise(text)
        steps.append(masked.alias(name))
        last = name
    return steps


def with_steps(df: DataFrame, *steps: Column) -> DataFrame:
    """``df`` plus the columns of ``steps``, internal ones dropped."""
    out = df.select("*", *steps)
    return out.drop(*[name for name in out.columns if name.startswith("_")])


def may_hold(text: Column, needles) -> Column:
    """Cheap test before a pattern: false only when no needle occurs in any case.

    Case folding outside ASCII has odd corners, so such texts always pass.
    """
    return (F.octet_length(text) != F.length(text)) | contains_any(F.lower(text), needles)


def clear_credential(text: Column) -> Column:
    return text.rlike(P.uni_any_case(P.CLEAR_CREDENTIAL))


def any_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(P.uni(P.ANY_EMAIL))


# --------------------------------------------------------------------------- #
# Timestamps
# --------------------------------------------------------------------------- #
def _century(yy: Column) -> Column:
    return F.when(yy.cast("int") >= 69, "19").otherwise("20")


def iso_text(found: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of an ISO-like match.

    The fraction and what follows are dropped; a zone right after the seconds
    makes the match unparsable.
    """
    return F.when(
        F.substring(found, 20, 1).isin("", ".", ","),
        F.concat(F.substring(found, 1, 10), F.lit("T"), F.substring(found, 12, 8)),
    )


def slash_text(found: Column) -> Column:
    return F.concat(
        _century(F.substring(found, 1, 2)), F.translate(F.substring(found, 1, 8), "/", "-"),
        F.lit("T"), F.substring(found, -8, 8),
    )


def syslog_text(found: Column, year: Column) -> Column:
    month_at = F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.substring(found, 1, 3))
    month = F.lpad(((month_at + 2) / 3).cast("int").cast("string"), 2, "0")
    day = F.substring(strip(F.substring(found, 4, 100)), 1, 2)
    return F.concat(
        year.cast("string"), F.lit("-"), F.when(month_at > 0, month), F.lit("-"),
        F.lpad(strip(day), 2, "0"), F.lit("T"), F.substring(found, -8, 8),
    )


def compact_text(found: Column) -> Column:
    def at(position: int) -> Column:
        return F.substring(found, position, 2)

    return F.concat(
        _century(at(1)), at(1), F.lit("-"), at(3), F.lit("-"), at(5), F.lit("T"),
        at(-6), F.lit(":"), at(-4), F.lit(":"), at(-2),
    )


def utc_text(epoch: Column) -> Column:
    """ISO text with offset; the fraction shows only when there is one."""
    ts = F.timestamp_micros(F.bround(epoch * 1e6).cast("long"))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.bround(epoch * 1e6) % 1000000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""),
        F.lit("+00:00"),
    )


def _cut_first(line: Column, pattern: str) -> Column:
    """``line`` without the first match (a plain replace would cut them all)."""
    return F.regexp_replace(line, P.uni("(?s)^(.*?)" + pattern + "(.*)$"), "$1$3")


def timestamp_steps(source: str, year: Column, line_id: str = "id") -> list[Column]:
    """``ts_format``, ``timestamp``, ``timestamp_epoch``, ``remainder``.

    The first format that parses wins. A later format is only looked for on
    lines no earlier one settled.
    """
    line = F.col(source)
    year = F.coalesce(year, F.year(F.current_date()))
    formats = (
        ("iso", P.TS_ISO, iso_text),
        ("slash", P.TS_SLASH, slash_text),
        ("syslog", P.TS_SYSLOG, lambda found: syslog_text(found, year)),
        ("compact", P.TS_COMPACT, compact_text),
    )
    steps, settled = [], None
    for name, pattern, to_text in formats:
        found = F.regexp_extract(line, P.uni(pattern), 1)
        if settled is not None:
            found = F.when(F.col(settled).isNull(), found)
        steps.append(found.alias(f"_{name}_match"))
        match = F.col(f"_{name}_match")
        steps.append(F.when(match != "", to_text(match)).alias(f"_{name}_text"))
        text = F.col(f"_{name}_text")
        steps.append(F.when(text.try_cast("timestamp").isNotNull(), text).alias(f"_{name}"))
        if settled is None:
            settled = f"_{name}"
        else:
            steps.append(F.coalesce(settled, f"_{name}").alias(f"_upto_{name}"))
            settled = f"_upto_{name}"
    naive = F.col(settled)
    steps.append(F.when(naive.isNull(), F.regexp_extract(line, P.uni(P.TS_EPOCH), 1)).alias("_epoch_match"))
    digits = F.col("_epoch_match")
    steps.append(F.when(digits != "", digits.cast("double")).alias("_epoch"))
    fmt = F.when(F.col("_iso").isNotNull(), "iso")
    for name in ("slash", "syslog", "compact", "epoch"):
        fmt = fmt.when(F.col(f"_{name}").isNotNull(), name)
    steps.append(fmt.otherwise("synthetic").alias("ts_format"))
    steps.append(
        F.coalesce(
            F.unix_timestamp(naive.cast("timestamp")).cast("double"),
            F.col("_epoch"),
            F.lit(P.SYNTHETIC_EPOCH) + F.col(line_id),
        ).alias("timestamp_epoch")
    )
    steps.append(F.coalesce(naive, utc_text(F.col("timestamp_epoch"))).alias("timestamp"))
    fmt = F.col("ts_format")
    steps.append(
        F.when(fmt == "iso", _cut_first(line, P.TS_ISO))
        .when(fmt == "slash", _cut_first(line, P.TS_SLASH))
        .when(fmt == "syslog", _cut_first(line, P.TS_SYSLOG))
        .when(fmt == "compact", _cut_first(line, P.TS_COMPACT))
        .when(fmt == "epoch", _cut_first(line, P.TS_EPOCH))
        .otherwise(line)
        .alias("remainder")
    )
    return steps


# --------------------------------------------------------------------------- #
# Level
# --------------------------------------------------------------------------- #
def level_steps(source: str = "remainder") -> list[Column]:
    """``level``: the first level word anywhere in the text, else INFO."""
    word = F.upper(F.regexp_extract(F.col(source), P.uni_any_case(P.LEVEL), 1))
    return [word.alias("_level_word"), lookup(F.col("_level_word"), P.LEVEL_NAMES, "INFO").alias("level")]


# --------------------------------------------------------------------------- #
# Headers by dialect
# --------------------------------------------------------------------------- #
def _all_digits(token: Column) -> Column:
    return token.rlike(P.uni(r"^\d+$"))


def header_steps(dialect: Column, text: str = "remainder") -> list[Column]:
    """``service``, ``_host``, ``pid``, ``_body`` (message before cleaning)."""
    rest = F.col(text)
    at_colon = dialect.isin("hdfs", "syslog", "hadoop", "spark")
    has_colon = rest.contains(":")
    head = F.when(at_colon & has_colon, F.substring_index(rest, ":", 1)).when(
        dialect.isin("openstack", "bgl"), rest
    )
    steps = [
        words(strip(head)).alias("_words"),
        F.when(dialect == "zookeeper", F.regexp_extract(rest, P.uni(P.ZOOKEEPER_HEADER), 1)).alias("_zk"),
    ]
    tokens, zk = F.col("_words"), F.col("_zk")
    enough = F.size(tokens)

    def last_part(needles):
        hit = last_word(tokens, lambda w: contains_any(w, needles))
        return F.substring_index(hit, ".", -1)

    zk_name = F.when(zk.contains(":"), F.try_element_at(F.split(zk, ":"), F.lit(2))).otherwise(zk)
    proc = F.try_element_at(tokens, F.lit(2))
    service = (
        F.when(dialect == "hdfs", last_word(tokens, lambda w: w.contains("dfs.")))
        .when((dialect == "syslog") & (enough >= 2), F.regexp_replace(proc, P.uni(r"\[\d+\]"), ""))
        .when(
            (dialect == "openstack") & (enough >= 3),
            first_word(F.slice(tokens, 1, 5), lambda w: contains_any(w, P.OPENSTACK_SERVICES)),
        )
        .when(dialect == "bgl", last_word(tokens, lambda w: w.isin(*P.BGL_SERVICES)))
        .when((dialect == "zookeeper") & (zk != ""), F.substring_index(zk_name, "@", 1))
        .when(dialect == "hadoop", last_part(P.HADOOP_SERVICES))
        .when(dialect == "spark", last_part(P.SPARK_SERVICES))
    )
    host = F.when((dialect == "syslog") & (enough >= 2), F.try_element_at(tokens, F.lit(1))).when(
        dialect == "bgl", last_word(tokens, lambda w: w.rlike(P.uni(P.BGL_HOST)))
    )
    pid = (
        F.when(
            dialect == "hdfs",
            first_word(tokens, lambda w: _all_digits(w) & ~w.contains("dfs.")),
        )
        .when(
            (dialect == "syslog") & (enough >= 2),
            none_if_empty(F.regexp_extract(proc, P.uni(r"\[(\d+)\]"), 1)),
        )
        .when((dialect == "openstack") & (enough >= 3), first_word(F.slice(tokens, 1, 4), _all_digits))
    )
    after_level = F.regexp_replace(rest, P.uni_any_case("(?s)^.*?" + P.LEVEL), "")
    body = (
        F.when(at_colon & has_colon, rest.substr(F.instr(rest, ":") + 1, F.length(rest)))
        .when(dialect == "bgl", after_level)
        .when(
            (dialect == "zookeeper") & (zk != ""),
            F.regexp_extract(rest, P.uni(P.ZOOKEEPER_HEADER), 2),
        )
        .otherwise(rest)
    )
    return steps + [
        F.coalesce(service, F.lit("system")).alias("service"),
        F.coalesce(host, F.lit("local")).alias("_host"),
        pid.alias("pid"),
        body.alias("_body"),
    ]


def message_steps(body: str = "_body", fallback: str = "raw") -> list[Column]:
    """``message``: the body without leading marks, or the whole line if none is left."""
    clean = strip(F.regexp_replace(strip(F.col(body)), P.uni(P.LEADING_MARKS), ""))
    return [
        clean.alias("_clean"),
        F.when(F.col("_clean") == "", F.col(fallback)).otherwise(F.col("_clean")).alias("message"),
    ]


# --------------------------------------------------------------------------- #
# Entities
# --------------------------------------------------------------------------- #
def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def entity_steps(source: str = "raw") -> list[Column]:
    """The ``entities`` struct; a plain test spares lines the longer patterns.

    Blocks are listed only when the line names more than one; addresses are
    distinct in order of appearance; all registers are kept.
    """
    text = F.col(source)
    finds = {
        "_blocks": (text.contains("blk_"), P.uni(P.ENT_BLOCK), 1),
        "_reqs": (text.contains("req-"), P.uni(P.ENT_REQUEST), 1),
        "_nodes": (text.contains("-C:J"), P.uni(P.ENT_NODE), 1),
        "_ips": (text.contains("."), P.uni(P.ENT_IPV4), 0),
        "_users": (may_hold(text, ("user",)), P.uni_any_case(P.ENT_USER), 1),
        "_regs": (text.contains("0x"), P.uni(P.ENT_REGISTER), 1),
    }
    steps = [
        F.when(test, _all(text, pattern, group)).alias(name)
        for name, (test, pattern, group) in finds.items()
    ]
    return steps + [
        F.struct(
            _first(F.col("_blocks")).alias("block_id"),
            F.when(F.size("_blocks") > 1, F.array_distinct("_blocks")).alias("all_block_ids"),
            _first(F.col("_reqs")).alias("req_id"),
            _first(F.col("_nodes")).alias("bgl_node"),
            F.when(F.size("_ips") > 0, F.array_distinct("_ips")).alias("ips"),
            _first(F.col("_users")).alias("user"),
            F.when(F.size("_regs") > 0, F.col("_regs")).alias("memory_registers"),
        ).alias("entities")
    ]


# --------------------------------------------------------------------------- #
# Identity and first flag
# --------------------------------------------------------------------------- #
def event_identity(source_id: Column, source_line: Column, stripped_line: Column) -> Column:
    return F.sha2(
        F.concat(source_id, F.lit("\0"), source_line.cast("string"), F.lit("\0"), stripped_line), 256
    )


def initially_anomalous(level: Column) -> Column:
    return level.isin(*P.HOT_LEVELS)
