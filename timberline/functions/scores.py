"""Per-event score expressions and actor keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import patterns as P
from timberline.functions.text import half_up, lookup

THRESHOLD = 0.55


def has_keyword(message: Column) -> Column:
    return message.rlike(P.uni_any_case(P.KEYWORDS))


def severity_base(level: Column) -> Column:
    return lookup(F.upper(level), P.SEVERITY_BASE, P.SEVERITY_BASE_OTHER)


def severity_number(level: Column) -> Column:
    return lookup(F.upper(level), P.SEVERITY_NUMBER, P.SEVERITY_NUMBER_OTHER)


def fused_score(severity: Column, keyword: Column, rarity: Column, burst: Column, forest: Column) -> Column:
    total = (
        severity + F.when(keyword, 0.25).otherwise(0.0) + rarity * 0.20 + burst + forest * 0.25
    )
    return half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3)


def fused_flag(score: Column, severity: Column, keyword: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold) | (keyword & (severity >= 0.50)) | (severity >= 0.80)


def stateless_score(level: Column, keyword: Column, initial: Column) -> Column:
    """Severity and keyword only, never below the first flag's score; fit for streams."""
    fresh = F.least(F.lit(1.0), severity_base(level) + F.when(keyword, 0.25).otherwise(0.0))
    return half_up(F.greatest(initial, fresh), 3)


def stateless_flag(score: Column, level: Column, keyword: Column) -> Column:
    return (score >= THRESHOLD) | (keyword & (severity_base(level) >= 0.50))


def _tagged(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), value)


def actor_key(entities: Column, service: Column) -> Column:
    """First concrete entity, else the service."""
    return F.coalesce(
        _tagged("block_id", entities["block_id"]),
        _tagged("req_id", entities["req_id"]),
        _tagged("user", entities["user"]),
        _tagged("bgl_node", entities["bgl_node"]),
        _tagged("service", F.coalesce(F.nullif(service, F.lit("")), F.lit("unknown"))),
    )


def concrete_keys(entities: Column) -> Column:
    """Entities that name one actor: block, request, user, node."""
    return F.array_compact(
        F.array(
            _tagged("block_id", entities["block_id"]),
            _tagged("req_id", entities["req_id"]),
            _tagged("user", entities["user"]),
            _tagged("bgl_node", entities["bgl_node"]),
        )
    )


def wide_keys(entities: Column, service: Column, host: Column) -> Column:
    """Concrete keys plus service and non-local host."""
    return F.concat(
        concrete_keys(entities),
        F.array_compact(
            F.array(
                F.when(service != "", _tagged("svc", service)),
                F.when((host != "") & (host != "local"), _tagged("host", host)),
            )
        ),
    )


def entity_labels(entities: Column, host: Column) -> Column:
    """List values bare, single values as key:value, host when it is not local."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.array_compact(
            F.array(
                _tagged("block_id", entities["block_id"]),
                _tagged("req_id", entities["req_id"]),
                _tagged("bgl_node", entities["bgl_node"]),
                _tagged("user", entities["user"]),
                F.when((host != "") & (host != "local"), _tagged("host", host)),
            )
        ),
        F.coalesce(entities["all_block_ids"], none),
        F.coalesce(entities["ips"], none),
        F.coalesce(entities["memory_registers"], none),
    )


def session_key(entities: Column, host: Column, service: Column) -> Column:
    return F.coalesce(
        _tagged("block", entities["block_id"]),
        _tagged("req", entities["req_id"]),
        _tagged("user", entities["user"]),
        F.when((host != "") & (host != "local"), _tagged("host", host)),
        _tagged("svc", service),
    )
