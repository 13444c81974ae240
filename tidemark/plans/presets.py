"""Canned chart presets per plugin (layouts as data, derived items as Column
lambdas).  Fixed values: metric names and ratio formulas of the views."""

from __future__ import annotations

from pyspark.sql import functions as F

# Hit-ratio formulas of the plugin views (percent).
HIT_RATIOS = {
    "redis": ("hit ratio", lambda m: F.try_divide(m["keyspace_hits"], m["keyspace_hits"] + m["keyspace_misses"]) * 100),
    "memcached": ("hit ratio", lambda m: F.try_divide(m["get_hits"], m["cmd_get"]) * 100),
    "cache_bop": ("bop hit ratio",
                  lambda m: F.try_divide(m["bop_get_elem_hits"] + m["bop_get_none_hits"], m["cmd_bop_get"]) * 100),
    "cache_elem": ("element hit ratio",
                   lambda m: F.try_divide(m["bop_get_elem_hits"], m["bop_get_elem_hits"] + m["bop_get_none_hits"]) * 100),
}

# Chart layouts (one entry per chart; lists are multi-item charts).
LAYOUTS = {
    "memcached": [["cmd_get", "get_hits"], ["bytes_recv", "bytes_sent"]],
    "redis": [["cmds_processed"], ["keyspace_hits", "keyspace_misses"], ["memory"]],
    "jstat": [["YGC", "FGC"], ["YGCT", "FGCT"], ["E", "O"]],
    "net": [["bytes_sent", "bytes_recv"], "cmd_get", "get_hits"],
}

# Metric kinds declared by the host-metrics collector per table
# (heartbeat 60 s, minimum 0, no maximum).
HOST_KINDS = {
    "psutil_cpu": [("user", "DERIVE"), ("system", "DERIVE"), ("idle", "DERIVE"), ("nice", "DERIVE"),
                   ("iowait", "DERIVE"), ("irq", "DERIVE"), ("softirq", "DERIVE")],
    "psutil_memory": [("total", "GAUGE"), ("available", "GAUGE"), ("percent", "GAUGE"), ("used", "GAUGE"),
                      ("free", "GAUGE")],
    "psutil_swap": [("total", "GAUGE"), ("used", "GAUGE"), ("free", "GAUGE"), ("percent", "GAUGE"),
                    ("sin", "DERIVE"), ("sout", "DERIVE")],
    "psutil_disk": [("read_count", "DERIVE"), ("write_count", "DERIVE"), ("read_bytes", "DERIVE"),
                    ("write_bytes", "DERIVE"), ("read_time", "DERIVE"), ("write_time", "DERIVE")],
    "psutil_net": [("bytes_sent", "DERIVE"), ("bytes_recv", "DERIVE"), ("packets_sent", "DERIVE"),
                   ("packets_recv", "DERIVE"), ("errin", "DERIVE"), ("errout", "DERIVE"), ("dropin", "DERIVE"),
                   ("dropout", "DERIVE")],
    "psutil_resource": [("process", "GAUGE"), ("thread", "GAUGE"), ("fd", "GAUGE"), ("handle", "GAUGE"),
                        ("ctx_switch", "GAUGE"), ("tcp_open", "GAUGE"), ("retransmit", "DERIVE")],
}
HOST_HEARTBEAT_S = 60


def host_catalog_rows():
    """(plugin, metric, kind, heartbeat_s) rows of the declared host catalog."""
    return [(tbl, m, k, HOST_HEARTBEAT_S) for tbl, ms in HOST_KINDS.items() for m, k in ms]
