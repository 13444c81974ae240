"""Chart presets and alarm limits of the service plugins, as plain data.

A chart is a metric name, or a list of items; an item is a metric name or a
``(title, function of the metrics)`` pair.
"""

from __future__ import annotations

# Charts of the host tables, in the order of the brief view.
HOST_TABLES = {
    "psutil_cpu": [["system", "user"], ["irq", "softirq"], "idle", "iowait", "nice"],
    "psutil_memory": [["total", "available", "free", "used"], "percent"],
    "psutil_swap": [["total", "used", "free"], ["sin", "sout"], "percent"],
    "psutil_disk": [["read_bytes", "write_bytes"], ["read_count", "write_count"], ["read_time", "write_time"]],
    "psutil_net": [["bytes_recv", "bytes_sent"], ["packets_recv", "packets_sent"], ["dropin", "dropout"], ["errin", "errout"]],
    "psutil_resource": [["tcp_open", "fd", "handle"], ["process", "thread"], "retransmit", "ctx_switch"],
}

# Charts of the two database plugins.
MYSQL = [
    ["Bytes_received", "Bytes_sent"], ["Queries", "Slow_queries"],
    ["Com_select", "Com_update", "Com_delete", "Com_replace"], ["Com_insert", "Com_insert_select"],
    ["Com_create_table", "Com_drop_table"], ["Com_commit", "Com_rollback", "Com_rollback_to_SP"],
    ["Com_stmt_close", "Com_stmt_execute", "Com_stmt_fetch"], ["Com_stmt_prepare", "Com_stmt_reprepare", "Com_stmt_reset"],
    ["Threads_created", "Threads_running", "Threads_connected", "Threads_cached", "Connections"],
    ["idb_bpool_P_total", "idb_bpool_P_data", "idb_bpool_P_free"], ["idb_bpool_P_dirty", "idb_bpool_P_flushed", "idb_bpool_P_misc"],
    ["idb_bpool_ra", "idb_bpool_ra_evict"], ["idb_data_read", "idb_data_reads", "idb_data_writes", "idb_data_written"],
    ["idb_P_created", "idb_P_read", "idb_P_written"], ["idb_data_read", "idb_data_reads", "idb_data_writes", "idb_data_written"],
    ["idb_P_created", "idb_P_read", "idb_P_written"], ["idb_log_waits", "idb_log_wr_req", "idb_log_writes"],
    ["idb_rows_inserted", "idb_rows_deleted", "idb_rows_read", "idb_rows_updated"],
    ["idb_row_lock_time", "idb_row_lck_avg", "idb_row_lck_max"],
]
CUBRID = [
    ["N_Q_selects", "N_Q_inserts", "N_Q_deletes", "N_Q_updates"], ["N_Q_sscans", "N_Q_iscans", "N_Q_lscans"],
    "buffer_hit_ratio", "Time_ha_rep_delay", "N_net_req",
    ["N_DP_fetches", "N_DP_dirties", "N_DP_ioreads", "N_DP_iowrites", "N_DP_victims", "N_DP_iow_for_R"],
    ["N_LP_ioreads", "N_LP_iowrites"], ["N_log_append_rec", "N_log_archives", "N_log_wals"], ["N_log_start_CP", "N_log_end_CP"],
    ["N_tran_commits", "N_tran_rollbacks", "N_tran_savepoints"], ["N_tran_start_topops", "N_tran_end_topops"],
    ["N_file_creates", "N_file_removes", "N_file_ioreads", "N_file_iowrites", "N_file_iosynches"],
    ["N_btree_inserts", "N_btree_deletes", "N_btree_updates", "N_btree_covered", "N_btree_noncov", "N_btree_MR_opt"],
    ["N_page_locks_acq", "N_page_locks_conv", "N_page_locks_rereq", "N_page_locks_waits"],
    ["N_obj_locks_acq", "N_obj_locks_conv", "N_obj_locks_rereq", "N_obj_locks_waits"],
    ["N_prior_lsa_size", "N_prior_lsa_maxed", "N_prior_lsa_rem"], ["N_ad_flush_P", "N_ad_flush_log_P", "N_ad_flush_max_P"],
]

# Charts of the cache cluster; ratios in percent.
CACHE = [
    ["bytes", "total_malloced", "engine_maxbytes"], "curr_items",
    [("hit_ratio", lambda m: m["get_hits"] / m["cmd_get"] * 100)],
    ["cmd_get", "cmd_set"], "cmd_get", "cmd_set", "evictions", "reclaimed", ["bytes_read", "bytes_written"],
    ["rusage_user", "rusage_system"], "curr_connections", ["cmd_bop_get", "bop_get_ehits", "bop_get_nhits"],
    [("bop_hit_ratio", lambda m: (m["bop_get_ehits"] + m["bop_get_nhits"]) / m["cmd_bop_get"] * 100),
     ("bop_elem_hit_ratio", lambda m: m["bop_get_ehits"] / (m["bop_get_ehits"] + m["bop_get_nhits"]) * 100)],
    ["cmd_lop_create", "cmd_lop_insert", "cmd_lop_get", "cmd_lop_delete"],
    ["cmd_sop_create", "cmd_sop_delete", "cmd_sop_insert", "cmd_sop_get", "cmd_sop_exist"],
    ["cmd_bop_create", "cmd_bop_delete", "cmd_bop_insert", "cmd_bop_update", "cmd_bop_incr", "cmd_bop_decr"],
    ["cmd_bop_count", "cmd_bop_mget", "cmd_bop_smget"],
    ["delete_hits", "incr_hits", "decr_hits", "getattr_hits", "setattr_hits"],
    ["cmd_flush", "cmd_flush_prefix", "hb_count", "hb_latency"],
]

# Limits (level 0, 1, 2) on the change a second, by key pattern.
CHANGE_LIMITS = {
    "host": {"*:net-*": {"bytes_recv": (90000000, 100000000, 110000000), "bytes_sent": (90000000, 100000000, 110000000)},
             "*:resource": {"retransmit": (5, 20, 80)}},
    "redis": {"*:*": {"cpu_user": (500000, 1000000, None), "cpu_sys": (500000, 1000000, None), "evicted_keys": (80000, 100000, 120000),
                      "expired_keys": (80000, None, None), "cmd_processed": (40000, 80000, 200000), "mem_frag": (200, None, None),
                      "memory_rss": (10000000000, None, None)}},
    "cache": {"default": {"rusage_user": (500000, 1000000, None), "rusage_system": (500000, 1000000, None),
                          "evictions": (80000, 100000, 120000), "reclaimed": (80000, None, None), "cmd_get": (40000, 80000, 200000),
                          "cmd_set": (40000, 80000, 200000)}},
}


# Metrics that a collector declares, by kind (heartbeat 60 s, minimum 0, no maximum).
KINDS = {
    "redis": {
        "GAUGE": "connections memory memory_human memory_rss memory_lua mem_frag".split(),
        "DERIVE": ("cmds_processed expired_keys evicted_keys keyspace_hits keyspace_misses cpu_sys cpu_user cpu_sys_children "
                   "cpu_user_children cmd_checkpoint cmd_get cmd_set cmd_del cmd_mget cmd_mset cmd_expire cmd_lindex cmd_linsert "
                   "cmd_llen cmd_lpop cmd_lpush cmd_lrange cmd_sadd cmd_srem cmd_scard cmd_sismember cmd_smembers cmd_zadd "
                   "cmd_zcard cmd_zrange cmd_zrank cmd_zscore cmd_zrem").split(),
    },
    "memcached": {
        "GAUGE": "curr_connections limit_maxbytes bytes curr_items total_malloced".split(),
        "DERIVE": ("rusage_user rusage_system cmd_get cmd_set cmd_flush cmd_touch get_hits delete_hits incr_hits decr_hits cas_hits "
                   "cas_badval touch_hits auth_cmds auth_errors bytes_read bytes_written total_items evictions reclaimed").split(),
    },
    "jstat": {
        "GAUGE": "Survivor_0 Survivor_1 Eden Old Permanent".split(),
        "DERIVE": "YGC YGCT FGC FGCT GCT".split(),
    },
}
HEARTBEAT_S = 60


def items_of(preset: list) -> list[tuple[int, str, int, object]]:
    """(chart number, chart title, item number, item) of a preset."""
    out = []
    for c, chart in enumerate(preset):
        items = [chart] if isinstance(chart, str) else chart
        title = ", ".join(i if isinstance(i, str) else i[0] for i in items)
        out += [(c, title, n, i) for n, i in enumerate(items)]
    return out


class _Names:
    """Stands for a row and for any value made from it; notes the metrics that are asked for."""

    def __init__(self):
        self.used: list[str] = []

    def __getitem__(self, name: str) -> _Names:
        self.used.append(name)
        return self

    def _value(self, _other=None) -> _Names:
        return self

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = _value


def metrics_of(preset: list) -> list[str]:
    """Metrics that a preset shows, in order of first appearance, and those its ratios use."""
    out = []
    for *_, item in items_of(preset):
        names = _Names()
        if not isinstance(item, str):
            item[1](names)
        out += [item] if isinstance(item, str) else names.used
    return list(dict.fromkeys(out))
