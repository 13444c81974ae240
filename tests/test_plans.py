"""Physical-plan properties the design relies on."""

from tidemark.plans.registry import load_all

REG = load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_parquet_scan(spark, sf):
    p = _plan(REG["range_scan"][0](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p and "LessThan(ts" in p


def test_lookback_scan_is_pushed_down(spark, sf):
    p = _plan(REG["bucket_max"][0](spark, sf))
    assert "PushedFilters" in p and "GreaterThanOrEqual(ts" in p


def test_layout_join_is_broadcast(spark, sf):
    p = _plan(REG["chart_layout"][0](spark, sf))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_placement_has_no_following_unbounded_frame(spark, sf):
    p = _plan(REG["ring_placement"][0](spark, sf))
    assert "unboundedfollowing" not in p.lower().replace("unboundedpreceding$(), unboundedfollowing", "")


def test_one_scan_where_one_is_enough(spark, sf):
    for name in ("bitmask", "rollup_tiers", "fleet_search"):
        scans = _plan(REG[name][0](spark, sf)).split("Initial Plan")[0].count("FileScan parquet")
        assert scans <= {"fleet_search": 2}.get(name, 1), name


def test_glob_prefix_reaches_the_scan(spark, sf):
    from tidemark.functions.patterns import matches
    df = spark.read.parquet(f"{sf}/nation.parquet")
    assert "StringStartsWith(n_name,NA" in _plan(df.where(matches("n_name", "NA*")))
    assert "StringStartsWith(n_name,NA" in _plan(df.where(matches("n_name", "NA?[0-9]")))


def test_nested_ordered_operators_share_their_input(spark, sf):
    """Rows and slice ends come from one shuffle; alarms are found once for tables and walk."""
    most = {"derive_prev": 1, "history_expr": 1, "downsample_minmax": 1, "delta": 2, "change_per_sec": 3, "declared_kinds": 1,
            "threshold_alarms": 5, "predicate_alarms": 5, "suppressed_alarms": 8, "quiet_hours": 8}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reused exchanges show in the plan before it runs
    try:
        scans = {q: _plan(REG[q][0](spark, sf)).count("FileScan parquet") for q in most}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {q: n for q, n in scans.items() if n > most[q]} == {}


def test_series_of_servers_are_shuffled_once(spark, sf):
    """Lines are dealt by server; buckets, positions, sums and rollups of its series need no other shuffle."""
    names = ("chained_tiers", "rollup_tiers", "merge_plugins", "history_expr", "derive_prev", "downsample_minmax", "declared_kinds",
             "unstack", "unnest_sample")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = {q: _plan(REG[q][0](spark, sf)) for q in names}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # unstack and unnest_sample read the counters of hosts too, which are cut into slices
    most = {"unstack": 1, "unnest_sample": 1}
    for q, p in plans.items():
        dealt = sum("Exchange hashpartitioning(entity" in line for line in p.splitlines() if "Reused" not in line)
        others = sum("Exchange hashpartitioning(" in line and "user_id" not in line for line in p.splitlines() if "Reused" not in line) - dealt
        assert dealt - most.get(q, 0) <= 2 * most.get(q, 0) + 1 and others <= 2 * most.get(q, 0), (q, p)
