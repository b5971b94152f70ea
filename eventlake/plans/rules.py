"""One query for each rule, over numbers derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions import rules as R
from eventlake.sources.tables import table

NUMBERS = """m AS (SELECT p_partkey AS id, p_partkey % 7 AS a, p_partkey % 11 AS b, p_partkey % 5 + 1 AS c, p_partkey % 13 + 1 AS d, (p_partkey * 17) % 101 AS e,
    (p_partkey * 31) % 97 + 1 AS f, p_partkey % 2 = 0 AS x, p_partkey % 3 = 0 AS y, p_partkey % 5 = 0 AS z, CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'leader' ELSE 'all' END AS mode FROM part)"""


def numbers(spark, sf_dir):
    k = F.col("p_partkey")
    mode = F.when(k % 3 == 0, "none").when(k % 3 == 1, "leader").otherwise("all")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 7).alias("a"), (k % 11).alias("b"), (k % 5 + 1).alias("c"), (k % 13 + 1).alias("d"), ((k * 17) % 101).alias("e"),
        ((k * 31) % 97 + 1).alias("f"), (k % 2 == 0).alias("x"), (k % 3 == 0).alias("y"), (k % 5 == 0).alias("z"), mode.alias("mode"),
    )


class _Names:
    """Columns as attributes; a column needs a session, which there is none of at import."""

    def __getattr__(self, name):
        return F.col(name)


def rule(name: str, column, sql: str) -> None:
    """Registers the query of one rule: (id, result)."""

    def query(spark, sf_dir):
        return numbers(spark, sf_dir).select("id", column(_Names()).alias("result"))

    query.__name__, query.__doc__ = name, f"The rule {name} over derived numbers."
    register(name, f"WITH {NUMBERS} SELECT id, {sql} AS result FROM m")(query)


def _declare() -> None:
    rule("rule_partition_share", lambda n: R.partition_share(n.e, n.d, n.b + 3), "CASE WHEN e = 0 THEN 0 WHEN d > b + 3 THEN d ELSE least(e, b + 3) END")
    rule("rule_cached_from", lambda n: R.cached_from(n.e + 100, n.f, n.c), "e + 100 - f // c")
    rule("rule_read_cost", lambda n: R.read_cost(n.x, n.y), "CASE WHEN x THEN 8.0::DOUBLE WHEN y THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")
    rule("rule_follower_may_serve", lambda n: R.follower_may_serve(n.e + 20, n.e + 20 - n.b, n.c * 2, n.d), "b <= c * 2 AND b <= d")
    rule("rule_format_path", lambda n: R.format_path(n.a, n.c), "CASE WHEN a > c THEN 'refused' WHEN a = c THEN 'zero-copy' ELSE 'converted' END")
    rule("rule_delivery_guarantee", lambda n: R.delivery_guarantee(n.mode == "all", n.x, n.y, n.z, n.x & n.y), "CASE WHEN mode <> 'all' OR NOT z THEN 'at-most-once' WHEN x AND y THEN 'exactly-once' ELSE 'at-least-once' END")
    rule("rule_order_is_safe", lambda n: R.order_is_safe(n.c, n.x), "c = 1 OR x")
    rule("rule_would_reorder", lambda n: R.would_reorder(n.c, n.x, n.y), "NOT (c = 1 OR x) AND y")
    rule("rule_ack_outcome", lambda n: R.ack_outcome(n.mode, n.a, n.c), "CASE mode WHEN 'none' THEN 'nothing' WHEN 'leader' THEN 'follower loss' ELSE CASE WHEN a < c THEN 'refused' ELSE 'leader loss' END END")
    rule("rule_loses_record", lambda n: R.loses_record(n.mode, n.x), "CASE mode WHEN 'none' THEN true WHEN 'leader' THEN x ELSE false END")
    rule("rule_block_budget_left", lambda n: R.block_budget_left(F.lit(60), n.e, n.b), "greatest(0, 60 - e - b)")
    rule("rule_durability_source", lambda n: R.durability_source(n.x, n.c), "CASE WHEN c >= 2 AND x THEN 'both' WHEN c >= 2 THEN 'replication' WHEN x THEN 'fsync' ELSE 'none' END")
    rule("rule_linger_batch", lambda n: R.linger_batch(n.c, n.a, F.lit(12)), "least(c * a + 1, 12)")
    rule("rule_produce_error", lambda n: R.produce_error(F.when(n.a == 0, "ack-lost").when(n.a == 1, "not-leader").when(n.a == 2, "invalid-topic").when(n.a == 3, "request-timeout").otherwise("serialization-error"), n.x), "CASE WHEN a IN (1, 3) OR (a = 0 AND x) THEN 'retriable' WHEN a = 0 THEN 'ambiguous' ELSE 'fatal' END")
    rule("rule_first_gate", lambda n: R.first_gate(n.e, F.lit(90), F.lit(80), F.when(n.x, n.b * 5), F.lit(60)), "CASE WHEN e > 90 THEN 'batch' WHEN e > 80 THEN 'request' WHEN e > CASE WHEN x THEN b * 5 ELSE 60 END THEN 'message' ELSE 'fits' END")
    rule("rule_compaction_state", lambda n: R.compaction_state(n.e, F.lit(20), F.lit(70)), "CASE WHEN e < 20 THEN 'not-yet-eligible' WHEN e > 70 THEN 'overdue' ELSE 'eligible' END")
    rule("rule_tombstone_removable", lambda n: R.tombstone_removable(n.e, n.b, F.lit(30), n.f, n.e), "e - b >= 30 AND f > e")
    rule("rule_grace_over", lambda n: R.grace_over(n.e, n.b, F.lit(40)), "e >= b + 40")
    rule("rule_roll_triggers", lambda n: R.roll_triggers(n.e, n.f, n.b, 60, 50, 8), "concat_ws('+', CASE WHEN e >= 60 THEN 'size' END, CASE WHEN f >= 50 THEN 'time' END, CASE WHEN b >= 8 THEN 'index' END)")
    rule("rule_active_consumers", lambda n: R.active_consumers(n.a, n.c), "least(a, c)")
    rule("rule_idle_consumers", lambda n: R.idle_consumers(n.a, n.c), "greatest(0, a - c)")
    rule("rule_replay_window", lambda n: R.replay_window(n.b, n.c), "b * c")
    rule("rule_commit_failure", lambda n: R.commit_failure(F.when(n.a < 3, "transient").when(n.a < 5, "coordinator-moved").otherwise("illegal-generation"), n.b, F.lit(6)), "CASE WHEN a < 3 AND b < 6 THEN 'retry' WHEN a BETWEEN 3 AND 4 THEN 'redirect' ELSE 'abandon' END")
    rule("rule_safe_poll", lambda n: R.safe_poll(n.f, n.c), "greatest(1, floor(f * 0.8::DOUBLE / c))::BIGINT")
    rule("rule_tolerated_misses", lambda n: R.tolerated_misses(n.f + 5, n.c), "(f + 5) // c - 1")
    rule("rule_resume_offset", lambda n: R.resume_offset(F.when(n.x, n.e)), "CASE WHEN x THEN e ELSE -1 END")
    rule("rule_catch_up_ticks", lambda n: R.catch_up_ticks(n.f, n.e, n.c), "CASE WHEN e >= f THEN 0 ELSE ceil((f - e) / c)::BIGINT END")
    rule("rule_rack_losses_survived", lambda n: R.rack_losses_survived(n.a + 1, n.c), "greatest(0, c - ceil((a + 1) / c)::BIGINT)")
    rule("rule_admits", lambda n: R.admits(n.mode == "all", n.a, n.c), "mode <> 'all' OR a >= c")
    rule("rule_epoch_check", lambda n: R.epoch_check(n.a, n.c), "CASE WHEN a < c THEN 'stale-leader' WHEN a > c THEN 'broker-behind' ELSE 'current' END")
    rule("rule_truncation_point", lambda n: R.truncation_point(n.e, n.f), "least(e, f)")
    rule("rule_sloppy_outcome", lambda n: R.sloppy_outcome(n.a, n.b, F.lit(5)), "CASE WHEN a >= 5 THEN 'clean' WHEN a + b >= 5 THEN 'sloppy' ELSE 'failed' END")
    rule("rule_catch_up_by", lambda n: R.catch_up_by(n.e, n.f), "CASE WHEN e < f THEN 'snapshot' ELSE 'replay' END")
    rule("rule_metadata_use", lambda n: R.metadata_use(n.e, 30, 80), "CASE WHEN e <= 30 THEN 'read-write' WHEN e <= 80 THEN 'read-only' ELSE 'refresh' END")
    rule("rule_read_index_served", lambda n: R.read_index_served(n.a, n.c, n.f, n.e), "a >= c // 2 + 1 AND f >= e")
    rule("rule_planned_partitions", lambda n: R.planned_partitions(n.f, n.c, n.a + 1), "greatest(ceil(f / c)::BIGINT, a + 1) + greatest(1, greatest(ceil(f / c)::BIGINT, a + 1) // 4)")
    rule("rule_write_amplification", lambda n: F.round(R.write_amplification(n.f, n.c, n.a, n.e), 6), "round((f * c + f * a + e) / f, 6)")
    rule("rule_handles_at_risk", lambda n: R.handles_at_risk(n.e, n.f, F.lit(300)), "e * 3 + f >= 270")
    rule("rule_throttle_ticks", lambda n: R.throttle_ticks(n.e, n.d, F.lit(10)), "CASE WHEN e <= d THEN 0 ELSE floor(10 * (e - d) / d)::BIGINT END")
    rule("rule_call_verdict", lambda n: R.call_verdict(n.f, n.e, n.b), "CASE WHEN e >= f THEN 'expired' WHEN b > f - e THEN 'refused' ELSE 'begins' END")
    rule("rule_gossip_rounds", lambda n: R.gossip_rounds(n.f, n.c), "CASE WHEN f = 1 THEN 0 ELSE ceil(round(ln(f) / ln(1 + c), 9))::BIGINT END")
    rule("rule_negotiated", lambda n: R.negotiated(n.a, n.a + n.c, n.c, n.c + n.b), "CASE WHEN a <= c + b AND c <= a + c THEN least(a + c, c + b) END")
    rule("rule_routed", lambda n: R.routed(n.b, n.c, n.c + 4), "CASE WHEN b < c THEN 'too-old' WHEN b > c + 4 THEN 'too-new' ELSE 'routed' END")
    rule("rule_hedges", lambda n: R.hedges(n.e, n.f, n.x), "NOT x AND e >= f")
    rule("rule_quota_level", lambda n: R.quota_level(F.when(n.x & n.y, n.a), F.when(n.x, n.b), F.when(n.z, n.c)), "CASE WHEN x AND y THEN 'user+client' WHEN x THEN 'user' WHEN z THEN 'client' ELSE 'default' END")


_declare()
