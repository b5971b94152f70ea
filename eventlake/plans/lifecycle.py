"""One query for each life-cycle rule, over the numbers of ``plans.rules``."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.functions import lifecycle as L
from eventlake.plans.rules import rule

#: Text values that rules are fed with, by a small number.
_STATES = ["Empty", "PreparingRebalance", "CompletingRebalance", "Stable"]
_SETTINGS = ["retention_ticks", "min_in_sync", "max_message_bytes", "unheard_of"]
_CODECS = ["none", "fast", "balanced", "high", "unheard_of"]


def _pick(number, names):
    out = F.lit(names[-1])
    for k, name in enumerate(names[:-1]):
        out = F.when(number == k, name).otherwise(out)
    return out


def _sql(number, names):
    return f"(CASE {number} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names[:-1])) + f" ELSE '{names[-1]}' END)"


def _declare() -> None:
    n7, n4 = _sql("a", ["create-time", "log-append-time", "broken"]), _sql("a % 4", _STATES)
    rule("rule_token_use", lambda n: L.token_use(n.e, n.f, n.z), "CASE WHEN z THEN 'refused: revoked' WHEN e >= f THEN 'refused: expired' ELSE 'usable' END")
    rule("rule_token_renewal", lambda n: L.token_renewal(n.e, n.f, n.z, n.f + n.b, n.f + n.c), "CASE WHEN z THEN 'refused: revoked' WHEN e >= f THEN 'refused: expired' WHEN b > c THEN 'refused: beyond lifetime' ELSE 'renewed' END")
    rule("rule_reauthentication", lambda n: L.reauthentication(n.e, n.x, n.f), "CASE WHEN NOT x THEN 'refused: other principal' WHEN f <= e THEN 'refused: expiry passed' ELSE 'extended' END")
    rule("rule_session_served", lambda n: L.session_served(n.e, n.f), "CASE WHEN e >= f THEN 'refused: session expired' ELSE 'served' END")
    rule("rule_listener_route", lambda n: L.listener_route(F.when(n.x, "client").otherwise("interbroker"), n.y), "CASE WHEN x AND y THEN 'refused: broker protocol' WHEN NOT x AND NOT y THEN 'refused: client protocol' ELSE 'routed' END")
    rule("rule_throttled_wait", lambda n: L.throttled_wait(n.e, n.f), "greatest(0, f - e)")
    rule("rule_generation_check", lambda n: L.generation_check(n.a, n.c), "CASE WHEN a < c THEN 'refused: stale generation' WHEN a > c THEN 'refused: unknown generation' ELSE 'admitted' END")
    rule("rule_heartbeat_reply", lambda n: L.heartbeat_reply(~n.z, n.a, n.c, n.x), "CASE WHEN z THEN 'refused: not a member' WHEN a < c THEN 'refused: fenced' WHEN x THEN 'rebalance-in-progress' ELSE 'ack' END")
    rule("rule_consumer_liveness", lambda n: L.consumer_liveness(n.e + 100, n.e + n.f, n.e + n.d * 7, F.lit(30), F.lit(50)), "CASE WHEN 100 - greatest(f, d * 7) > 30 THEN 'dead' WHEN 100 - d * 7 > 50 THEN 'stuck' ELSE 'live' END")
    rule("rule_static_return", lambda n: L.static_return(n.e, n.f), "CASE WHEN e > f THEN 'refused: timed out' ELSE 'reclaimed' END")
    rule("rule_group_join", lambda n: L.group_join(n.d, n.c, n.a, n.z), "CASE WHEN z THEN 'member' WHEN d >= c + a THEN 'refused: full' ELSE 'joined' END")
    rule("rule_group_deletion", lambda n: L.group_deletion(n.x, n.z, n.a), "CASE WHEN z THEN 'refused: deleted before' WHEN NOT x THEN 'refused: unknown' WHEN a > 0 THEN 'refused: members' ELSE 'deleted' END")
    target = _sql("b % 4", _STATES)
    rule("rule_group_transition", lambda n: L.group_transition(_pick(n.a % 4, _STATES), _pick(n.b % 4, _STATES)), f"CASE WHEN a % 4 = 0 AND b % 4 = 1 OR a % 4 = 1 AND b % 4 IN (0, 2) OR a % 4 = 2 AND b % 4 IN (1, 3) OR a % 4 = 3 AND b % 4 = 1 THEN {target} ELSE 'refused: transition' END")
    rule("rule_group_commit", lambda n: L.group_commit(_pick(n.a % 4, _STATES), n.b, n.c), f"CASE WHEN {n4} <> 'Stable' THEN 'refused: not stable' WHEN b < c THEN 'refused: stale generation' ELSE 'committed' END")
    rule("rule_delayed_rebalance", lambda n: L.delayed_rebalance(n.b, n.b + n.e, F.lit(3), F.lit(20)), "b + greatest(3, least(e + 3, 20))")
    rule("rule_eager_waste", lambda n: F.round(L.eager_waste(n.e, n.a * 3), 6), "CASE WHEN a * 3 > e THEN NULL WHEN e = 0 THEN 0 ELSE round((e - a * 3) / e, 6) END")
    rule("rule_subscription_mode", lambda n: L.subscription_mode(n.x, n.y & ~n.x, F.when(n.z, "subscribe").otherwise("assign")), "CASE WHEN z THEN CASE WHEN y AND NOT x THEN 'refused: other mode' ELSE 'subscribe' END WHEN x THEN 'refused: other mode' ELSE 'assign' END")
    rule("rule_close_flushed", lambda n: L.close_flush(n.e, n.f)[0], "least(e, f)")
    rule("rule_close_failed", lambda n: L.close_flush(n.e, n.f)[1], "greatest(0, e - f)")
    rule("rule_broker_registration", lambda n: L.broker_registration(F.when(n.x, n.a), n.c, n.y), "CASE WHEN x AND a <> c THEN CASE WHEN y THEN 'refused: id in use' ELSE 'restarted' END ELSE 'registered' END")
    rule("rule_cluster_join", lambda n: L.cluster_join(F.lit("c1"), F.when(n.x, F.concat(F.lit("c"), n.c.cast("string"))).when(n.y, "")), "CASE WHEN NOT x THEN 'adopts' WHEN c <> 1 THEN 'refused: other cluster' ELSE 'joined' END")
    rule("rule_controller_takeover", lambda n: L.takeover(n.a, n.c), "CASE WHEN c <= a AND a <> 0 THEN 'refused: epoch not above' ELSE 'leads' END")
    rule("rule_controller_change", lambda n: L.change_from(n.a, n.c), "CASE WHEN c < a THEN 'refused: stale controller' WHEN c > a THEN 'refused: unknown epoch' ELSE 'applied' END")
    rule("rule_coordinator_ready", lambda n: L.coordinator_ready(n.e, n.f), "CASE WHEN e < f THEN 'refused: loading' ELSE 'ready' END")
    rule("rule_topic_removal", lambda n: L.topic_removal(F.when(n.x, "marked").otherwise("active"), n.e, F.lit(50), n.a), "CASE WHEN NOT x THEN 'refused: not marked' WHEN e < 50 THEN 'refused: grace' WHEN a > 0 THEN 'refused: uncommitted groups' ELSE 'removed' END")
    rule("rule_config_change", lambda n: L.config_change(_pick(n.a % 4, _SETTINGS), n.e, F.lit(40), n.c * 10, n.f), "CASE WHEN a % 4 = 3 THEN 'refused: unknown setting' WHEN a % 4 = 0 AND e < 40 THEN 'refused: below consumer lag' WHEN a % 4 = 1 AND e > c * 10 THEN 'refused: above replication' WHEN a % 4 = 2 AND e > f THEN 'refused: above fetch size' ELSE 'set' END")
    rule("rule_config_faults", lambda n: L.config_faults(n.a, n.c, n.e, n.f), "CASE WHEN a > c AND e <= f THEN 'in-sync+retention' WHEN a > c THEN 'in-sync' WHEN e <= f THEN 'retention' ELSE '' END")
    rule("rule_config_warnings", lambda n: L.config_warnings(n.a, n.c, n.x, n.y), "CASE WHEN x AND y AND a = c AND c > 1 THEN 'compacted-by-size+no-slack' WHEN x AND y THEN 'compacted-by-size' WHEN a = c AND c > 1 THEN 'no-slack' ELSE '' END")
    rule("rule_voter_change", lambda n: L.voter_change(n.c, n.a % 3, n.b % 2), "CASE WHEN c + a % 3 - b % 2 <= 0 THEN 'refused: empty' WHEN a % 3 + b % 2 = 0 THEN 'no change' WHEN a % 3 + b % 2 > 1 THEN 'refused: more than one' ELSE 'changed' END")
    rule("rule_voter_failures_tolerated", lambda n: L.failures_tolerated(n.d), "d - (d // 2 + 1)")
    rule("rule_observer_promotion", lambda n: L.observer_promotion(n.e + 100, n.e + 100 - n.b, n.c), "CASE WHEN b > c THEN 'refused: lag' ELSE 'promoted' END")
    rule("rule_leader_reclaim", lambda n: L.may_reclaim(n.e - 5, n.e + n.b, n.d), "CASE WHEN e < 5 THEN 'refused: out of sync' WHEN b + 5 < d THEN 'refused: hold-down' ELSE 'reclaims' END")
    rule("rule_replica_lag_state", lambda n: L.lag_state(n.e, n.f, n.a, n.c), "CASE WHEN f > e THEN 'refused: ahead of leader' WHEN a <= c THEN 'falling behind' ELSE 'catching up' END")
    rule("rule_watermark_gap", lambda n: L.watermark_gap(n.e, n.f), "CASE WHEN f <= e THEN e - f END")
    rule("rule_recovery_tail", lambda n: L.recovery_tail(n.f, n.e), "CASE WHEN f <= e THEN e - f END")
    rule("rule_startup_plan", lambda n: L.startup_plan(n.a, n.a + n.b - 2, n.x), "CASE WHEN b < 2 THEN 'refused: recovery point beyond log' WHEN x AND b = 2 THEN 'start' WHEN x THEN 'verify tail' ELSE 'recover tail' END")
    rule("rule_move_eta", lambda n: L.move_eta(n.f, n.e, n.c), "CASE WHEN e >= f THEN 0 ELSE (f - e + c - 1) // c END")
    rule("rule_move_state", lambda n: L.move_state(n.f, n.e, n.z), "CASE WHEN z THEN 'cancelled' WHEN e >= f THEN 'eligible' ELSE 'copying' END")
    rule("rule_move_throttle", lambda n: F.round(L.throttle_for(n.f, n.c, F.lit(30)), 6), "CASE WHEN f / c < 30 THEN round(f / c, 6) END")
    rule("rule_follower_read", lambda n: L.follower_read(n.e, n.f, n.x), "CASE WHEN e >= f THEN 'refused: above watermark' WHEN NOT x THEN 'refused: out of sync' ELSE 'served' END")
    rule("rule_delivery_attempt", lambda n: L.delivery_attempt(n.e, n.c, n.d, F.lit(120), n.z), "CASE WHEN z THEN 'delivered' WHEN e + d * 2 ** (c - 1) >= 120 THEN 'failed' ELSE 'retried' END")
    rule("rule_produce_latency", lambda n: L.produce_latency(n.a, n.b, n.d, n.x), "a + b + CASE WHEN x THEN d ELSE 0 END")
    rule("rule_slowest_stage", lambda n: L.slowest_stage(n.a, n.b, n.d, n.x), "CASE WHEN a >= b AND (NOT x OR a >= d) THEN 'queue' WHEN NOT x OR b >= d THEN 'append' ELSE 'replication' END")
    rule("rule_compression_ratio", lambda n: L.compression_ratio(_pick(n.a % 5, _CODECS), n.b + 1), "CASE WHEN a % 5 = 4 THEN NULL WHEN b + 1 < 4 THEN 1 + (a % 5) * ((b + 1) / 4) ELSE 1.0::DOUBLE + a % 5 END")
    rule("rule_poison_policy", lambda n: L.poison(_pick(n.a % 4, ["stop", "skip", "divert", "unheard_of"])), "CASE a % 4 WHEN 0 THEN 'refused: poison' WHEN 1 THEN 'committed' WHEN 2 THEN 'committed and diverted' ELSE 'refused: unknown policy' END")
    rule("rule_reserved_room", lambda n: L.reserved_room(n.e, n.b, F.lit(90)), "CASE WHEN e + b > 90 THEN 'refused: beyond reservation' ELSE 'appended' END")
    rule("rule_buffer_append", lambda n: L.buffer_append(n.e, n.b, F.lit(60), n.d, F.lit(8)), "CASE WHEN e + b <= 60 THEN 'appended' WHEN d <= 8 THEN 'blocked' ELSE 'refused: timeout' END")
    rule("rule_ordered_pair", lambda n: L.ordered_pair(n.a % 3, n.b % 3), "CASE WHEN a % 3 = b % 3 THEN 'ordered' ELSE 'unordered' END")
    rule("rule_query_route", lambda n: L.query_route(n.a % 3, n.b % 3, ~n.z), "CASE WHEN z THEN 'standby' WHEN a % 3 = b % 3 THEN 'local' ELSE 'forwarded' END")
    rule("rule_stamp_choice", lambda n: L.stamp_choice(_pick(n.a, ["create-time", "log-append-time", "broken"])), f"CASE {n7} WHEN 'create-time' THEN 'event time' WHEN 'log-append-time' THEN 'retention' ELSE 'refused: unknown kind' END")

    rule("rule_loop_commit", lambda n: L.loop_commit(n.x, ~n.z, n.y), "CASE WHEN z THEN 'refused: no transaction' WHEN x AND NOT y THEN 'refused: no offset' ELSE 'committed' END")
    rule("rule_response_order", lambda n: L.response_order(n.a, n.c, ~n.z), "CASE WHEN z THEN 'refused: unknown id' WHEN a <> c THEN 'refused: out of order' ELSE 'matched' END")
    rule("rule_wal_apply", lambda n: L.wal_apply(n.a, n.c, n.b), "CASE WHEN a >= c THEN 'refused: not durable' WHEN a <> b THEN 'refused: out of order' ELSE 'applied' END")
    rule("rule_replay_length", lambda n: L.replay_length(n.f + n.e, n.e), "f")
    rule("rule_segment_unlink", lambda n: L.segment_unlink(F.when(~n.z, n.e), F.lit(50), n.a), "CASE WHEN z THEN 'refused: not renamed' WHEN e < 50 AND a > 0 THEN 'refused: readers' ELSE 'unlinked' END")
    rule("rule_topic_by_id", lambda n: L.topic_by_id(n.x, n.y), "CASE WHEN x THEN 'found' WHEN y THEN 'refused: retired id' ELSE 'refused: unknown id' END")
    rule("rule_epoch_claim", lambda n: L.epoch_claim(n.a, n.c), "CASE WHEN c <= a AND a <> 0 THEN 'refused: epoch not above' ELSE 'claimed' END")
    rule("rule_transaction_start", lambda n: L.transaction_start(~n.z, n.a, n.c, n.x), "CASE WHEN z THEN 'refused: unknown' WHEN a < c THEN 'refused: fenced' WHEN x THEN 'refused: open already' ELSE 'begun' END")
    rule("rule_group_type_join", lambda n: L.group_type_join(n.a, F.lit("consumer"), _pick(n.b % 3, ["", "consumer", "connect"])), "CASE WHEN b % 3 = 0 THEN 'refused: no type' WHEN a = 0 THEN CASE b % 3 WHEN 1 THEN 'consumer' ELSE 'connect' END WHEN b % 3 = 2 THEN 'refused: other type' ELSE 'consumer' END")
    rule("rule_plan_submission", lambda n: L.plan_submission(n.x, ~n.z, n.a % 2), "CASE WHEN NOT x THEN 'refused: not the leader' WHEN z THEN 'refused: other members' WHEN a % 2 > 0 THEN 'refused: partition twice' ELSE 'accepted' END")
    rule("rule_cache_install", lambda n: L.cache_install(n.a, n.c), "CASE WHEN c < a THEN 'refused: older metadata' ELSE 'installed' END")
    rule("rule_chain_write", lambda n: L.chain_write(n.a, n.c), "CASE WHEN a <> c THEN 'refused: not the head' ELSE 'written' END")
    rule("rule_chain_read", lambda n: L.chain_read(n.a, n.d), "CASE WHEN a <> d THEN 'refused: not the tail' ELSE 'read' END")
    rule("rule_follower_truncation", lambda n: L.follower_truncation(n.z, n.e, n.f), "CASE WHEN z THEN 'refused: serving' WHEN f > e THEN 'refused: beyond log' ELSE 'truncated' END")
    rule("rule_unregistration", lambda n: L.unregistration(n.a % 3, n.b % 3), "CASE WHEN a % 3 > 0 THEN 'refused: leads' WHEN b % 3 > 0 THEN 'refused: hosts' ELSE 'unregistered' END")
    rule("rule_rolling_step", lambda n: L.rolling_step(~n.z, n.y, n.a % 2), "CASE WHEN z THEN 'refused: unknown broker' WHEN y THEN 'refused: restarted before' WHEN a % 2 > 0 THEN 'refused: under-replicated' ELSE 'restarted' END")
    rule("rule_request_offer", lambda n: L.request_offer(n.z, n.b, n.c), "CASE WHEN z OR b < c THEN 'queued' ELSE 'shed' END")
    rule("rule_pool_acquire", lambda n: L.pool_acquire(n.a, F.when(~n.z, n.c)), "CASE WHEN z THEN 'refused: unknown class' WHEN a >= c THEN 'refused: pool full' ELSE 'acquired' END")
    rule("rule_handshake", lambda n: L.handshake(_pick(n.a % 4, ["new", "chosen", "authenticating", "complete"]), n.x, n.y), "CASE WHEN a % 4 IN (0, 3) THEN 'refused: no mechanism' WHEN NOT x THEN 'authenticating' WHEN y THEN 'complete' ELSE 'failed' END")
    rule("rule_snapshot_load", lambda n: L.snapshot_load(n.e, n.f, n.b), "CASE WHEN e > f THEN 'refused: ahead of log' WHEN e < b THEN 'refused: older snapshot' ELSE 'loaded' END")
    rule("rule_internal_topic", lambda n: L.internal_topic(n.z, n.a, n.c), "CASE WHEN z THEN 'refused: user topic' WHEN a <> c THEN 'refused: partition count' ELSE 'created' END")
    rule("rule_pause", lambda n: L.pause(~n.z, n.y), "CASE WHEN z THEN 'refused: not assigned' WHEN y THEN 'paused already' ELSE 'paused' END")
    rule("rule_fetched", lambda n: L.fetched(n.b, n.e, n.f), "CASE WHEN e <= f THEN least(b, f - e) END")
    rule("rule_trace_survived", lambda n: L.trace_survived(F.create_map(F.lit("trace"), n.a, F.lit("span"), n.c), F.when(n.x, F.create_map(F.lit("trace"), n.a, F.lit("span"), n.d)).otherwise(F.create_map(F.lit("trace"), n.b, F.lit("__lake.hop"), n.c))), "x AND c = d")


_declare()
