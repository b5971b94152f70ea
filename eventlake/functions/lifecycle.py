"""Life-cycle rules of clients, groups, brokers and sessions as column expressions.

Each returns a verdict; what must not happen is a verdict that begins with ``refused``. All take and
return columns and stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _refused(why: str) -> Column:
    return F.lit(f"refused: {why}")


# --- tokens, sessions, listeners ----------------------------------------------------------------


def token_use(now: Column, expiry: Column, revoked: Column) -> Column:
    return F.when(revoked, _refused("revoked")).when(now >= expiry, _refused("expired")).otherwise("usable")


def token_renewal(now: Column, expiry: Column, revoked: Column, extend_to: Column, lifetime_end: Column) -> Column:
    """A live token can be extended up to the end of its lifetime."""
    return F.when(revoked, _refused("revoked")).when(now >= expiry, _refused("expired")).when(extend_to > lifetime_end, _refused("beyond lifetime")).otherwise("renewed")


def reauthentication(now: Column, same_principal: Column, new_expiry: Column) -> Column:
    return F.when(~same_principal, _refused("other principal")).when(new_expiry <= now, _refused("expiry passed")).otherwise("extended")


def session_served(now: Column, expiry: Column) -> Column:
    return F.when(now >= expiry, _refused("session expired")).otherwise("served")


def listener_route(role: Column, internal_protocol: Column) -> Column:
    """Client listeners take client protocols, the others those between brokers."""
    return F.when((role == "client") & internal_protocol, _refused("broker protocol")).when((role == "interbroker") & ~internal_protocol, _refused("client protocol")).otherwise("routed")


def throttled_wait(now: Column, next_allowed: Column) -> Column:
    """Ticks that a channel stays muted."""
    return F.greatest(F.lit(0), next_allowed - now)


# --- groups -------------------------------------------------------------------------------------


def generation_check(member: Column, group: Column) -> Column:
    return F.when(member < group, _refused("stale generation")).when(member > group, _refused("unknown generation")).otherwise("admitted")


def heartbeat_reply(known: Column, member: Column, group: Column, rebalancing: Column) -> Column:
    return F.when(~known, _refused("not a member")).when(member < group, _refused("fenced")).when(rebalancing, "rebalance-in-progress").otherwise("ack")


def consumer_liveness(now: Column, last_heartbeat: Column, last_poll: Column, session: Column, poll_interval: Column) -> Column:
    """A poll is a heartbeat too."""
    seen = F.greatest(last_heartbeat, last_poll)
    return F.when(now - seen > session, "dead").when(now - last_poll > poll_interval, "stuck").otherwise("live")


def static_return(gone: Column, timeout: Column) -> Column:
    return F.when(gone > timeout, _refused("timed out")).otherwise("reclaimed")


def group_join(members: Column, partitions: Column, standby: Column, already: Column) -> Column:
    return F.when(already, "member").when(members >= partitions + standby, _refused("full")).otherwise("joined")


def group_deletion(known: Column, deleted: Column, members: Column) -> Column:
    return F.when(deleted, _refused("deleted before")).when(~known, _refused("unknown")).when(members > 0, _refused("members")).otherwise("deleted")


def group_transition(state: Column, target: Column) -> Column:
    """Empty -> PreparingRebalance -> CompletingRebalance -> Stable, and back to preparing; preparing may empty."""
    allowed = (
        state.isin("Empty", "CompletingRebalance", "Stable") & (target == "PreparingRebalance")
        | (state == "PreparingRebalance") & target.isin("CompletingRebalance", "Empty")
        | (state == "CompletingRebalance") & (target == "Stable")
    )
    return F.when(allowed, target).otherwise(_refused("transition"))


def group_commit(state: Column, member: Column, group: Column) -> Column:
    return F.when(state != "Stable", _refused("not stable")).when(member < group, _refused("stale generation")).otherwise("committed")


def delayed_rebalance(first_join: Column, last_join: Column, base: Column, most: Column) -> Column:
    """When a rebalance begins: joins push it out by ``base``, to ``most`` behind the first at most."""
    return F.greatest(first_join + base, F.least(last_join + base, first_join + most))


def eager_waste(total: Column, moved: Column) -> Column:
    """The share of partitions that an eager rebalance pauses for nothing."""
    return F.when(moved > total, F.lit(None)).when(total == 0, F.lit(0.0)).otherwise((total - moved) / total)


def subscription_mode(subscribed: Column, assigned: Column, wanted: Column) -> Column:
    """A consumer subscribes or is assigned, never both."""
    return F.when((wanted == "subscribe") & assigned | (wanted == "assign") & subscribed, _refused("other mode")).otherwise(wanted)


def close_flush(pending: Column, acked: Column) -> tuple[Column, Column]:
    """(flushed, failed) of a producer's records when it closes."""
    return F.least(acked, pending), pending - F.least(acked, pending)


# --- brokers and topics -------------------------------------------------------------------------


def broker_registration(held: Column, incarnation: Column, previous_alive: Column) -> Column:
    other = held.isNotNull() & (held != incarnation)
    return F.when(other & previous_alive, _refused("id in use")).when(other, "restarted").otherwise("registered")


def cluster_join(cluster: Column, presented: Column) -> Column:
    return F.when(F.coalesce(presented, F.lit("")) == "", "adopts").when(presented != cluster, _refused("other cluster")).otherwise("joined")


def takeover(current: Column, epoch: Column) -> Column:
    return F.when((epoch <= current) & (current != 0), _refused("epoch not above")).otherwise("leads")


def change_from(current: Column, epoch: Column) -> Column:
    return F.when(epoch < current, _refused("stale controller")).when(epoch > current, _refused("unknown epoch")).otherwise("applied")


def coordinator_ready(replayed: Column, end: Column) -> Column:
    return F.when(replayed < end, _refused("loading")).otherwise("ready")


def topic_removal(state: Column, marked_for: Column, grace: Column, uncommitted: Column) -> Column:
    return F.when(state != "marked", _refused("not marked")).when(marked_for < grace, _refused("grace")).when(uncommitted > 0, _refused("uncommitted groups")).otherwise("removed")


def config_change(setting: Column, value: Column, worst_lag: Column, copies: Column, fetch_most: Column) -> Column:
    """Whether an override keeps retention above consumer lag, the quorum within the copies and messages fetchable."""
    return (
        F.when((setting == "retention_ticks") & (value < worst_lag), _refused("below consumer lag"))
        .when((setting == "min_in_sync") & (value > copies), _refused("above replication"))
        .when((setting == "max_message_bytes") & (value > fetch_most), _refused("above fetch size"))
        .when(setting.isin("retention_ticks", "min_in_sync", "max_message_bytes"), "set")
        .otherwise(_refused("unknown setting"))
    )


def config_faults(in_sync: Column, copies: Column, retention: Column, roll: Column) -> Column:
    return F.concat_ws("+", F.when(in_sync > copies, "in-sync"), F.when(retention <= roll, "retention"))


def config_warnings(in_sync: Column, copies: Column, compacted: Column, by_size: Column) -> Column:
    return F.concat_ws("+", F.when(compacted & by_size, "compacted-by-size"), F.when((in_sync == copies) & (copies > 1), "no-slack"))


def voter_change(voters: Column, added: Column, removed: Column) -> Column:
    """One voter at a time joins or leaves; never the last."""
    return F.when(voters + added - removed <= 0, _refused("empty")).when(added + removed == 0, "no change").when(added + removed > 1, _refused("more than one")).otherwise("changed")


def majority(voters: Column) -> Column:
    return F.floor(voters / 2) + 1


def failures_tolerated(voters: Column) -> Column:
    return voters - majority(voters)


def observer_promotion(leader: Column, observer: Column, most_lag: Column) -> Column:
    return F.when(leader - observer > most_lag, _refused("lag")).otherwise("promoted")


# --- replication --------------------------------------------------------------------------------


def may_reclaim(in_sync_since: Column, now: Column, hold_down: Column) -> Column:
    """A preferred leader takes over again once it has been in sync for the hold-down; -1 is out of sync."""
    return F.when(in_sync_since < 0, _refused("out of sync")).when(now - in_sync_since < hold_down, _refused("hold-down")).otherwise("reclaims")


def catch_up_rate(bandwidth: Column, writes: Column) -> Column:
    return bandwidth - writes


def lag_state(leader: Column, follower: Column, bandwidth: Column, writes: Column) -> Column:
    return F.when(follower > leader, _refused("ahead of leader")).when(bandwidth <= writes, "falling behind").otherwise("catching up")


def watermark_gap(leader: Column, answered: Column) -> Column:
    """What a follower does not expose yet; null where it claims more than the leader has."""
    return F.when(answered <= leader, leader - answered)


def recovery_tail(point: Column, end: Column) -> Column:
    return F.when(point <= end, end - point)


def startup_plan(point: Column, end: Column, clean: Column) -> Column:
    return F.when(point > end, _refused("recovery point beyond log")).when(clean & (end == point), "start").when(clean, "verify tail").otherwise("recover tail")


def move_eta(total: Column, copied: Column, throttle: Column) -> Column:
    return F.ceil((total - F.least(copied, total)) / throttle).cast("bigint")


def move_state(total: Column, copied: Column, cancelled: Column) -> Column:
    return F.when(cancelled, "cancelled").when(copied >= total, "eligible").otherwise("copying")


def throttle_for(to_move: Column, seconds: Column, link: Column) -> Column:
    """Bytes a second that meet a deadline; null where the link cannot carry them."""
    return F.when(to_move / seconds < link, to_move / seconds)


def follower_read(offset: Column, high_watermark: Column, in_sync: Column) -> Column:
    return F.when(offset >= high_watermark, _refused("above watermark")).when(~in_sync, _refused("out of sync")).otherwise("served")


# --- produce path -------------------------------------------------------------------------------


def delivery_attempt(elapsed: Column, attempt: Column, base: Column, timeout: Column, succeeded: Column) -> Column:
    """Retries back off by doubling until the next would end beyond the timeout."""
    return F.when(succeeded, "delivered").when(elapsed + base * F.pow(F.lit(2), attempt - 1) >= timeout, "failed").otherwise("retried")


def produce_latency(queue: Column, append: Column, slowest_follower: Column, acks_all: Column) -> Column:
    return queue + append + F.when(acks_all, slowest_follower).otherwise(0)


def slowest_stage(queue: Column, append: Column, slowest_follower: Column, acks_all: Column) -> Column:
    """The stage that takes longest, the earlier one of equals."""
    wait = F.when(acks_all, slowest_follower).otherwise(-1)
    return F.when((queue >= append) & (queue >= wait), "queue").when(append >= wait, "append").otherwise("replication")


#: Nominal ratio of each codec; batches below four records reach a part of it.
CODEC_RATIO = {"none": 1.0, "fast": 2.0, "balanced": 3.0, "high": 4.0}


def compression_ratio(codec: Column, records: Column) -> Column:
    """The ratio that batches of so many records reach; null for an unknown codec."""
    nominal = F.lit(None).cast("double")
    for name, ratio in CODEC_RATIO.items():
        nominal = F.when(codec == name, F.lit(ratio)).otherwise(nominal)
    return F.when(records < 4, 1.0 + (nominal - 1.0) * (records / 4)).otherwise(nominal)


def poison(policy: Column) -> Column:
    """What an undecodable record does to its partition."""
    return F.when(policy == "stop", _refused("poison")).when(policy == "skip", "committed").when(policy == "divert", "committed and diverted").otherwise(_refused("unknown policy"))


def reserved_room(held: Column, size: Column, reserved: Column) -> Column:
    return F.when(held + size > reserved, _refused("beyond reservation")).otherwise("appended")


def buffer_append(held: Column, size: Column, capacity: Column, freed_in: Column, most_block: Column) -> Column:
    """A full producer buffer blocks until room is freed, or fails at its timeout."""
    return F.when(held + size <= capacity, "appended").when(freed_in <= most_block, "blocked").otherwise(_refused("timeout"))


def ordered_pair(slot_a: Column, slot_b: Column) -> Column:
    return F.when(slot_a == slot_b, "ordered").otherwise("unordered")


def query_route(owner: Column, arrived_at: Column, owner_alive: Column) -> Column:
    """Where a keyed look-up is answered."""
    return F.when(~owner_alive, "standby").when(owner == arrived_at, "local").otherwise("forwarded")


def stamp_choice(kind: Column) -> Column:
    """What a topic's kind of time stamp is good for."""
    return F.when(kind == "create-time", "event time").when(kind == "log-append-time", "retention").otherwise(_refused("unknown kind"))


# --- transactions, logs and queues --------------------------------------------------------------


def loop_commit(exactly_once: Column, open_txn: Column, offset_given: Column) -> Column:
    """Whether a consume-transform-produce round may commit: with exactly-once its offset is part of the transaction."""
    return F.when(~open_txn, _refused("no transaction")).when(exactly_once & ~offset_given, _refused("no offset")).otherwise("committed")


def response_order(received: Column, oldest: Column, outstanding: Column) -> Column:
    """Responses come in the order of their requests."""
    return F.when(~outstanding, _refused("unknown id")).when(received != oldest, _refused("out of order")).otherwise("matched")


def wal_apply(offset: Column, durable_to: Column, applied_to: Column) -> Column:
    return F.when(offset >= durable_to, _refused("not durable")).when(offset != applied_to, _refused("out of order")).otherwise("applied")


def replay_length(entries: Column, checkpoint: Column) -> Column:
    return entries - checkpoint


def segment_unlink(renamed_for: Column, delay: Column, readers: Column) -> Column:
    """A renamed segment (not null) goes once its delay is over or its last reader has finished."""
    return F.when(renamed_for.isNull(), _refused("not renamed")).when((renamed_for < delay) & (readers > 0), _refused("readers")).otherwise("unlinked")


def topic_by_id(live: Column, retired: Column) -> Column:
    return F.when(live, "found").when(retired, _refused("retired id")).otherwise(_refused("unknown id"))


def epoch_claim(current: Column, epoch: Column) -> Column:
    return F.when((epoch <= current) & (current != 0), _refused("epoch not above")).otherwise("claimed")


def transaction_start(registered: Column, epoch: Column, current: Column, open_txn: Column) -> Column:
    return F.when(~registered, _refused("unknown")).when(epoch < current, _refused("fenced")).when(open_txn, _refused("open already")).otherwise("begun")


def group_type_join(members: Column, group_type: Column, member_type: Column) -> Column:
    return F.when(member_type == "", _refused("no type")).when(members == 0, member_type).when(member_type != group_type, _refused("other type")).otherwise(group_type)


def plan_submission(is_leader: Column, same_members: Column, duplicates: Column) -> Column:
    """Only the leader's plan counts, for exactly the members, and with no partition twice."""
    return F.when(~is_leader, _refused("not the leader")).when(~same_members, _refused("other members")).when(duplicates > 0, _refused("partition twice")).otherwise("accepted")


def cache_install(cached: Column, version: Column) -> Column:
    return F.when(version < cached, _refused("older metadata")).otherwise("installed")


def chain_write(node: Column, head: Column) -> Column:
    return F.when(node != head, _refused("not the head")).otherwise("written")


def chain_read(node: Column, tail: Column) -> Column:
    return F.when(node != tail, _refused("not the tail")).otherwise("read")


def follower_truncation(serving: Column, log_end: Column, divergence: Column) -> Column:
    """A new follower stops serving before it truncates, and never grows by it."""
    return F.when(serving, _refused("serving")).when(divergence > log_end, _refused("beyond log")).otherwise("truncated")


def unregistration(leads: Column, hosts: Column) -> Column:
    return F.when(leads > 0, _refused("leads")).when(hosts > 0, _refused("hosts")).otherwise("unregistered")


def rolling_step(known: Column, restarted: Column, under_replicated: Column) -> Column:
    return F.when(~known, _refused("unknown broker")).when(restarted, _refused("restarted before")).when(under_replicated > 0, _refused("under-replicated")).otherwise("restarted")


def request_offer(is_control: Column, depth: Column, capacity: Column) -> Column:
    """Control requests are never shed."""
    return F.when(is_control | (depth < capacity), "queued").otherwise("shed")


def pool_acquire(in_use: Column, size: Column) -> Column:
    """A null size is an unknown class."""
    return F.when(size.isNull(), _refused("unknown class")).when(in_use >= size, _refused("pool full")).otherwise("acquired")


def handshake(state: Column, done: Column, ok: Column) -> Column:
    """The state after one exchange of an authentication."""
    return F.when(~state.isin("chosen", "authenticating"), _refused("no mechanism")).when(~done, "authenticating").when(ok, "complete").otherwise("failed")


def snapshot_load(offset: Column, log_end: Column, loaded_from: Column) -> Column:
    return F.when(offset > log_end, _refused("ahead of log")).when(offset < loaded_from, _refused("older snapshot")).otherwise("loaded")


def internal_topic(taken_by_user: Column, partitions: Column, source_partitions: Column) -> Column:
    return F.when(taken_by_user, _refused("user topic")).when(partitions != source_partitions, _refused("partition count")).otherwise("created")


def pause(assigned: Column, paused: Column) -> Column:
    return F.when(~assigned, _refused("not assigned")).when(paused, "paused already").otherwise("paused")


def fetched(count: Column, position: Column, leader_end: Column) -> Column:
    """Records that a follower receives; null where it stands beyond its leader."""
    return F.when(position <= leader_end, F.least(count, leader_end - position))


def trace_survived(sent: Column, received: Column) -> Column:
    """Whether every client header (a map) came through unchanged."""
    return F.forall(F.map_entries(sent), lambda e: F.try_element_at(received, e["key"]).eqNullSafe(e["value"]))
