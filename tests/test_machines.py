"""The state machines against plain loops."""

from __future__ import annotations

import random

import pytest

from eventlake.operators import machines as M


@pytest.fixture(scope="module")
def history():
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(300):
        t += rng.randint(0, 9)
        rows.append((rng.randint(0, 2), t, i, rng.random() < 0.4, rng.randint(-5, 5), rng.randint(0, 6)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, history):
    return spark.createDataFrame(history, "k long, t long, i long, failed boolean, delta long, item long").repartition(3)


def check(df, history, loop):
    got = {r.k: tuple(r.result) for r in df.collect()}
    assert got == {k: loop([r for r in history if r[0] == k]) for k in {r[0] for r in history}}


def test_circuit_breaker(frame, history):
    def loop(rows):
        streak, opened, passed, refused, opens = 0, None, 0, 0, 0
        for _, t, _, failed, *_ in rows:
            if opened is not None and t - opened < 15:
                refused += 1
                continue
            probe, passed = opened is not None, passed + 1
            streak = streak + 1 if failed else 0
            opened = None
            if failed and (probe or streak >= 3):
                streak, opened, opens = 0, t, opens + 1
        return streak, opened, passed, refused, opens

    check(M.circuit_breaker(frame, ["k"], "t", "i", "failed", 3, 15), history, loop)


def test_hysteresis(frame, history):
    def loop(rows):
        level, paused, pauses, off = 0, False, 0, 0
        for *_, delta, _ in rows:
            if paused and delta > 0:
                off += 1
            else:
                level = max(0, level + delta)
            was = paused
            paused = True if level >= 12 else False if level <= 4 else paused
            pauses += paused and not was
        return level, paused, pauses, off

    check(M.hysteresis(frame, ["k"], "i", "delta", 12, 4), history, loop)


def test_lru(frame, history):
    def loop(rows):
        held, hits, misses = [], 0, 0
        for r in rows:
            hits, misses = (hits + 1, misses) if r[5] in held else (hits, misses + 1)
            held = [r[5], *(x for x in held if x != r[5])][:3]
        return held, hits, misses

    check(M.lru_hits(frame, ["k"], "i", "item", 3), history, loop)


def test_budget_and_dedupe(frame, history):
    def budget(rows):
        n = retries = refused = 0
        for r in rows:
            n += 1
            if r[3] and (retries + 1) * 100 <= n * 20:
                retries += 1
            elif r[3]:
                refused += 1
        return n, retries, refused

    def dedupe(rows):
        since, yes, no = None, 0, 0
        for _, t, *_ in rows:
            if since is not None and t - since < 20:
                no += 1
            else:
                since, yes = t, yes + 1
        return since, yes, no

    check(M.retry_budget(frame, ["k"], "i", "failed", 20), history, budget)
    check(M.dedupe_window(frame, ["k"], "t", "i", 20), history, dedupe)


def test_leases_and_writes(frame, history):
    def lease(rows):
        holder, until, token, renewed, refused = None, None, 0, 0, 0
        for _, t, _, _, _, who in rows:
            if until is None or t >= until:
                holder, until, token = who, t + 25, token + 1
            elif who == holder:
                until, renewed = t + 25, renewed + 1
            else:
                refused += 1
        return holder, until, token, renewed, refused

    def writes(rows):
        version = conflicts = 0
        for r in rows:
            if r[5] == version:
                version += 1
            else:
                conflicts += 1
        return version, conflicts

    check(M.leases(frame, ["k"], "t", "i", "item", 25), history, lease)
    check(M.optimistic_writes(frame, ["k"], "i", "item"), history, writes)


def test_credits(frame, history):
    def loop(rows):
        credit, sent, blocked = 2, 0, 0
        for r in rows:
            if r[4] > 0:
                credit += r[4]
            elif credit > 0:
                credit, sent = credit - 1, sent + 1
            else:
                blocked += 1
        return credit, sent, blocked

    check(M.credits(frame, ["k"], "i", "delta", 2), history, loop)
