"""Repairs do not depend on the number of partitions, and are among all that cost least."""

from __future__ import annotations

import itertools
import random

import pytest

from strikeline.llm import chat


@pytest.fixture
def partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]

    def use(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "false")

    yield use
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_ties_over_partitions(spark, partitions):
    rng = random.Random(4)
    rows = [(1, None, rng.choice(["user", "assistant", None, "bot"]), f"text {rng.randint(0, 10**6)}", k) for k in range(1500)]
    rows += [(2, 1, "user", "x" * 300 + str(k % 7), 0) for k in range(40)] + [(None, None, None, None, 0)] * 3
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra int").repartition(5).cache()
    found = []
    for n in (1, 4, 16):
        partitions(n)
        found.append(sorted(map(str, chat.repair(turns).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def every_repair(roles):
    """(cost, ((action, role_out, inserted), ...)) of all ways through the automaton."""
    for afters in itertools.product((chat.SYSTEM, chat.USER, chat.ASSISTANT), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, cost, out = chat.START, 0, []
            for role, after, merge in zip(roles, afters, merges, strict=True):
                relabel = 0 if role == after else chat.RELABEL_COST[role, after]
                if merge and state == after:
                    out.append(("merge", chat.ROLES[after - 1], 0))
                    cost += relabel + chat.MERGE_COST
                elif not merge and (state, after) in chat.BETWEEN:
                    n = len(chat.BETWEEN[state, after])
                    out.append(("relabel" if relabel else "keep", chat.ROLES[after - 1], n))
                    cost += relabel + n * chat.INSERT_COST
                else:
                    break
                state = after
            else:
                n = len(chat.CLOSING[state])
                a, r, k = out[-1]
                out[-1] = (a, r, k + n)
                yield cost + n * chat.INSERT_COST, tuple(out)


def rendered(path, texts):
    """The turns that a repair makes, in the form in which conversations are written."""
    turns, state = [], chat.START
    for (action, role, _), text in zip(path, texts, strict=True):
        after = chat.ROLES.index(role) + 1
        if action == "merge":
            turns[-1] = (turns[-1][0], turns[-1][1] + "\n" + text)
        else:
            turns += [(chat.ROLES[s - 1], "") for s in chat.BETWEEN[state, after]] + [(role, text)]
        state = after
    turns += [(chat.ROLES[s - 1], "") for s in chat.CLOSING[state]]
    return "".join(chat._opened(chat.ROLES.index(r) + 1, t) + chat._END for r, t in turns)


def test_against_every_repair(spark):
    rng = random.Random(9)
    rows = [(c, k, rng.choice(["system", "user", "assistant", None]), f"t{c}-{k}") for c in range(60) for k in range(rng.randint(1, 4))]
    by = {}
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.turn)
        ways = list(every_repair([chat.role_of(r.role) for r in own]))
        least = min(cost for cost, _ in ways)
        path = tuple((r.action, r.role_out, r.inserted) for r in own)
        assert (sum(r.cost for r in own), path) in [w for w in ways if w[0] == least]
        assert "".join(r.fragment for r in own) == rendered(path, [r.text for r in own])
