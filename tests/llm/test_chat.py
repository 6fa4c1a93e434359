import itertools
import random

import pytest

from crowdtrust.llm import chat_repair as cr


def cheapest(roles):
    """Least cost by trying every emitted role and every insertion."""
    best = float("inf")
    for new in itertools.product(cr.ROLES, repeat=len(roles)):
        for inserted in itertools.product((None, *cr.ROLES), repeat=len(roles)):
            cost, last, ok = 0.0, None, True
            for r, x, y in zip(roles, new, inserted, strict=True):
                cost += 0 if r == x else cr.RELABEL if r in cr.ROLES else cr.RELABEL_UNKNOWN
                if y:
                    cost += cr.INSERT
                    ok &= legal(last, y)
                    last = y
                    ok &= legal(last, x)
                elif last == x:
                    cost += cr.MERGE
                else:
                    ok &= legal(last, x)
                last = x
                if not ok:
                    break
            if ok:
                best = min(best, cost + (cr.INSERT if last == "system" else 0))
    return best


def legal(a, b):
    return (a, b) in {(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def turns(rendered):
    """Roles and texts of a rendered conversation."""
    out = []
    while rendered:
        assert rendered.startswith("<|")
        role, rest = rendered[2:].split("|>\n", 1)
        text, rendered = rest.split("<|end|>\n", 1)
        out.append((role, text))
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cost_is_least(n):
    for roles in itertools.product((*cr.ROLES, None), repeat=n):
        steps = cr.rendered(roles, ["t"] * n, 0, None)
        assert abs(sum(s[3] for s in steps) - cheapest(roles)) < 1e-9, roles
        got = turns("".join(s[4] for s in steps))
        assert all(legal(a, b) for a, b in zip([None, *(r for r, _ in got)], [r for r, _ in got], strict=False)) and got[-1][0] != "system"
        assert "".join(t for _, t in got).replace(cr.JOIN, "") == "t" * n


def test_pieces_chain_to_the_whole():
    r = random.Random(0)
    for _ in range(200):
        roles = [r.choice([*cr.ROLES, "tool"]) for _ in range(r.randint(1, 12))]
        cuts = sorted(r.sample(range(len(roles) + 1), r.randint(0, min(3, len(roles)))))
        parts = [p for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True) if (p := roles[a:b])]
        whole = sum(s[1] for s in cr.path(roles, 0, None)) + cr.END[cr.path(roles, 0, None)[-1][0]]
        total, state = 0.0, 0
        for p, (entry, leave) in zip(parts, cr.chain([cr.costs(p) for p in parts]), strict=True):
            assert entry == state
            steps = cr.path(p, entry, leave)
            state = steps[-1][0]
            total += sum(s[1] for s in steps)
        assert abs(total + cr.END[state] - whole) < 1e-9


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, seq string")


def test_conversations(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "User ", "bot", None]), f"c{c}t{t}") for c in range(60) for t in range(r.randint(1, 7))]
    rows += [(1000, t, r.choice(["user", "assistant"]), f"hot {t}") for t in range(900)]  # over many partitions
    rows += [(2000, 0, "user", None), (2000, 0, "user", None), (None, 1, "assistant", "a"), (None, None, "user", "b")]
    out = cr.repair(messages(spark, rows).repartition(5)).collect()
    assert len(out) == len(rows)
    for conv in {c for c, *_ in rows}:
        own = sorted((x for x in out if x.conv_id == conv), key=lambda x: x.seq)
        assert [x.seq for x in own] == list(range(len(own)))
        assert [(x.turn is not None, x.turn) for x in own] == sorted((t is not None, t) for c, t, *_ in rows if c == conv)
        roles = [x.role.strip().lower() if x.role else None for x in own]
        steps = cr.path(roles, 0, None)
        assert abs(sum(x.cost for x in own) - sum(s[1] for s in steps) - cr.END[steps[-1][0]]) < 1e-9
        got = turns("".join(x.piece for x in own))
        assert all(legal(a, b) for a, b in zip([None, *(x for x, _ in got)], [x for x, _ in got], strict=False))
    assert "".join(x.piece for x in sorted((x for x in out if x.conv_id is None), key=lambda x: x.seq)) == "<|user|>\nb<|end|>\n<|assistant|>\na<|end|>\n"
    assert cr.repair(messages(spark, [])).collect() == []


def test_hot_conversation_is_spread(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", "t") for t in range(3000)] + [(8, 0, "user", "u")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sorted((x for x in cr.repair(messages(spark, rows)).collect() if x.conv_id == 7), key=lambda x: x.seq)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    steps = cr.path([r for c, _, r, _ in rows if c == 7], 0, None)
    assert abs(sum(x.cost for x in out) - sum(s[1] for s in steps)) < 1e-9 and [x.turn for x in out] == list(range(3000))
