import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from assayer.llm import conversation_repair as cr

SHAPE = re.compile(r"(s?(ua)+)?")


def damage(conv, turn, role, text):
    said = lambda x: " " if x is None else str(x)
    kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
    role, text = said(role), said(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults_of(rows):
    out, known = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in known else "truncated" if body[-1] not in ".!?" else "")
        known.add((role, text))
    return out


def every_edit(rows, faults, inserts):
    """All edits: (cost, audit, turns) with up to `inserts` insertions in a place."""
    gaps = [g for n in range(inserts + 1) for g in itertools.product(("user", "assistant"), repeat=n)]
    options = []
    for (_, role, text), what in zip(rows, faults, strict=True):
        own = [("D", 3, [])]
        if what not in ("blank", "duplicate"):
            cut = what == "truncated"
            own += [("K", cut, [(role, text)]), ("R", 2 + cut, [("user", text)]), ("R", 2 + cut, [("assistant", text)])]
        options += [[("I" * len(g), 2 * len(g), [(r, "") for r in g]) for g in gaps], own]
    options.append([("I" * len(g), 2 * len(g), [(r, "") for r in g]) for g in gaps])
    best = None
    for choice in itertools.product(*options):
        cost = sum(c for _, c, _ in choice)
        if best and cost > best[0]:
            continue
        turns = [t for _, _, ts in choice for t in ts]
        if SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
            found = (cost, "".join(a for a, _, _ in choice), turns)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def by_strings(rows, faults):
    """The same by tuples of cost and letters, kept for each last role."""
    now = {"": (0, "", [])}
    ahead = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def put(into, state, item):
        if state not in into or item[:2] < into[state][:2]:
            into[state] = item

    for (_, role, text), what in zip(rows, faults, strict=True):
        then = {}
        for state, (cost, audit, turns) in now.items():
            for at, c, a, t in ((state, cost, audit, turns), (ahead[state], cost + 2, audit + "I", [*turns, (name[ahead[state]], "")])):
                put(then, at, (c + 3, a + "D", t))
                if what in ("blank", "duplicate"):
                    continue
                c += what == "truncated"
                initial = role[:1]
                if initial == ahead[at] or (initial == "s" and at == ""):
                    put(then, initial, (c, a + "K", [*t, (role, text)]))
                put(then, ahead[at], (c + 2, a + "R", [*t, (name[ahead[at]], text)]))
        now = then
    ends = [v for k, v in now.items() if k in ("", "a")]
    if "u" in now:
        c, a, t = now["u"]
        ends.append((c + 2, a + "I", [*t, ("assistant", "")]))
    return min(ends, key=lambda e: e[:2])


def expected(table, repair):
    out = {}
    for conv, rows in table.items():
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", r[2] or " "))
        after = sorted((d for r in ordered for d in damage(conv, *r)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = faults_of(after)
        numbers = [r[0] for r in after if r[0] is not None]
        initials = [r[1][:1] for r in after]
        cost, audit, turns = repair(after, faults) if after else (0, "", [])
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
        )
    return out


def result(df):
    columns = [*cr._TOTALS, "audit", "repaired_sha256"]
    rows = df.collect()
    got = {r.conv_id: tuple(r[c] for c in columns) for r in rows}
    assert len(got) == len(rows)
    return got


def random_table(seed, convs, longest):
    rng = random.Random(seed)
    table = {}
    for conv in range(convs):
        rows = []
        for turn in range(rng.randint(1, longest)):
            rows.append((None if rng.random() < 0.05 else turn + (rng.random() < 0.1), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "Yes.", "no", "  ", None, "What?\n", f"Line {turn}.", "é!"])))
        table[conv if conv else None] = rows
    return table


def frame(spark, table):
    return spark.createDataFrame([(conv, *r) for conv, rows in table.items() for r in rows], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(("seed", "convs", "longest", "inserts"), [(1, 60, 3, 1), (2, 12, 3, 2), (3, 20, 4, 1)])
def test_cheapest_edits_of_all(seed, convs, longest, inserts):
    for rows in random_table(seed, convs, longest).values():
        rows = [(t, r or " ", x or " ") for t, r, x in rows]
        faults = faults_of(rows)
        assert by_strings(rows, faults)[:2] == every_edit(rows, faults, inserts)[:2]
        told = [(*r, False) for r in rows]
        path, added, totals = cr.chained([cr.summary(told, cr.faults(told), [0])])
        audit, turns = cr.repaired_piece(told, faults, path[0], added)
        assert (totals["cost"], audit, turns) == every_edit(rows, faults, inserts)


def test_query_equals_strings(spark):
    table = random_table(4, 300, 12)
    assert result(cr.digested(cr.repaired(cr.damaged(frame(spark, table))))) == expected(table, by_strings)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").toPandas()
    table = {c: list(zip(g.turn.tolist(), g.role.tolist(), g.text.tolist(), strict=True)) for c, g in rows.groupby("conv_id")}
    assert result(cr.query(spark, "/root/testdata/sf0.01")) == expected(table, by_strings)


def test_long_conversations_lie_in_many_tasks(spark, monkeypatch):
    """One conversation has a third of all rows, one more is cut too; pieces are chained."""
    monkeypatch.setattr(cr, "PIECE", 16)
    rng = random.Random(5)
    table = random_table(6, 400, 8)
    for conv, n in ((1000, 1500), (2000, 700), (None, 300)):
        table[conv] = [(t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "end", f"Turn {t}.", ""])) for t in range(n)]
    rows = cr.damaged(frame(spark, table))
    pieces = cr.repaired(rows).toPandas()
    assert (pieces[pieces.conv_id == 1000].pieces > 1).all()
    assert result(cr.digested(cr.repaired(rows))) == expected(table, by_strings)


def test_edges(spark):
    schema = "conv_id string, turn long, role string, text string, piece int, audit string"
    assert cr.digested(cr.repaired(cr.damaged(spark.createDataFrame([], schema)))).count() == 0
    rows = [("a", None, None, None, 1, "x")] * 3 + [("b", 7, "user", "word " * 20000 + ".", 2, "y")] + [(None, t, "system", "S.", 3, None) for t in range(3)]
    table = {}
    for conv, turn, role, text, *_ in rows:
        table.setdefault(conv, []).append((turn, role, text))
    assert result(cr.digested(cr.repaired(cr.damaged(spark.createDataFrame(rows, schema))))) == expected(table, by_strings)
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = cr.digested(cr.repaired(cr.damaged(spark.createDataFrame(pd.DataFrame({"conv_id": [dropped], "turn": [0], "role": ["user"], "text": ["Hi."]}))))).collect()
    assert [(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in one] == [(dropped, 0, "", hashlib.sha256(b"").hexdigest())]
