"""Conversation repair against exhaustive search over edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tripstrata.llm import repair
from tripstrata.llm.catalogue import QUERIES

SPACE = " \t\n\x0b\x0c\r"
FORM = re.compile(r"\A(s?(ua)+)?\Z")
ROLES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, turns) by a table over (rows read, initials so far mod the grammar), weights compared whole."""
    found = faults(rows)

    def alive(initials):
        return re.match(r"\A(s?(ua)*u?)?\Z", initials)

    def state(initials):
        return initials[-1:] if len(initials) < 2 else initials[-1]

    best = {"": (0, "", "", [])}
    for at in range(len(rows) + 1):
        # insertions here: at most two in a row can matter, as two bring the state back
        for _ in range(2):
            for cost, audit, initials, turns in list(best.values()):
                for letter in "ua":
                    new = (cost + 5, audit + "I", initials + letter, [*turns, (ROLES[letter], "")])
                    if alive(new[2]) and (state(new[2]) not in best or new[:2] < best[state(new[2])][:2]):
                        best[state(new[2])] = new
        if at == len(rows):
            break
        role, text = rows[at]
        ahead = {}
        for cost, audit, initials, turns in best.values():
            more = 5 if found[at] == "truncated" else 0
            options = [(cost + 2, audit + "D", initials, turns)]
            if found[at] not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    options.append((cost + more, audit + "K", initials + role[0], [*turns, (role, text)]))
                options += [(cost + more + 1, audit + "R", initials + x, [*turns, (ROLES[x], text)]) for x in "ua"]
            for new in options:
                if alive(new[2]) and (state(new[2]) not in ahead or new[:2] < ahead[state(new[2])][:2]):
                    ahead[state(new[2])] = new
        best = ahead
    return min((v for v in best.values() if FORM.match(v[2])), key=lambda v: v[:2])


def expected(turns):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, text)} of rows (conv, turn, role, text)."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = [t[0] for t in own if t[0] is not None]
        rows = [t[1:] for t in own]
        counts = [faults(rows).count(x) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, _, left = cheapest(rows)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in left))
    return out


def exhaustive(rows):
    """All edit strings with up to three insertions."""
    found, best = faults(rows), None

    def walk(at, initials, cost, audit, inserted):
        nonlocal best
        if at == len(rows) and FORM.match(initials) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < 3:
            for letter in "ua":
                walk(at, initials + letter, cost + 5, audit + "I", inserted + 1)
        if at == len(rows):
            return
        walk(at + 1, initials, cost + 2, audit + "D", inserted)
        if found[at] not in ("blank", "duplicate"):
            more = 5 * (found[at] == "truncated")
            if rows[at][0][:1]:
                walk(at + 1, initials + rows[at][0][0], cost + more, audit + "K", inserted)
            for letter in "ua":
                walk(at + 1, initials + letter, cost + more + 1, audit + "R", inserted)

    walk(0, "", 0, "", 0)
    return best


def random_rows(draw, most=6):
    return [
        (draw.choice(["user", "assistant", "system", "tool", " ", ""]), draw.choice(["a.", "b?", "c", " ", "", "d! ", "e" * draw.randint(1, 3) + "."]))
        for _ in range(draw.randint(0, most))
    ]


def test_agenda_against_all_edits():
    draw = random.Random(5)
    for _ in range(150):
        rows = random_rows(draw, 4)
        marks = faults(rows)
        deduced = [(r[:1], f in ("blank", "duplicate"), 5 * (f == "truncated")) for (r, _), f in zip(rows, marks, strict=True)]
        (path,) = repair.solved(deduced, rows, [0], True)
        assert (path["cost"], path["audit"]) == exhaustive(rows) == cheapest(rows)[:2]


def found(spark, turns, **options):
    table = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, conv string, piece int")
    facts, pieces = repair.repair(table, **options)
    texts = {}
    for r in pieces.orderBy("conv", "piece").collect():
        audit, lines = texts.setdefault(r.conv, ([], []))
        audit.append(r.audit)
        lines.extend(f"{t.role}:{t.text}" for t in r.turns)
    digests = {r.conv: (r.audit, r.repaired_sha256) for r in repair.digests(pieces).collect()}
    out = {r.conv: (*r[1:], "".join(texts[r.conv][0]), "\n".join(texts[r.conv][1])) for r in facts.collect()}
    assert digests == {conv: (v[6], hashlib.sha256(v[7].encode()).hexdigest()) for conv, v in out.items()}
    return out


@pytest.mark.parametrize("most", [500, 3])
def test_repair(spark, most):
    draw = random.Random(most)
    turns = []
    for conv in [*range(40), None, 2**60 + 1, 2**60 + 3]:
        for n, (role, text) in enumerate(random_rows(draw, 9)):
            turns.append((conv, draw.choice([n, n + 1, None, 2 * n]), role, text))
    turns += [(99, 1, "user", "same.")] * 7 + [(98, n, "user", f"{n}.") for n in range(40)]
    assert found(spark, turns, most=most, width=5) == expected(turns)


def test_nulls_and_nothing(spark):
    turns = [(1, 0, None, None), (1, 1, "user", None), (2, None, "user", "hi."), (2, None, "assistant", "ho.")]
    assert found(spark, turns) == expected([(c, t, r or " ", x or " ") for c, t, r, x in turns])
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    facts, pieces = repair.repair(empty)
    assert facts.count() == pieces.count() == repair.digests(pieces).count() == 0


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        part = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = expected(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", "")
    got = {r.conv_id: r for r in QUERIES["op13_conversation_repair"](spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        *facts, text = wanted.get(conv, none)
        assert tuple(r[1:8]) == tuple(facts)
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
