"""Conversation repair against all edit sequences in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from graphloom.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, first string, audit string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """conv_id -> [(turn, role, text)] after damage, in order; conversations without rows too."""
    out = {}
    said = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        own = out.setdefault(conv_id, [])
        role, text, action = said(role), said(text), zlib.crc32(f"{said(conv_id)}:{said(turn)}".encode()) % 20
        if action == 0:
            continue
        text = "" if action == 1 else re.sub("[.!?]", "", text) if action == 2 else text
        own += [(turn, "user" if action == 4 else role, text)] * (2 if action == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit) by a search over prefixes: rows used, what the grammar has behind it -> the least value."""
    best = {(0, ""): (0, "")}
    todo = [(0, "", 0, "")]
    while todo:
        todo.sort()
        cost, audit, at, state = todo.pop(0)
        if best.get((at, state), (cost, audit)) < (cost, audit):
            continue
        moves = []
        want = "a" if state == "u" else "u"
        moves.append((2, "I", at, want))
        if at < len(rows):
            moves.append((3, "D", at + 1, state))
            if fault[at] not in ("blank", "duplicate"):
                late, initial = fault[at] == "truncated", rows[at][1][:1]
                moves.append((2 + late, "R", at + 1, want))
                if initial == want or (initial == "s" and at >= 0 and state == ""):
                    moves.append((late, "K", at + 1, initial))
        for c, e, i, s in moves:
            new = (cost + c, audit + e)
            if new < best.get((i, s), (10**9, "")):
                best[i, s] = new
                todo.append((*new, i, s))
    return min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)


def brute(rows):
    out = []
    for conv_id, own in damage(rows).items():
        f = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(own, f)
        lines, at, state = [], 0, ""
        for e in audit:
            want = "a" if state == "u" else "u"
            role, text = own[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e == "D":
                continue
            state = role[0] if e == "K" else want
            lines.append(f"{role}:{text}" if e == "K" else f"{ {'u': 'user', 'a': 'assistant'}[want]}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def made(seed, n, long=()):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(long[c] if c < len(long) else rnd.randrange(0, 8)):
            turn = None if rnd.random() < 0.05 else t + rnd.randrange(2)
            rows.append((c, turn, rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice([None, "", " \n", "Yes.", "No!", "well", "so?\t", f"a{t}. ", f"b{rnd.random()}"])))
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def valid(audit, initials):
    """The roles' initials that an audit leaves, R and I as the grammar wants them."""
    out, at = "", 0
    for e in audit:
        want = "a" if out[-1:] == "u" else "u"
        out += "" if e == "D" else initials[at] if e == "K" else want
        at += e != "I"
    return at == len(initials) and bool(re.fullmatch("(s?(ua)+)?", out))


@pytest.mark.parametrize("seed", range(4))
def test_parse_equals_all_audits(seed):
    rnd = random.Random(seed)
    for _ in range(6):
        tokens = [conversations.Token(rnd.choice("suat"), rnd.choice(["", "", "truncated", "blank"]), 1) for _ in range(rnd.randrange(5))]
        price = {"K": 0, "R": 2, "D": 3, "I": 2}
        found = []
        for n in range(len(tokens) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                edits = [e for e in audit if e != "I"]
                if len(edits) == len(tokens) and all(t.fault != "blank" or e == "D" for t, e in zip(tokens, edits, strict=True)) and valid(audit, [t.initial for t in tokens]):
                    cost = sum(price[e] for e in audit) + sum(t.fault == "truncated" and e != "D" for t, e in zip(tokens, edits, strict=True))
                    found.append((cost, "".join(audit)))
        assert conversations.best(conversations.parse(tokens)) == min(found)


def test_parts_join_to_the_whole():
    rnd = random.Random(8)
    for _ in range(60):
        tokens = [conversations.Token(rnd.choice("suat"), rnd.choice(["", "truncated", "blank"]), rnd.choice([1, 1, 3])) for _ in range(12)]
        whole = conversations.parse(tokens)
        at = rnd.randrange(13)
        left = conversations.parse(tokens[:at])
        ends = {}
        for mid, (c, x) in left.items():
            for end, (d, y) in conversations.parse(tokens[at:], mid).items():
                ends[end] = min(ends.get(end, (10**9, "")), (c + d, x + y))
        assert ends == whole


def test_defined_cases(spark):
    rows = made(1, 120)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), *[(500, 2, "user", "Again.")] * 5, *rows[:3]]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone.")]
    for parts in (1, 5):
        assert got(conversations.repair_damaged(frame(spark, rows, parts))) == brute(rows)
    assert conversations.repair_damaged(frame(spark, [])).count() == 0


def test_conversations_of_many_chunks(spark):
    """Chunks of few rows, over several ranges: results are those of whole conversations."""
    rows = made(2, 30, long=(400, 150, 60))
    assert got(conversations.repair_damaged(frame(spark, rows), 7)) == brute(rows)


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "end."), (1, 1, "assistant", " " * 200_000 + "." + " " * 200_000), (2, 0, "user", "x" * 1_000_000)]
    assert got(conversations.repair_damaged(frame(spark, rows))) == brute(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_conversation_repair"](spark, sf_dir)) == brute(rows)
