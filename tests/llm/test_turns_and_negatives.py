"""Chat formatting, conversation repair and hard negatives against brute force, on nulls, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from evenhand.llm import chat, negatives, repair

TALK = "conv_id bigint, turn bigint, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "")[:32], hashlib.md5((r[3] or "").encode()).hexdigest())


ODD = [
    (1, 0, "system", "be\\kind <|end|> \\<|text|>"), (1, 1, "user", "a<"), (1, 2, "assistant", "|turn|> b\n\\"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", ""),
    (None, None, None, None), (None, 5, "assistant", "é😀<<|"), (2, None, "user", "x"), (2, None, "assistant", "y"), (2, 0, "<|end|>\n", "z\n"), (3, 0, "user", "only"), (4, 0, "assistant", "first" * 50_000), (5, 7, "assistant", "\\\\"), (5, 3_000, "user", "far"), (5, 9_000, "assistant", "away"),
]


def chat_brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        said = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_chat_formatting_against_brute_force(spark):
    df = spark.createDataFrame(ODD, TALK)
    got = {r[0]: tuple(r)[1:5] for r in chat.formatted_and_read(df).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got == chat_brute(ODD + [(-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_examples_written_out(spark):
    segs, exs = chat.formatted(spark.createDataFrame(ODD, TALK).withColumnRenamed("turn", "turn"))
    full = {(r["conv_id"], r["example"]): r for r in chat.expanded(segs, exs).collect()}
    assert len(full) == exs.count() == sum(r[2] == "assistant" for r in ODD)
    places = {(r["conv_id"], r["example"]): r for r in exs.collect()}
    for at, r in full.items():
        text, p = r["context"] + r["reply"], places[at]
        assert len(r["context"]) == p["context_chars"]
        assert r["reply"][r["loss_from"] : r["loss_from"] + r["loss_chars"]] == text[p["reply_from"] : p["reply_to"]]
        assert text.count("<|end|>") == p["context_turns"] + 1
    # contexts are prefixes of one text: the next example begins with this one
    assert full[1, 2]["context"].startswith(full[1, 1]["context"] + full[1, 1]["reply"])
    assert [full[5, 1]["context"], full[5, 2]["context"].count("<|turn|>")] == ["", 2]


def test_chat_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], TALK)
    assert {r["conv_id"] for r in chat.formatted_and_read(empty).collect()} == {-1}
    more = spark.createDataFrame([(1, 0, "assistant", "t", 9, "s")], TALK + ", segment int, tie string")
    assert chat.formatted_and_read(more).count() == 2


def edits_brute(rows):
    """Cost and audit of the cheapest edits, by trying all of them state by state."""
    best, after = {0: (0, "", ()), 3: (0, "", ())}, {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(table):
        table = dict(table)
        for _ in range(4):
            for s, to in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if to in table:
                    c, a, t = table[to]
                    new = (c + 2, "I" + a, (("assistant" if to == 3 else "user") + ":",) + t)
                    table[s] = min(table.get(s, new), new)
        return table

    best = inserted(best)
    for role, text, fault in reversed(rows):
        new = {}
        for s in range(4):
            c, a, t = best[s]
            options = [(c + 3, "D" + a, t)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for r, to in after[s].items():
                    c, a, t = best[to]
                    if role[:1] == r:
                        options.append((c + more, "K" + a, (f"{role}:{text}",) + t))
                    if r != "s":
                        options.append((c + more + 2, "R" + a, (("user:" if r == "u" else "assistant:") + text,) + t))
            new[s] = min(options)
        best = inserted(new)
    return best[0]


def repair_brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            row = (conv, turn, "user" if code == 4 else role, "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text)
            kept += [] if code == 0 else [row, row] if code == 3 else [row]
        kept.sort(key=key)
        seen, marked, turns = set(), [], [r[1] for r in kept if r[1] is not None]
        for _, _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = edits_brute(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, sha("\n".join(lines)))
    return out


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Yes.", "No", "  ", "", "Why?", "é 😀!", "Stop.\n", ".", "a.b"]
    rows = ODD + [(conv, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ass"]), rng.choice(words)) for conv in range(10, 90) for t in range(rng.randrange(1, 12))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)] + [(c, 0, "user", "Hi.") for c in range(600, 800)]
    got = {r[0]: tuple(r)[1:] for r in repair.repaired_conversations(spark.createDataFrame(rows, TALK)).collect()}
    want = repair_brute(rows)
    assert got == want
    assert any(not v[6] and v[5] == 0 for v in want.values())


def test_repaired_turns_follow_the_grammar(spark):
    rows = repair.checked(spark.createDataFrame([(1, 0, "assistant", "Hm."), (1, 1, "system", "Be."), (1, 2, "user", "So?"), (1, 3, "user", "So?")], TALK))
    plan = repair.planned(rows)
    turns = [tuple(r) for r in repair.repaired(rows, plan).orderBy("place").collect()]
    assert [t[2][0] for t in turns] in (["u", "a"], ["u", "a", "u", "a"], ["s", "u", "a"])
    assert repair.repaired_conversations(spark.createDataFrame([], TALK)).count() == 0


def test_common_suffixes_are_computed_once():
    words = sorted(("".join(p) for p in itertools.product("suaUx", repeat=4)), key=lambda w: w[::-1])
    automaton = repair.Suffixes()
    for w in words:
        assert automaton.audit(w) == repair.Suffixes().audit(w)
    assert automaton.made == sum(5**i for i in range(1, 5))  # one node a suffix


def negatives_brute(rows):
    out, own = [], [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(np.float64(x) * 256)) if abs(x) < 2**40 else int(x) * 256 for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in own:
        if a[0] % 100:
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in own if b[0] != a[0])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            near = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, n + 1, x[1], max(-(2**63), min(2**63 - 1, -s)), max(-(2**63), min(2**63 - 1, -x[0]))) for n, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9, 1e18])
def test_negatives_against_brute_force(spark, size):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) * size for x in np.float32(rng.normal(0.4, 0.3, int(rng.choice([3, 70]))))], int(rng.integers(0, 3))) for i in rng.integers(0, 900, 400)]
    rows += rows[:20] + [(100, None, 1), (None, [1.0], 1), (200, [1.0, None], 1), (300, [float("nan")], 2), (400, [1.0], None), (500, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in negatives.mined(df, group=3, run=1).collect())
    assert got == negatives_brute(rows)


def test_negatives_blocks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rows = [(i, [float((i * 37) % 11), float((i * 53) % 7), 1.0], i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumnRenamed("label", "label")
    assert sorted(tuple(r) for r in negatives.mined(df, group=2, run=3).collect()) == negatives_brute(rows)
    assert negatives.mined(df.limit(0)).count() == 0
    assert negatives.mined(df.where("vec_id % 100 <> 0")).count() == 0


def test_residues_are_exact():
    rng = np.random.default_rng(1)
    for big in (1, 136, 40_000, 2**20, 2**31, 2**60):
        a, b = (rng.integers(-big, big, (n, 130), endpoint=True).astype(float) for n in (3, 5))
        m = negatives.Residues(130 * big * big)
        want = [[sum(int(x) * int(y) for x, y in zip(r, q)) for q in b] for r in a]
        assert [[int(x) for x in r] for r in m.scores(m.of(a), m.of(b))] == want
