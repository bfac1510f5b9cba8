"""Structure repair, chat formatting and whitening against brute force, round trips and exact fractions."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import chat_format, structure_repair, whitening

TURNS = "conv_id long, turn long, role string, text string, conv int, chunk int, n int, message int, seq int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS)


# structure repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def repairs(rows):
    """Every cheapest way to repair rows (role, text, fault), tried out letter by letter."""
    best = (10**9, "", "")

    def walk(i, cost, audit, lines):
        nonlocal best
        initials = "".join(r[:1] or "?" for r, _ in lines)  # an empty role has none and cannot stay
        if cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(best, (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)))
        else:
            role, text, fault = rows[i]
            walk(i + 1, cost + 3, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                walk(i + 1, cost + extra, audit + "K", [*lines, (role, text)])
                for r in ("user", "assistant"):
                    walk(i + 1, cost + 2 + extra, audit + "R", [*lines, (r, text)])
        for r in ("user", "assistant"):
            walk(i, cost + 2, audit + "I", [*lines, (r, "")])

    best = (3 * len(rows) + 1, "", "")
    walk(0, 0, "", [])
    return best


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damage(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, text = repairs(faulty)
        counts = [sum(f == kind for *_, f in faulty) for kind in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


@pytest.fixture(scope="module")
def talks():
    r, rows = random.Random(5), []
    says = ["Yes.", "No", "Why?", "  ", "", None, "One two. ", "three\n", "Ünder ", "ok!\t"]
    for conv in [*range(60), None]:
        for k in range(r.randrange(1, 5)):
            rows.append((conv, r.choice([k, k, k, 0, None, 7]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(says)))
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, *rows[:6], (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("chunk", [256, 2])
def test_repair_equals_brute_force(spark, talks, chunk):
    got = structure_repair.repaired(structure_repair.damaged(conversations(spark, talks)), chunk=chunk)
    assert {r["conv"]: tuple(r)[1:] for r in got.collect()} == expected(talks)


def test_repair_of_a_long_conversation(spark):
    """Thousands of turns in chunks give what one fold gives; a text of a million characters is one turn."""
    r = random.Random(9)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), f"{k % 701}{r.choice('.?a ')}") for k in range(1500)] + [(2, 3, "user", "x" * 1_000_000)]
    rows = structure_repair.damaged(conversations(spark, rows)).persist()
    one, many = (sorted(map(tuple, structure_repair.repaired(rows, chunk=c).collect())) for c in (5000, 100))
    assert one == many
    assert len(one[0][7].replace("I", "")) == rows.where("there and conv = 1").count()


def test_repair_of_nothing(spark):
    got = structure_repair.repaired(structure_repair.damaged(conversations(spark, [(1, 0, "user", "x")]).where("false")))
    assert got.columns == ["conv", *structure_repair.COUNTS, "audit", "repaired_sha256"]
    assert got.count() == 0


# chat formatting

SAYS = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "[", "<", "\\", "", None, "[[INST]]<</s>>", "a\n\nb ", "𝄞é" * 70, "/INST]", "[\\ROLE]x[TEXT][/ROLE]", "$1\\$2"]


def test_escaping_round_trip(spark):
    r = random.Random(3)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "TEXT]", "x", "]"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e")).withColumn("b", chat_format.unescaped(F.col("e"))).collect()
    for t, e, b in rows:
        assert b == t
        assert not any(mark in e for mark in chat_format.CONTROL)
        assert e == t or any(m[1:] in t for m in chat_format.CONTROL)


def test_chat_format_round_trip(spark):
    r = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "[/ROLE]", "", None]
    rows = [(c, r.choice([k, 2, None]), r.choice(roles), r.choice(SAYS)) for c in [*range(40), None] for k in range(r.randrange(1, 7))]
    rows += [rows[0], rows[1], (99, 0, "assistant", "long " * 100_000 + "</s>")]
    got = chat_format.read_back(chat_format.rendered(chat_format.messages(chat_format.event_log(conversations(spark, rows))))).collect()
    for g in got:
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == g["conv"])
        assert [(t["role"], t["text"]) for t in g["turns"]] == [x[2:] for x in own]
        assert g["learned"] == [x[3] for x in own if x[2] == "assistant"]
    assert len(got) == 42
    none = chat_format.event_log(conversations(spark, rows).where("false"))
    assert chat_format.rendered(chat_format.messages(none)).count() == 0


def test_messages_from_a_log(spark):
    """Deltas, edits and regenerations in any order of rows, interleaved between messages."""
    log = [
        (1, 1, 1, "open", "user", None), (1, 2, 1, "delta", None, "Hi"), (1, 3, 2, "open", "assistant", None), (1, 4, 2, "delta", None, "No"),
        (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "Yes"), (1, 7, 2, "delta", None, " sir"), (1, 8, 1, "edit", None, "Hello"),
        (1, 9, 1, "delta", None, "!"), (1, 10, 2, "typing", None, "x"), (2, 1, 1, "delta", None, "lost"), (2, 2, 2, "open", None, None), (2, 3, 2, "delta", None, None),
        (None, 1, 1, "open", "user", None), (3, 1, 1, "open", "user", "ignored"), (3, 1, 1, "delta", None, "b"), (3, 1, 1, "delta", None, "a"),
    ]
    random.Random(1).shuffle(log)
    got = chat_format.messages(spark.createDataFrame(log, "conv long, seq long, message int, kind string, role string, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, "user", "Hello!"), (1, 2, "assistant", "Yes sir"), (2, 1, "", "lost"), (2, 2, "", ""), (None, 1, "user", ""), (3, 1, "user", "ab")}


def test_chat_format_has_no_python(spark):
    plan = chat_format.op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, x double")


def test_whitening_against_fractions(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 5)) * [9, 1, 0.3, 2, 5] + [1000, -50000, 0, 3, 1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, [float("inf")] + [0.0] * 4), (1004, []), (1005, [1.0, 2.0])]
    got = whitening.whitened(vectors(spark, rows + odd), components=4).collect()
    whole = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(whole))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum((x[i] * n - sums[i]) * (x[j] * n - sums[j]) for x in fit), n**3) for j in range(5)] for i in range(5)]
    values, vecs = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    assert {g["n"] for g in got} == {n} and len(got) == 4 * len(rows)
    assert max(g["identity_error"] for g in got) < 1e-9
    left = {}
    for g in got:
        left.setdefault((g["id"], g["deviation"]), []).append(g)
    for (i, _), x in zip(rows, whole, strict=True):
        own = left[i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))]
        centred = np.array([float(Fraction(a * n - s, n)) for a, s in zip(x, sums, strict=True)])
        for g in own:
            k = 5 - g["component"]
            assert abs(abs(g["whitened"]) - abs(centred @ vecs[:, k] / np.sqrt(values[k]))) < 1e-9
            assert abs(g["explained"] - values[k] / values.sum()) < 1e-12


def test_scatter_is_exact(spark):
    r = np.random.default_rng(3)
    x = r.integers(-(1 << 40), 1 << 40, (5000, 3))
    fit = spark.createDataFrame([([int(c) for c in v],) for v in x], "x array<long>").repartition(7)
    got = whitening.scatter(fit, 3, 5000 << 80)
    full = np.hstack([np.ones((5000, 1), object), x.astype(object)])
    assert (got == full.T.dot(full)).all()


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])]).where("false")).count() == 0
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(g["component"], g["n"], g["deviation"], g["whitened"], g["explained"], g["identity_error"]) for g in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    flat = whitening.whitened(vectors(spark, [(k, [float(k), float(k)]) for k in range(9)])).collect()
    assert {(g["component"], g["whitened"] is None) for g in flat} == {(1, False), (2, True)}
    huge = whitening.whitened(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {g["deviation"] for g in huge} == {None} or all(g["deviation"] is None or g["deviation"] >= 0 for g in huge)
    assert max(g["identity_error"] for g in huge) < 1e-4
