"""Embedding near-dedup, periodic runs and conversation repair against brute force, and on nulls, empty and repeated rows, and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayfind.llm")
from wayfind.llm import repair, runs, vectors


def components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in links:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_embeddings_against_all_pairs(spark, monkeypatch):
    """Clusters, copies, scaled copies and chains in two groups, cut into many tiles."""
    monkeypatch.setattr(vectors, "TILE", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 40))
    x = np.concatenate([centres[i % 6] * 1.3 + rng.normal(size=40) * rng.choice([0.1, 0.35, 2.0]) for i in range(600)]).reshape(-1, 40).astype(np.float32)
    x[10], x[11], x[12] = x[9], x[9] * 4, x[9]
    group = [i % 2 if i % 7 else 0 for i in range(600)]
    rows = [(i, v.tolist(), g, "clash", "clash") for i, (v, g) in enumerate(zip(x, group, strict=True))]
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = (y @ y.T >= 0.93) & (np.array(group)[:, None] == np.array(group)[None, :]) & ~np.eye(600, dtype=bool)
    expected = components(600, zip(*np.nonzero(np.triu(links)), strict=True))
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 40, 0), (1003, [None] + [1.0] * 39, 0), (1004, [float("nan")] * 40, 0), (1005, [float("inf")] * 40, 0), (1006, x[0].tolist(), None), (None, x[0].tolist(), 0), (1008, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + [(*r, "clash", "clash") for r in odd], "vec_id long, embedding array<float>, label int, _g string, kept string")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd) and got[0]["_g"] == "clash"
    for i in range(600):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i].sum(), expected[i], expected[i] == i)
    for i, *_ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_embeddings_keep_large_ids_and_repeated_rows(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, [1.0, 0.0], "a"), (big + 2, [1.0, 0.01], "a"), (big + 2, [1.0, 0.01], "a"), (big + 4, [-1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect())
    assert got == [(big, 2, big), (big + 2, 2, big), (big + 2, 2, big), (big + 4, 0, big + 4)]


def all_runs(w, least, repeats):
    out = set()
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(least, repeats * p) and not any(w[s : e - q] == w[s + q : e] for q in range(1, p)):
                out.add((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(50))]
        p = rng.randrange(1, 8)
        w += [w[-p:][i % p] if len(w) >= p else 0 for i in range(rng.randrange(50))] + [rng.randrange(3) for _ in range(rng.randrange(9))]
        w *= rng.choice([1, 1, 1, 4])
        assert runs.runs_of(w, 6, 4) == all_runs(w, 6, 4) and runs.find_runs(w, 2, 2) == all_runs(w, 2, 2)


def test_runs_with_colliding_hashes(monkeypatch):
    """Every hash says yes: the words themselves decide."""
    monkeypatch.setattr(runs.Extensions, "same", lambda self, i, j, m: True)
    piece = [random.Random(2).randrange(1000) for _ in range(90)]
    for w in (piece * 5 + [1001, *piece * 3], piece * 4 + piece[:17] + [1002], [7] * 300 + [8] * 300):
        assert runs.runs_of(w, 6, 4) == all_runs(w, 6, 4)


def test_long_texts_take_no_quadratic_time():
    for w in ([1] * 300_000, [1, 2] * 150_000, [random.Random(3).randrange(500) for _ in range(30_000)] * 10):
        assert len(runs.runs_of(w, 6, 4)) == 1


def damaged_words(key, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    h, n = zlib.crc32(str(key).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_query_against_all_periods(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "one", "a a a a a a", "x y x y x y x y x y", "b\x1cb " * 9] + [" ".join(rng.choice(["la", "lo", "li", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    rows = [(2**53 + 1 + i, t) for i, t in enumerate(texts)] + [(2**53 + 2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        w = damaged_words(i, t)
        found = all_runs(w, 6, 4)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        drop = {k for s, n, q in found for k in range(s + q, s + n)}
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for k, x in enumerate(w) if k not in drop))]
        expected.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha))
    got = [tuple(r) for r in runs.op12_periodic_runs(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and sum(r[1] for r in expected) > 10


def test_runs_keep_other_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b a b a b a b", "x", 1), (2**53 + 1, None, "y", 2)], "doc_id long, text string, _raw string, runs int")
    got = {r["_raw"]: r for r in runs.collapse_runs(df).collect()}
    assert got["x"]["doc_id"] is None and got["x"]["text"] == "a b a b a b a b" and got["x"]["collapsed"] == "a b" and [tuple(r) for r in got["x"]["runs"]] == [(0, 8, 2)]
    assert got["y"]["doc_id"] == 2**53 + 1 and got["y"]["text"] is None and got["y"]["collapsed"] == "" and got["y"]["runs"] == []
    assert runs.collapse_runs(df.where("false")).count() == 0


def cheapest(rows):
    """All states by dynamic programming, the least (cost, edits) of each."""
    steps = repair.NEXT

    def filled(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                for to in {steps[s][r] for r in "ua" if r in steps[s]}:
                    best[to] = min(best.get(to, (99999, "")), (cost + 3, audit + "I"))
        return best

    best = filled({0: (0, "")})
    for x in rows:
        new = {}
        for s, (cost, audit) in best.items():
            ways = [(4, "D", s)]
            if x != "x":
                cut = 3 if x.isupper() else 0
                ways += [(cut, "K", steps[s][x.lower()])] if x.lower() in steps[s] else []
                ways += [(3 + cut, "R", steps[s][r]) for r in "ua" if r in steps[s]]
            for price, letter, to in ways:
                new[to] = min(new.get(to, (99999, "")), (cost + price, audit + letter))
        best = filled(new)
    return min(best[s] for s in (0, 3) if s in best)


def test_search_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(1500):
        rows = "".join(rng.choice("sSuUaAoOxuaua") for _ in range(rng.randrange(14)))
        assert min(repair.search(rows).values()) == cheapest(rows)
        cuts = sorted(rng.choices(range(len(rows) + 1), k=3))
        pieces = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        cost, steps = repair.chain([{s: repair.search(p, s, repair.ALL, first=False) for s in repair.ALL} for p in pieces])
        assert (cost, "".join(e for _, e in steps)) == cheapest(rows)


def test_repair_query_against_brute_force(spark, tmp_path):
    """Nulls everywhere, repeated rows and turns, odd roles, a conversation of several pieces, ids that floats cannot hold."""
    rng = random.Random(11)
    says = ["Yes.", "No", "Why?", "", None, " \n", "Well...", "The end.\t"]
    rows = [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "system", "tool", None, "assistant", "user"]), rng.choice(says) if rng.random() < 0.4 else f"Text {rng.random()}{rng.choice('.!,')}") for c in [*range(60), None, 2**53 + 1] for t in range(rng.randrange(1, 9))]
    rows += [(777, t, "user" if t % 2 else "assistant", f"Line {t}{'.' if t % 9 else ''}") for t in range(700)] + rows[:20]
    rows += [(c, t, "user", "Gone.") for c in range(5000, 5100) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    convs = {}
    for c, t, r, x in rows:
        mine = convs.setdefault(c, [])
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if way:
            x = "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x
            mine += [(t, "user" if way == 4 else r, x)] * (2 if way == 3 else 1)
    expected = {}
    for c, rs in convs.items():
        rs.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        seen, letters, faults = set(), "", dict.fromkeys(repair.FAULTS, 0)
        for _, r, x in rs:
            core, initial = x.strip(" \t\n\r\v\f"), r[0] if r[0] in "sua" else "o"
            fault = "blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else None
            if fault:
                faults[fault] += 1
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            seen.add((r, x))
        turns = [t for t, _, _ in rs if t is not None]
        cost, audit = cheapest(letters)
        lines, at, out = [], 0, ""
        for e in audit:
            role, text = {"K": lambda: rs[at][1:], "R": lambda: (None, rs[at][2]), "I": lambda: (None, ""), "D": lambda: (None, None)}[e]()
            if e != "D":
                role = role or ("assistant" if out.endswith("u") else "user")
                lines.append(f"{role}:{text}")
                out += role[0]
            at += e != "I"
        assert re.fullmatch("(s?(ua)+)?", out)
        odd = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
        expected[c] = (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    got = {r["conv_id"]: tuple(r) for r in repair.op13_conversation_repair(spark, f"file://{tmp_path}").collect()}
    assert got == expected and any(not v for v in convs.values())
    empty = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert repair.Repair(empty).summary.count() == repair.Repair(empty).digests().count() == 0


def test_repair_handles_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert repair.op13_conversation_repair(spark, f"file://{tmp_path}").where(F.lit(True)).count() == 0
