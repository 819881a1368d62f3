"""Source audit, conversation repair and nearest neighbours against plain versions, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from tessella.llm import conversation_repair, cross_polytope, source_audit

RNG = np.random.default_rng(8)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_audit(rows, least):
    docs = [((lang or ""), (source or ""), [fold(t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        sources = {d[1] for d in own}
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    terms = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3]}" for i in range(40)] + ["Über", "naïve", "中文", "Straße", "İx"]
    rows = []
    for i in range(140):
        lang, source = [None, "en", "de", ""][i % 4], [None, "a", "b", "c", ""][i % 5 if i % 3 else 1]
        weights = np.roll(np.arange(1, len(terms) + 1), i % 5 * 7).astype(float)
        text = " ".join(RNG.choice(terms, int(RNG.integers(0, 60)), p=weights / weights.sum()))
        rows.append((lang, source, text.upper() if i % 6 == 0 else text))
    rows += [("en", "a", None), ("xx", "only", "a b c"), ("yy", "none", ""), ("yy", "other", None), ("en", "b", "Same-word,same_word;SAME word\x00x\x7fy"), ("en", "c", "wax " * 30_000)]
    return rows + rows[:20]


def test_source_audit(spark, corpus, monkeypatch):
    schema = "lang string, source string, text string, term string, n long, document int"
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in corpus], schema).repartition(5)
    want = plain_audit(corpus, 10)
    assert sorted(map(tuple, source_audit.audit(df).collect())) == want and any(r[2] == "term" for r in want)
    assert sorted(map(tuple, source_audit.audit(df, 1).collect())) == plain_audit(corpus, 1)
    # few rows held in a task: merged and handed out early
    monkeypatch.setattr(source_audit, "GATHERED", 30)
    assert sorted(map(tuple, source_audit.audit(df, 2).collect())) == plain_audit(corpus, 2)
    assert source_audit.audit(df.limit(0)).collect() == []


def test_shares_beyond_64_bits():
    n, total, kept = np.array([0, 10**12]), np.array([10**13, 10**13]), np.array([7, 7])
    assert source_audit._shares(n, total, kept).tolist() == [1 + 2 * 10**9 // (10**13 + 14), 1 + (10**12 + 2) * 10**9 // (10**13 + 14)]


def plain_repair(rows, insert=5):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, end, inserted):
        found = []
        anew, name = ("a", "assistant") if end == "u" else ("u", "user")
        if i == len(rows):
            if end in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            options = [("D", 2, end, ())]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                options.append(("R", 1 + more, anew, (f"{name}:{text}",)))
                if role[:1] in after[end] and role[:1]:
                    options.append(("K", more, after[end][role[:1]], (f"{role}:{text}",)))
            for letter, cost, to, line in options:
                c, a, lines = best(i + 1, to, 0)
                found.append((c + cost, letter + a, line + lines))
        if inserted < 3:
            c, a, lines = best(i, anew, inserted + 1)
            found.append((c + insert, "I" + a, (f"{name}:",) + lines))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    return *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, lines


CONVERSATIONS = "conv_id long, turn long, role string, text string, cost long, audit string, digest int"


def conversations(n):
    roles, texts = ["user", "assistant", "system", "tool", "", "User", "u"], ["Hi.", "No end", "", " \n", "What?", "Done!\n", "Fine. ", "中。", "x" * 3000 + "."]
    rows = []
    for c in range(n):
        size = int(RNG.integers(0, 12)) if c else 40
        for t in range(size):
            role = roles[t % 2] if RNG.random() < 0.6 else roles[int(RNG.integers(0, 7))]
            turn = None if RNG.random() < 0.05 else int(t + RNG.integers(0, 2))
            rows.append((None if c == 7 else c, turn, role, texts[int(RNG.integers(0, len(texts)))]))
    return rows + rows[:5] + [(500, 1, "user", "Same.")] * 40 + [(501, None, "system", "Only."), (502, 1, None, None), (502, 2, "user", None), (503, 3, "assistant", "Yes.")]


@pytest.mark.parametrize("insert", [5, 1])
def test_conversation_repair(spark, monkeypatch, insert):
    monkeypatch.setattr(conversation_repair, "INSERT", insert)
    rows = conversations(120)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATIONS).repartition(4)
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    want = {c: plain_repair(r, insert) for c, r in own.items()}
    got = {r["conv_id"]: r for r in conversation_repair.digests(df).collect()}
    assert set(got) == set(own) and None in got
    for c, (*counts, illegal, cost, audit, lines) in want.items():
        turns = [t for t, _, _ in own[c] if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert tuple(got[c])[1:] == (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), c
    repaired = {}
    for r in conversation_repair.repaired(df).orderBy("conv_id", "place").collect():
        repaired.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert repaired == {c: list(w[-1]) for c, w in want.items() if w[-1]}
    assert any("I" in w[-2] for w in want.values()) == (insert == 1) and conversation_repair.digests(df.limit(0)).collect() == []


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATIONS)
    want = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if fault == 4 else r, "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x)
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    damaged = conversation_repair.damaged(df)
    assert sorted(map(repr, map(tuple, damaged.collect()))) == sorted(map(repr, want))
    got = {r["conv_id"]: r for r in conversation_repair.audit_all(df, damaged.filter("conv_id <> 3")).collect()}
    assert set(got) == {r[0] for r in rows} and tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


VECTORS = "vec_id long, embedding array<float>, q long, rank int, score double, v string"


def plain_nearest(rows, k):
    sound = {(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sound:
        if i % 20 == 0:
            scores = [(sum(a * b for a, b in zip(v, w)), j) for j, w in sound if j != i]
            out.setdefault(i, []).append(sorted(scores, key=lambda s: (-round(s[0], 12), s[1]))[:k])
    return out


def vectors(n, d, scale=False):
    x = RNG.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= RNG.uniform(0.2, 3.0, (n, 1)).astype(np.float32) if scale else 1
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("scaled,blocks,codes", [(False, 4096, 65_536), (True, 4096, 65_536), (False, 60, 2)])
def test_nearest_neighbours(spark, monkeypatch, scaled, blocks, codes):
    monkeypatch.setattr(cross_polytope, "ROWS", blocks)
    monkeypatch.setattr(cross_polytope, "CODE_ROWS", codes)
    rows = vectors(600, 16, scaled)
    same = [0.25] * 16
    rows += [(1000 + i, same) for i in range(150)] + [(20, rows[20][1]), (21, rows[21][1]), (40, rows[41][1][:7]), (None, same), (60, None), (61, []), (80, [0.0] * 16), (81, [float("nan")] + [1.0] * 15), (82, [None] + [1.0] * 15), (83, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VECTORS).repartition(4)
    got = cross_polytope.search(df, "vec_id % 20 = 0").collect()
    want = plain_nearest(rows, 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == set(want)
    hits = total = 0
    for i, lists in want.items():
        if len(lists) > 1:  # an id with two vectors is two queries
            assert len(found[i]) == 40
            continue
        mine = sorted(found[i])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] != i for m in mine)
        assert all((-a[1], a[2]) < (-b[1], b[2]) for a, b in zip(mine, mine[1:]))
        scores = {j: s for s, j in plain_nearest([(i, dict(rows)[i] if i != 40 else None), *[r for r in rows if r[0] in {m[2] for m in mine}]], 20).get(i, [[]])[0]}
        assert all(m[1] == pytest.approx(scores[m[2]], abs=1e-12) for m in mine if m[2] in scores)
        hits += len({m[2] for m in mine} & {j for _, j in lists[0]})
        total += 20
    assert hits / total >= 0.9


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VECTORS)
    assert [tuple(r) for r in cross_polytope.search(df, "vec_id % 20 = 0").orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5), (0, 3, 3, -1.0)]
    assert cross_polytope.search(df.limit(0), "vec_id % 20 = 0").collect() == []
    assert cross_polytope.search(df.filter("vec_id > 0"), "vec_id % 20 = 0").collect() == []


def test_copies_and_exact_search(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100)] + [(100 + i, [0.0, 1.0, 0.0, float(i % 3)]) for i in range(20)]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VECTORS)
    got = cross_polytope.search(df, "vec_id % 20 = 0", k=5).collect()
    for i in (0, 20, 80):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == [j for j in range(7) if j != i][:5]
    assert Counter(r["query_id"] for r in got) == dict.fromkeys([0, 20, 40, 60, 80, 100], 5)
