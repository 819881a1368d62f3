"""The pipeline's stages on the small tables, each held against the operator's own full result, and run() against a plain version."""

import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tessella.llm import decontaminate, near_dedup
from tessella.llm.common import common, remove, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        kept[name] = out.count()
        assert 0 < kept[name] <= n
        if name != "mixing":
            assert out.columns == columns
            docs, n = out, kept[name]
        if name == "near_dedup":
            assert near_dedup.with_classes(out).filter("NOT kept").count() == 0
        if name == "decontamination":
            assert decontaminate.contained_items(out, table(spark, SF, "benchmark")).count() == 0


def test_short_boilerplate_lines_go(spark):
    made = [(i, f"Log in\nbody {i} has words\n\nHome\nonce {i}", f"s{i % 6}") for i in range(12)] + [(50, "Home\nfew sites", "s1"), (51, "few\nbody", "s2")]
    docs = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in made], "doc_id long, text string, source string, n_chars int")
    out = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert out[0]["text"] == made[0][1]
    assert all(out[i]["text"] == f"body {i} has words\n\nonce {i}" and out[i]["n_chars"] == len(out[i]["text"]) for i in range(1, 12))
    assert out[50]["text"] == "few sites" and out[51]["text"] == "few\nbody"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    """The quality rules, on words and lines as Python sees them."""
    ws = WORD.findall(text or "")
    n, grams = len(ws), [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    repeats = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    upper, lower = (sum(a <= c <= z for c in text or "") for a, z in ("AZ", "az"))
    stutter = sum(a == b for a, b in zip(ws, ws[1:]))
    chars = sum(map(len, ws))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return not (
        n < 10 or 100 * repeats > 20 * n or 10 * symbols > 3 * n or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or chars < 2 * n or chars > 15 * n or 2 * upper > upper + lower or 100 * stutter > 30 * n
    )


def without_boilerplate(rows):
    on, keeper = {}, {}
    for r in rows:
        for x in {y.strip(" \t\n\x0b\x0c\r") for y in r["text"].split("\n")} - {""}:
            on.setdefault(x, set()).add((r["source"] is None, r["source"]))
            if r["doc_id"] is not None:
                keeper[x] = min(keeper.get(x, r["doc_id"]), r["doc_id"])
    bad = {x for x, sites in on.items() if len(sites) >= 5}
    gone = lambda r, x: r["doc_id"] is not None and x.strip() in bad and keeper[x.strip()] != r["doc_id"]
    out = [r | {"text": "\n".join(x for x in r["text"].split("\n") if not gone(r, x))} for r in rows]
    return [r | {"n_chars": len(r["text"])} for r in out]


def lcs_similarity(a, b):
    """By the whole table of common subsequences, over five-word shingles that carry their number among equal ones."""
    def labelled(text):
        ws, seen, out = WORD.findall(text), Counter(), []
        for i in range(len(ws) - 4):
            g = tuple(ws[i : i + 5])
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    x, y = labelled(a), labelled(b)
    if not x or not y or len(set(x) & set(y)) < 0.8 * max(len(x), len(y)) * 0.8:
        return 0.0
    row = [0] * (len(y) + 1)
    for g in x:
        before = row
        row = [0]
        for j, h in enumerate(y):
            row.append(before[j] + 1 if g == h else max(before[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1])


def one_of_each_class(rows):
    texts = sorted({r["text"] for r in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if root(a) != root(b) and lcs_similarity(a, b) >= 0.8:
                parent[root(a)] = root(b)
    place = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(r["text"].encode()).digest()[:16])
    best = {}
    for r in rows:
        c = root(r["text"])
        if c not in best or place(r) < place(best[c]):
            best[c] = r
    return list(best.values())


def uncontaminated(rows, items):
    def holds(text, item):
        ws, have = WORD.findall(item or ""), WORD.findall(text)
        k = min(5, len(ws))
        wanted = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if k else set()
        return wanted and len(wanted & {tuple(have[i : i + k]) for i in range(len(have) - k + 1)}) >= 0.8 * len(wanted)

    return [r for r in rows if not any(holds(r["text"], x) for x in items)]


def mixed(rows):
    size = lambda r: len(WORD.findall(r["text"]))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    held = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    target, open_, left = {}, set(sources), float(sum(held.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 3 * held[s]}
        target |= {s: 3.0 * held[s] for s in full} if full else {s: unit * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in sources:
        digest = lambda r: hashlib.md5(r["text"].encode()).hexdigest()
        key = lambda r: (hashlib.md5(f"mix-1:{'' if r['doc_id'] is None else r['doc_id']}:{digest(r)}".encode()).hexdigest(), r["doc_id"] is not None, r["doc_id"] or 0, digest(r))
        budget, at = int(target[s]), 0
        epochs = budget // held[s] if held[s] else 0
        for r in sorted((r for r in rows if r["source"] == s), key=key):
            taken = epochs * size(r) + max(0, min(size(r), budget - epochs * held[s] - at))
            at += size(r)
            if taken:
                out.append(r | {"size": size(r), "source_size": held[s], "target": target[s], "taken": taken})
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    """All five stages, with null and repeated ids, null texts and sources, equal rows, a clashing and a dotted column."""
    rng = np.random.default_rng(21)
    vocabulary = [f"{a}{b}" for a in "strand house river stone under light".split() for b in ("", "s", "ing", "ed", "er", "ly", "un", "al")]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = say(40), say(150)
    texts = [f"{say(30)}\nLog in\n{say(25)}\nshared notice of all the sites" for _ in range(30)]
    texts += [base, base, base + " more", " ".join("x" if i == 70 else w for i, w in enumerate(base.split())), f"{say(20)} {passage} {say(20)}", say(4), "", None]
    texts += ["same words " * 20, "A LOUD TEXT " * 9, "# $ % " * 20, say(900), f"{say(60)}\n{say(30)}", texts[0], texts[1]]
    sources = ["a", "b", "c", "d", "e", "", None]
    made = [{"doc_id": None if i % 17 == 5 else i - i % 19 // 18, "text": t, "source": sources[i % 7], "n_chars": len(t or ""), "size": i, "a.b": "x"} for i, t in enumerate(texts)]
    made.append(dict(made[2]))
    schema = "doc_id long, text string, source string, n_chars long, size int, `a.b` string"
    spark.createDataFrame([tuple(r.values()) for r in made], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, say(50)), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [r for r in made if good(r["text"])]
    rows = uncontaminated(one_of_each_class(without_boilerplate(rows)), [passage])
    want = mixed([{k: v for k, v in r.items() if k != "size"} | {"mine": r["size"]} for r in rows])
    got = corpus_pipeline.run(spark, str(tmp_path))
    names = ["doc_id", "text", "source", "n_chars", "size", "a.b", "_size", "source_size", "target", "taken"]
    assert got.columns == names and 15 < len(want) < len(made)
    flat = sorted((tuple(r[c] for c in ("doc_id", "text", "source", "n_chars", "mine", "a.b", "size", "source_size", "taken")) for r in want), key=repr)
    rows = got.collect()
    assert sorted((tuple(r[c] for c in names if c != "target") for r in rows), key=repr) == flat
    targets = {r["source"]: r["target"] for r in want}
    assert all(abs(r["target"] - targets[r["source"]]) < 1e-6 for r in rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_named_run_is_taken_up_again(spark, monkeypatch, tmp_path):
    ran, broken = [], [True]

    def stage(name):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if name == "four" and broken:
                raise RuntimeError("lost")
            return docs.withColumn("n_chars", docs["n_chars"] + 1) if name != "five" else docs.select("doc_id", "n_chars")

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in ("one", "two", "three", "four", "five")])
    name = tmp_path.name
    try:
        corpus_pipeline.run(spark, SF, name)
        raise AssertionError("stage four fails")
    except RuntimeError:
        assert ran == ["one", "two", "three", "four"]
    broken.clear()
    out = {r["doc_id"]: r["n_chars"] for r in corpus_pipeline.run(spark, SF, name).collect()}
    assert ran[4:] == ["four", "five"] and out == {r["doc_id"]: r["n_chars"] + 4 for r in table(spark, SF, "documents").collect()}
    assert corpus_pipeline.run(spark, SF, name).count() == len(out) and len(ran) == 6
    assert corpus_pipeline.run(spark, SF).count() == len(out) and len(ran) == 11  # without a name, from the start
    remove(spark, f"{common(spark)}/pipeline-{name}")
