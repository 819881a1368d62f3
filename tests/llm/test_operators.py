"""Each corpus operator against a plain version on small tables with nulls, empty texts, repeats and clashing columns."""

import re
from collections import Counter
from fnmatch import fnmatchcase

import numpy as np
import pytest

from tessella.llm import common, decontaminate, hmm_score, html_extract, license_scan, line_dedup, mixing, near_dedup, quality_rules, token_counts, url_filters
from tessella.llm import arrow_words as aw

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


BASE = prose(120, 1)
EDITED = " ".join("changed" if i == 60 else w for i, w in enumerate(BASE.split()))
#: Clashing names: columns that operators add themselves.
SCHEMA = "doc_id long, text string, source string, n_chars long, kept boolean, class_id long, size long, taken long"
TEXTS = [
    (1, BASE, "a"), (2, BASE, "b"), (3, EDITED, "c"), (4, prose(90, 2), "a"), (5, None, None), (6, "", "a"), (7, "one two", "b"), (8, "one two", "b"),
    (9, "same line of words\nown text here now\nsame line of words", "d"), (10, "same line of words\n\tother", "e"), (11, prose(5000, 3), "a"),
    (None, prose(40, 4), "b"), (12, "a b a b a b a b a b a b", "c"), (12, "a b a b a b a b a b a b", "c"), (13, "# $ % ABC é中　x <|endoftext|> a  b ", "a"), (14, "HELLO hello", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, len(t or ""), True, 7, 7, 7) for i, t, s in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def measured(text):
    ws = WORD.findall(text or "")
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(docs, empty):
    got = rows(quality_rules.ledger(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *measured(t)) for i, t, _ in TEXTS), key=repr)
    judged = quality_rules.judged(quality_rules.ledger(docs))
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in judged.collect())
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged.filter("kept").collect()}
    ablation = {r["rule"]: r["n_failed"] for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    assert ablation["few_words"] == sum(measured(t)[0] < 10 for _, t, _ in TEXTS)
    assert quality_rules.judged(quality_rules.ledger(empty)).count() == 0


def shingles(text):
    ws = WORD.findall(text or "")
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def test_decontamination(spark, docs, empty):
    inside = " ".join(prose(5000, 3).split()[1000:1030])
    items = spark.createDataFrame([(1, inside), (2, prose(30, 99)), (3, "one two"), (4, None), (5, ""), (6, BASE)], "item_id long, text string")
    want = set()
    for r in items.collect():
        wanted = shingles(r["text"])
        for i, t, _ in TEXTS:
            ws = WORD.findall(t or "")
            k = min(5, len(WORD.findall(r["text"] or "")))
            have = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
            if wanted and len(wanted & have) >= 0.8 * len(wanted):
                want.add((i, r["item_id"]))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()} == want
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == sorted(i or 0 for i, _, _ in TEXTS if i not in {d for d, _ in want})
    assert decontaminate.contained_items(empty, items).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(TEXTS)


def test_decontamination_of_rows_that_share_an_id(spark):
    leak = prose(30, 50)
    docs = spark.createDataFrame(
        [(None, f"{prose(60, 51)} {leak} {prose(60, 52)}"), (None, prose(90, 53)), (7, f"{leak} more"), (7, prose(40, 54)), (7, f"{leak} more"), (8, None), (9, prose(40, 55))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(None, leak), (None, prose(400, 56)), (1, prose(40, 54)), (1, prose(300, 57)), (1, prose(40, 54))], "item_id long, text string")
    found = rows(decontaminate.contained_items(docs, items), "doc_id", "item_id", "containment")
    assert found == sorted([(None, None, 1.0), (7, None, 1.0), (7, 1, 1.0)], key=repr)
    assert rows(decontaminate.drop_contaminated(docs, items), "doc_id") == sorted([(None,), (8,), (9,)], key=repr)


def test_line_dedup(spark, docs, empty):
    made = spark.createDataFrame([(i, f"Shared footer line here \nbody {i} has words\nok", f"s{i % 7}") for i in range(20)] + [(None, "Shared footer line here", "s1"), (99, None, "s2")], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(made, counts=True).collect()}
    assert out[0]["text"].startswith("Shared footer") and out[5]["text"] == "body 5 has words" and out[5]["n_removed"] == 2
    assert out[None]["text"] == "Shared footer line here" and out[99]["text"] is None and len(out) == 22
    longer = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(made, min_words=3).collect()}
    assert longer[5] == "body 5 has words\nok"
    same = line_dedup.remove_boilerplate(docs)
    assert same.columns == docs.columns and rows(same, "doc_id", "text") == sorted(((i, t) for i, t, _ in TEXTS), key=repr)
    assert line_dedup.remove_boilerplate(empty).count() == 0


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_ROWS, 0])
def test_line_dedup_against_a_plain_version(spark, monkeypatch, bound):
    """Null and empty sites, null and repeated ids, repeated rows, lines around the threshold, a line everywhere, a dotted column."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(11)
    sites = [None, "", "=", *(f"s{i}" for i in range(6))]
    made = []
    for i in range(300):
        lines = [f"line {rng.zipf(1.4) % 60}" for _ in range(rng.integers(0, 9))] + ["everywhere"]
        made.append((None if i % 41 == 0 else int(i // 1.1), "\n".join(lines) if i % 50 else None, sites[rng.integers(len(sites))]))
    made += made[5:9]
    on, keeper = {}, {}
    for i, t, s in made:
        for x in {y.strip() for y in (t or "").split("\n") if y.strip()}:
            on.setdefault(x, set()).add((s is None, s))
            if i is not None:
                keeper[x] = min(keeper.get(x, i), i)
    gone = lambda i, x: i is not None and len(on.get(x.strip(), ())) >= 5 and keeper[x.strip()] != i
    want = [(i, t and "\n".join(x for x in t.split("\n") if not gone(i, x)), s) for i, t, s in made]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in made], "doc_id long, text string, source string, `a.b` string").repartition(4)
    got = line_dedup.remove_boilerplate(df, counts=True)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r["n_removed"] for r in got.collect()) == sum(gone(i, x) for i, t, _ in made for x in (t or "").split("\n"))


def test_near_dedup(spark, docs, empty):
    got = near_dedup.with_classes(docs)
    names = got.columns[len(docs.columns) :]
    found = {r["doc_id"]: (r[names[0]], r[names[-1]]) for r in got.collect()}
    assert found[1] == (1, True) and found[2] == (1, False) and found[3] == (1, False)
    assert found[8] == (7, False) and found[4] == (4, True) and found[5] == (5, True) and found[None][1]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]
    assert near_dedup.with_classes(empty).count() == 0


def test_near_dedup_of_rows_that_share_an_id(spark):
    """An id with several texts, null ids, ids that are strings, equal rows, and a column with a dot."""
    a, b, c = prose(80, 60), prose(80, 61), prose(80, 62)
    near = b + " more"
    made = [("5", a, 0), ("5", b, 1), ("9", near, 2), (None, c, 3), (None, c + " more", 4), (None, a, 5), ("7", c, 6), ("7", c, 7), ("8", None, 8), (None, "", 9), ("8", None, 10)]
    df = spark.createDataFrame(made, "doc_id string, text string, `n.x` int")
    got = {r["n.x"]: (r["class_id"], r["kept"]) for r in near_dedup.with_classes(df).collect()}
    assert got[0] == ("5", True) and got[5] == ("5", False)
    assert got[1] == ("5", True) and got[2] == ("5", False)
    assert got[3] == ("7", False) and got[4] == ("7", False) and got[6] == got[7] == ("7", True)
    assert got[8] == got[10] == ("8", True) and got[9] == (None, True)
    kept = sorted(r["n.x"] for r in near_dedup.keep_one(df).collect())
    assert kept in ([0, 1, 6, 8, 9, 10], [0, 1, 7, 8, 9, 10])


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3])
def test_near_dedup_finds_what_brute_force_finds(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    made = []
    for g in range(12):
        base = prose(100, 100 + g).split()
        for k in range(12):
            ws = list(base)
            for p in np.random.default_rng(g * 50 + k).choice(100, k % 5, replace=False):
                ws[p] = f"x{g}{k}{p}"
            made.append((len(made), " ".join(ws)))
    sets = {}
    for i, t in made:
        h = aw.hashes(__import__("pyarrow").array(t.split()))
        sets[i] = aw.labelled(aw.shingle_hashes(h))
    parent = list(range(len(made)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            if near_dedup.aligned(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in range(len(made))}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(want[i] == want[got[i]] for i in got)  # never two classes in one


def test_alignment_is_the_longest_common_subsequence():
    a = np.array([5, 1, 2, 3, 4, 9, 8, 7], dtype=np.uint64)
    b = np.array([1, 2, 5, 3, 4, 9, 8, 7], dtype=np.uint64)
    assert near_dedup.aligned(a, b, 0.5) == 7 / 9
    assert near_dedup.aligned(a, np.empty(0, dtype=np.uint64)) == 0.0


def test_hmm_likelihood_is_exact():
    rng = np.random.default_rng(1)
    S, C = hmm_score.STATES, hmm_score.CLASSES
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = (norm(rng.random(S), 0), norm(rng.random((S, S)), 1), norm(rng.random((C, S)), 0))
    obs = rng.integers(0, C, 9)
    value = model[0] * model[2][obs[0]]
    for o in obs[1:]:
        value = (value @ model[1]) * model[2][o]
    got = hmm_score.forward(obs, np.array([0]), np.array([9]), model)
    assert got[0] == pytest.approx(np.log10(value.sum()))


def test_lm_scores(docs, empty):
    import zlib

    def tokens(t):
        return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")] + [""]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in TEXTS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = hmm_score.score(docs, rounds=2)
    want = sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) for i, t, _ in TEXTS), key=repr)
    assert rows(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == want
    base = {i: sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)) for i, t, _ in TEXTS}
    assert all(r["base_score"] == pytest.approx(base[r["doc_id"]]) and r["score"] < 0 for r in got.collect())
    assert hmm_score.score(empty, rounds=1).count() == 0


def test_hmm_states_emit_words_and_texts_are_whole(spark, monkeypatch):
    """Score after training against a plain Baum-Welch over whole texts; most words are not among the broadcast ones."""
    monkeypatch.setattr(hmm_score, "FREQUENT", 40)
    S = hmm_score.STATES
    made = [(i, prose(20 + 300 * (i % 3), 700 + i)) for i in range(14)] + [(50, f"{prose(30, 800)} unheard of"), (51, None)]
    seqs = {i: [*(t or "").split(), ""] for i, t in made}
    train = {i: s for i, s in seqs.items() if not __import__("zlib").crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for s in train.values() for w in s)
    assert 0 < len(train) < len(seqs) and len(c) > 200
    words, n = list(c), np.array([float(x) for x in c.values()])
    E = dict(zip(words, hmm_score.first_counts(__import__("pyarrow").array(words), n)))
    start, step = np.full(S, 1 / S), np.where(np.eye(S) > 0, 0.95, 0.05 / (S - 1))

    def emit(w):
        return (E.get(w, np.zeros(S)) + 1 / S) / (sum(E.values()) + (len(c) + 1) / S)

    def alphas(seq):
        out, log, value = [], 0.0, start
        for t, w in enumerate(seq):
            value = (value @ step if t else value) * table.get(w, other)
            log += np.log10(value.sum())
            value = value / value.sum()
            out.append(value)
        return out, log

    for _ in range(3):
        table, other = {w: emit(w) for w in c}, emit("not there")
        new, s0, s1 = {w: np.zeros(S) for w in c}, np.zeros(S), np.zeros((S, S))
        for seq in train.values():
            a, _ = alphas(seq)
            beta = np.ones(S)
            for t in range(len(seq) - 1, -1, -1):
                if t < len(seq) - 1:
                    ahead = table[seq[t + 1]] * beta
                    pair = a[t][:, None] * step * ahead[None]
                    s1 += pair / pair.sum()
                    beta = step @ ahead
                    beta /= beta.sum()
                post = a[t] * beta
                new[seq[t]] += post / post.sum()
            s0 += post / post.sum()
        E, start, step = new, (s0 + 1e-3) / (s0 + 1e-3).sum(), (s1 + 1e-3) / (s1 + 1e-3).sum(axis=1, keepdims=True)
    table, other = {w: emit(w) for w in c}, emit("not there")
    got = {r["doc_id"]: r["score"] for r in hmm_score.score(spark.createDataFrame(made, "doc_id long, text string"), rounds=3).collect()}
    assert all(got[i] == pytest.approx(alphas(seq)[1], rel=1e-9) for i, seq in seqs.items())


def test_hmm_counts_of_a_long_text_do_not_depend_on_segments(monkeypatch):
    """Counts of start, step and emission against a plain forward-backward, whatever the segments and blocks that texts are cut into."""
    rng = np.random.default_rng(3)
    S, V = hmm_score.STATES, 50
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = (norm(rng.random(S), 0), norm(rng.random((S, S)), 1), norm(rng.random((V, S)), 0))
    lengths = np.array([1000, 1, 64, 65, 128, 300])
    starts = np.cumsum(lengths) - lengths
    obs = rng.integers(0, V, lengths.sum())
    want, likelihood = (np.zeros(S), np.zeros((S, S)), np.zeros((V, S))), []
    for a, n in zip(starts, lengths):
        seq, value, alphas, log = obs[a : a + n], model[0], [], 0.0
        for t, w in enumerate(seq):
            value = (value @ model[1] if t else value) * model[2][w]
            log += np.log10(value.sum())
            value = value / value.sum()
            alphas.append(value)
        likelihood.append(log)
        beta = np.ones(S)
        for t in range(n - 1, -1, -1):
            if t < n - 1:
                ahead = model[2][seq[t + 1]] * beta
                pair = alphas[t][:, None] * model[1] * ahead[None]
                want[1][:] += pair / pair.sum()
                beta = model[1] @ ahead
                beta /= beta.sum()
            post = alphas[t] * beta / (alphas[t] * beta).sum()
            want[2][seq[t]] += post
        want[0][:] += post
    for segment, block in ((10**6, 10**6), (64, 10**6), (64, 100), (1, 50)):
        monkeypatch.setattr(hmm_score, "SEGMENT", segment)
        monkeypatch.setattr(hmm_score, "BLOCK_TOKENS", block)
        into = (np.zeros(S), np.zeros((S, S)), np.zeros((V, S)))
        assert hmm_score.expected(obs, starts, lengths, model, into) == pytest.approx(sum(likelihood))
        assert hmm_score.forward(obs, starts, lengths, model) == pytest.approx(likelihood)
        assert all(np.allclose(a, b) for a, b in zip(into, want))


def test_hmm_rounds_move_no_chunks(spark, monkeypatch):
    """A round shuffles counts alone, one row for a group and range: the chunks are read by group from their buckets."""
    monkeypatch.setattr(hmm_score, "FREQUENT", 40)
    docs = spark.createDataFrame([(i, prose(40, i)) for i in range(60)], "doc_id long, text string").repartition(6)
    with common.Tables(spark, "lm") as tables:
        model = hmm_score.Model(docs, tables)
        model.round()
        groups = {r["grp"] for r in model.chunks.select("grp").collect()}
        assert 1 < len(groups) < model.chunks.count()
        kept = model.counts.filter("grp IS NOT NULL")
        assert 0 < kept.count() == kept.select("grp", "part").distinct().count() <= len(groups) * model.ranges
        plan = model.by_group(lambda chunks, found: chunks.select(["grp"]), "grp long")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_hmm_groups_are_stored_in_small_parts(spark, monkeypatch):
    """What Spark holds at once of a group's table does not grow with the group: row groups hold few rows, without a codec's copies."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(hmm_score, "CHUNK", 20_000)
    monkeypatch.setitem(hmm_score.LARGE, "parquet.block.size", 30_000)
    docs = spark.createDataFrame([(i, prose(400, i)) for i in range(200)], "doc_id long, text string").coalesce(1)
    with common.Tables(spark, "lm") as tables:
        model = hmm_score.Model(docs, tables)
        metas = [pq.read_metadata(name.removeprefix("file:")) for name in model.chunks.inputFiles()]
        sizes = [m.row_group(i).total_byte_size for m in metas for i in range(m.num_row_groups)]
        assert sum(m.num_rows for m in metas) == model.chunks.count() > 3 * len(metas)
        assert len(sizes) >= 2 * len(metas) and sorted(sizes)[len(sizes) // 2] <= 60_000
        assert {m.row_group(0).column(i).compression for m in metas for i in range(m.num_columns)} == {"UNCOMPRESSED"}


def test_hmm_scores_do_not_depend_on_blocks(spark, monkeypatch):
    """The recursion takes a group's chunks together, up to BLOCK_TOKENS tokens; what it takes changes no score and loses no text."""
    import pyarrow.compute as pc

    monkeypatch.setattr(hmm_score, "CHUNK", 2_000)
    docs = spark.createDataFrame([(i, prose(30 + i, i)) for i in range(240)] + [(900, None)], "doc_id long, text string").coalesce(2)
    with common.Tables(spark, "lm") as tables:
        model = hmm_score.Model(docs, tables)
        rows = model.chunks.toArrow()
        first = rows.filter(pc.equal(rows.column("grp"), rows.column("grp")[0]))
    found = __import__("pyarrow").table({"part": [], "x": []})
    got, taken = {}, {}
    for size in (1, 2_000, 10**6):
        monkeypatch.setattr(hmm_score, "BLOCK_TOKENS", size)
        group = hmm_score.Group(first, found, model.model())
        blocks = [b for kind in (False, True) for b in group.blocks(kind)]
        taken[size] = [len(b.codes) for b in blocks]
        scores = [zip(b.doc_ids.to_pylist(), hmm_score.forward(b.codes, b.starts, b.lengths, (model.start, model.step, b.emit))) for b in blocks]
        got[size] = dict(x for each in scores for x in each)
    assert len(taken[1]) == first.num_rows > len(taken[2_000]) > len(taken[10**6]) > 0
    assert max(taken[2_000]) <= 2_000 and len({sum(x) for x in taken.values()}) == 1
    assert len(got[1]) == pc.sum(pc.list_value_length(first.column("doc_ids"))).as_py() and got[1].keys() == got[2_000].keys() == got[10**6].keys()
    assert all(got[1][i] == pytest.approx(got[k][i], rel=1e-9) for k in got for i in got[1])


def test_hmm_tokens_of_one_hash_keep_apart(spark, monkeypatch):
    """Numbers and counts of tokens stay exact where hashes collide, and whatever the chunks."""
    monkeypatch.setattr(aw, "hashes", lambda x: np.array([len(w) for w in x.to_pylist()], dtype=np.uint64))
    monkeypatch.setattr(hmm_score, "CHUNK", 40)
    made = [(i, " ".join(prose(12, i).split())) for i in range(30)]
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in made if not held(i) for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in hmm_score.score(spark.createDataFrame(made, "doc_id long, text string"), rounds=1).collect()}
    for i, t in made:
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*t.split(), ""]))


def test_token_counts(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False)), len(t.encode(x or "", add_special_tokens=False)) > 1024) for i, x, _ in TEXTS]
    assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, path).count() == 0
    long = [(i, "".join(np.random.default_rng(i).choice(list("abc\u4e2d\u6587"), 3000)) + " end" * (i % 2), f"s{i}") for i in range(4)] * 2  # texts without spaces
    want = sorted((i, len(t.encode(x, add_special_tokens=False))) for i, x, _ in long)
    assert rows(token_counts.count_tokens(spark.createDataFrame(long, "doc_id long, text string, n_tokens string"), path), "doc_id", "n_tokens") == want
    assert all(len(p.encode()) <= token_counts.SHORT for p in token_counts.frequent_pieces(docs, path))


def test_license_scan(spark, docs, empty):
    text = license_scan.TEMPLATES[3][1].replace("free of charge", "at no charge")
    made = spark.createDataFrame([(1, f"{BASE} {text} {BASE}"), (2, BASE), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(made).collect()}
    assert got[1]["license"] == "MIT" and got[1]["coverage"] > 0.9 and got[1]["matches"][0]["first_word"] == 120
    assert all(got[i]["license"] is None and got[i]["n_matches"] == 0 for i in (2, 3, 4))
    assert license_scan.scan(docs).count() == len(TEXTS) and license_scan.scan(empty).count() == 0
    assert license_scan.patience(list("abcd"), list("xabyd")) == [(0, 1), (1, 2), (3, 4)]


def test_licenses_are_told_apart(spark):
    L = license_scan
    bsd2, bsd3 = L._BSD + L._BSD_END, L._BSD + L._BSD_THIRD.replace("*", "") + L._BSD_END
    work = "This work is licensed under the GNU {} Public License, version {}."
    near = [
        ("Released under the BSD License.", None), ("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 3.0.", None),
        (work.format("General", 2), "GPL-2.0"), (work.format("General", 3), "GPL-3.0"), (work.format("Lesser General", 3), "LGPL-3.0"),
        (work.format("Affero General", 3), "AGPL-3.0"), (work.format("Library General", 3), None),
        ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", None),
        (bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"), (L.TEMPLATES[3][1], "MIT"), (L.TEMPLATES[4][1], "MIT"), (L._BSD, None),
        (L._whole("GPL-3"), "GPL-3.0"), (L._whole("GPL-2"), "GPL-2.0"), (L._whole("LGPL-2.1"), "LGPL-2.1"), (L._whole("LGPL-3"), "LGPL-3.0"),
        (L._whole("Apache-2.0"), "Apache-2.0"), (L._whole("MPL-2.0"), "MPL-2.0"),
    ]
    made = [(i, f"{prose(40, i)} {t} {prose(40, i + 1)}") for i, (t, _) in enumerate(near)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(near)] == near


def test_licenses_against_every_stretch(spark):
    """Wordings with words left out, down to just above and below the least coverage, among all stretches of a text."""
    known, rng = license_scan.Templates(), np.random.default_rng(8)
    made, want = [], {}
    for t in [i for i, ws in enumerate(known.words) if 20 < len(ws) < 400][:14]:
        for share in (0.17, 0.19, 0.21, 0.23):
            ws = list(known.words[t])
            once = [j for j, w in enumerate(ws) if j not in known.musts[t] and ws.count(w) == 1]  # words that the template has once
            rest = [j for j in range(len(ws)) if j not in known.musts[t] and j not in once]
            out = set([*rng.permutation(once), *rng.permutation(rest)][: int(share * len(ws))])
            text = f"{prose(9, t)} {' '.join(w for j, w in enumerate(ws) if j not in out)} {prose(9, t + 1)}"
            words = np.array([known.vocabulary.get(license_scan.plain(w), -1) for w in text.split()])
            width = max(int(license_scan.WIDTH * len(ws)), len(ws) + 2)
            best = max(len(license_scan.patience(words[i : i + width].tolist(), known.coded[t])) for i in range(len(words))) / len(ws)
            want[len(made)] = (t, best)
            made.append((len(made), text))
    assert sum(c >= 0.8 for _, c in want.values()) > 10 and sum(c < 0.8 for _, c in want.values()) > 10
    got = {r["doc_id"]: r["matches"] for r in license_scan.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, (t, best) in want.items():
        found = [m["coverage"] for m in got[i] if m["license"] == known.names[t]]
        assert max(found, default=0) >= best if best >= 0.8 else all(c >= 0.8 for c in found), (known.names[t], best)


def test_wildcard_automaton():
    patterns = ["a*b", "*ab*", "a?c", "*", "abc", "*a*b*c", "", "?*", "x" * 70 + "*", "*.com#/*.exe"]
    letters = np.array(list("abcx.#/"))
    strings = ["", "abc", "x" * 75, "w.com#/q.exe", *("".join(np.random.default_rng(i).choice(letters, i % 9)) for i in range(300))]
    data = np.frombuffer("".join(strings).encode(), dtype=np.uint8)
    lengths = np.array([len(s) for s in strings])
    got = url_filters.Automaton(patterns).match(data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [[fnmatchcase(s, p) for p in patterns] for s in strings]


def test_url_filters(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "http://a.com", "http://a.net/es/1", "http://casino.org/x", "http://ok.org/x", None, "nothing", "http://net/fr/", "ftp://a.b/x.exe#y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("a.com", "", None, "allow") and got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "block") and got[5][3] == "allow"
    assert got[6] == ("", "", None, "allow") == got[7] and got[8][2] == "net/fr/" and got[9][3] == "block"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_patterns_from_a_table(spark, monkeypatch):
    """Repeated rows, a clashing column, a very long URL, blocks of a few URLs, and a bound on the table."""
    monkeypatch.setattr(url_filters, "STATE", 8)
    urls = ["http://a.org/x", "http://bad.org/y", "http://a.org/" + "z" * 20_000 + ".exe", None, "http://bad.org/y"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)] + [(1, urls[1], "host")], "page_id long, url string, host string")
    patterns = [x[0] for x in url_filters.listed(spark.createDataFrame([("bad.*#*",), ("*#*.exe",), ("*#*.exe",)], "pattern string"))]
    got = sorted((r["page_id"], r["verdict"]) for r in url_filters.judge(pages, blocked=patterns).collect())
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block")]
    monkeypatch.setattr(url_filters, "MOST", 1)
    with pytest.raises(ValueError):
        url_filters.listed(spark.createDataFrame([("a",), ("b",)], "pattern string"))


def test_mixing(spark, docs, empty):
    made = spark.createDataFrame([(i, prose(10 + i % 5, i), "abc"[min(2, i % 4)]) for i in range(400)] + [(900, None, None), (901, "x y", None), (901, "x y", None)], "doc_id long, text string, source string")
    got = mixing.mix(made).collect()
    assert len(got) == 403 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source"], r["target"], r["source_size"]), []).append(r)
    assert abs(sum(t for _, t, _ in by) - sum(n for _, _, n in by)) < 1e-6
    for (_, target, size), part in by.items():
        assert abs(sum(r["taken"] for r in part) - target) <= 1 and sum(r["size"] for r in part) == size
    again = mixing.mix(made.repartition(5))
    assert rows(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(empty).count() == 0 and mixing.mixture(docs).count() > 0


def test_mixture_takes_exact_budgets(spark, monkeypatch):
    """Equal rows share what is left of the budget; the rows of mixture() are those of mix()."""
    monkeypatch.setattr(mixing, "COPIES", 3)
    text = prose(100, 1)
    made = [(1, text, "a", "x")] * 8 + [(2, prose(50, 2), "a", "y"), (None, text, "b", "z"), (None, text, "b", "z"), (3, None, None, ""), (4, prose(700, 3), None, ""), (5, prose(30, 4), "b", "")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, copy string").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(made) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    budget = {}
    for r in got:
        budget[r["source"]] = budget.get(r["source"], 0) + r["taken"]
        assert r["source_size"] == sum(len((t or "").split()) for _, t, s, _ in made if s == r["source"])
    assert all(budget[r["source"]] == int(r["target"]) for r in got)
    out = mixing.mixture(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken"]
    assert rows(out, "doc_id", "source", "taken") == sorted(((r["doc_id"], r["source"], r["taken"]) for r in got if r["taken"]), key=repr)
    # targets by hand: weights a 5, b 2, none 1; what sources cannot take thrice is shared anew
    sizes, weight, left = {"a": 850, "b": 230, None: 700}, {"a": 5, "b": 2, None: 1}, 1780.0
    target, open_ = {}, set(sizes)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 3 * sizes[s]}
        for s in full or open_:
            target[s] = min(unit * weight[s], 3.0 * sizes[s])
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mix(df)


def test_html_extraction(spark):
    long = "The cat is on the mat and it was there for a long time with all of the others. " * 4
    page = f"""<html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="ad">Buy now</div><article><h1>Caf&eacute; &amp; co</h1><p>{long}</p><p>{long}&nbsp;end</p></article>
    <div id="comments"><p>{long}</p></div><footer>All rights</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut <b")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    body = " ".join(long.split())
    assert got[1]["text"] == f"Café & co {body} {body} end" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" == got[3]["text"] and len(got) == 4
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_page_of_short_paragraphs():
    lines = [f"The {w} is on the mat and it was there for a long time with all of the others that they have." for w in ("cat", "dog", "hen")]
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Section number {i} of the site</a></li>" for i in range(5)) + "</ul>"
    assert all(len(x) <= 200 for x in lines)
    assert html_extract.main_text(f"<body>{menu}{''.join(f'<p>{x}</p>' for x in lines)}{menu}</body>") == " ".join(lines)
    assert html_extract.main_text(f"<body>{menu}<p>Tiny</p>{menu}</body>") == ""


SENTENCE = "The {} of the house was in that place and it is with them as you were"


def made_page(seed, stated):
    """A page of blocks of known kind, and the text of those that are content."""
    rng = np.random.default_rng(seed)
    say = lambda n: " ".join(SENTENCE.format(f"w{rng.integers(10**6)}") for _ in range(n)) + "."
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i}" for i in range(4)) + "</ul>"
    noise = [
        menu, lambda: f"<div class='ad box'>{say(3)}</div>", lambda: f"<aside><p>{say(4)}</aside>", lambda: f"<form>{say(2)}<input></form>",
        lambda: "<script>if (a < b) { t = '<p>" + say(3) + "</p>' }</script>", lambda: f"<div id=comments><p>{say(4)}<p>{say(4)}</div>", lambda: f"<!-- {say(3)} -->",
    ]
    body, want = [f"<h1>Title {seed}</h1><p>{(first := say(5))}</p>"], [f"Title {seed}", first]
    for _ in range(rng.integers(3, 9)):
        kind, text = rng.integers(4), say(int(rng.integers(4, 7)))
        if rng.random() < 0.4 and (kind or stated):  # without an article, a short block beside a menu is not content
            body.append(noise[rng.integers(len(noise))]())
        if kind == 0:
            text = "Short one."
            body += [f"<p>{text}", f"<p>{(more := say(5))}"]
            want += [text, more]
        else:
            body.append([f"<p>{text}</p>", f"<div><b>{text}</b></div>", f"<p>{text}"][kind - 1])
            want.append(text)
    inner = "\n".join(body)
    page = f"<html><head><title>t{menu()}</title><body><nav>{menu()}</nav>" + (f"<article>{inner}</article>" if stated else f"<div>{inner}</div>")
    return page + f"<footer>{say(3)}</footer>", " ".join(want)


@pytest.mark.parametrize("stated", [True, False])
def test_html_pages_of_known_blocks(spark, stated):
    made = [(i, "same url", *made_page(i, stated)) for i in range(60)]
    made += made[:3]  # repeated rows
    df = spark.createDataFrame(made, "page_id long, url string, html string, text string").withColumnRenamed("text", "n_chars")
    want = sorted((i, t) for i, _, _, t in made)
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract(df).collect()) == want


def test_html_signs_decide(monkeypatch):
    pages = [made_page(i, False) for i in range(20)]
    monkeypatch.setattr(html_extract, "_second_pass", lambda found: None)
    assert any(html_extract.main_text(p) != t for p, t in pages)
    monkeypatch.undo()
    plain = "<p>" + "Shoes boots jackets trousers, red green blue; size small, medium, large; kilo price 20, 30, 40, new offers daily. " * 3
    mixed = f"<div>{plain}</div>" + "".join(f"<p>{SENTENCE.format(i)} {SENTENCE.format(i)} {SENTENCE.format(i)} {SENTENCE.format(i)}.</p>" for i in range(3))
    assert "boots" not in html_extract.main_text(mixed)
    monkeypatch.setattr(html_extract, "STOP", frozenset())
    assert "boots" in html_extract.main_text(mixed)


def test_html_as_it_comes():
    long = "The cat is on the mat and it was there for a long time with all of the others that came to be here."
    text = html_extract.main_text
    assert text(f"<html><head><title>t</title><body><p>{long}") == long  # no end tags
    assert text(f'<article><p class="share">Share<h2>Head</h2><div>{long}</div></article>') == f"Head {long}"
    assert text(f"<article><ul><li class=share>Share</ul><p>{long}</article>") == long
    assert text(f'<article><p>{long}</p><div class="ad">x</article><div class="box">{long}</div>') == long  # an advert left open
    assert text(f'<body class="comments-enabled"><article class="post-social-share"><div class="article-header"><h1>Kept</h1></div><p>{long}</article>') == f"Kept {long}"
    for other in ("\u4e2d\u6587\u6587\u672c\u5185\u5bb9\u5f88\u957f\u3002" * 30, "\u0420\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442 \u0434\u043b\u0438\u043d\u043d\u044b\u0439. " * 20):
        assert text(f"<ul><li><a href=/>Home</a></ul><p>{other}</p>") == other.strip()
    assert text(f"<p>{long} \xa9 is a sign. {long} {long}</p>") == f"{long} \xa9 is a sign. {long} {long}"
    assert text(f"<p>{long} <a href=\"x title='y>link</a> {long} {long}") == f"{long} link {long} {long}"  # quotes that are not closed
    assert text(f"<table><tr><td>{long}<td>{long}<tr><td>{long}</table>") == f"{long} {long} {long}"
    assert text(f"<p>{long}</p><!-- {long}") == long == text(f"<p>{long}</p><script> {long}") and text("<p>cut <b") == "cut"


def test_license_scan_of_shuffled_texts_is_fast(spark):
    import time

    known = license_scan.Templates()
    t = max(range(len(known.names)), key=lambda i: len(known.coded[i]) if known.names[i] == "GPL-3.0" else 0)
    words, rng = np.array(known.coded[t]), np.random.default_rng(1)
    began = time.process_time()
    for n in (3000, 6000, 9000):
        assert known.matches(rng.permutation(np.tile(words, 3))[:n], t) == []
    assert time.process_time() - began < 3
    assert known.matches(np.concatenate([rng.permutation(words), words]), t)
    tagged = [(1, "// SPDX-License-Identifier: MIT"), (2, "# SPDX-License-Identifier: GPL-3.0-or-later\n"), (3, "SPDX-License-Identifier: CC0-1.0"), (4, "SPDX-License-Identifier: Other"), (5, "MIT"), (1, "// SPDX-License-Identifier: MIT")]
    got = license_scan.scan(spark.createDataFrame(tagged, "doc_id long, text string"))
    assert rows(got, "doc_id", "license") == [(1, "MIT"), (1, "MIT"), (2, "GPL-3.0"), (3, "CC0-1.0"), (4, None), (5, None)]


WRAPPERS = [
    "content-sidebar-wrap", "main-navigation-wrapper", "sidebar-right", "layout-sidebar-left", "sidebar-none", "page-modal-host", "post-content-ad-wrapper",
    "navbar-fixed", "comment-page", "cookie-consent-page", "container promo",
]


@pytest.mark.parametrize("name", WRAPPERS)
def test_html_layouts_do_not_hide_their_article(name):
    text, say = html_extract.main_text, lambda n: " ".join(SENTENCE.format(f"{n}{i}") for i in range(5)) + "."
    noise = f'<div class="sidebar">{say("side")}</div><div id="comments"><article class="comment"><p>{say("reply")}</p></article></div>'
    body, want = f"<h1>Head</h1><p>{say('a')}</p><p>{say('b')}</p>", f"Head {say('a')} {say('b')}"
    for page in (
        f'<div class="{name}"><article>{body}<div class="ad">{say("ad")}</div></article>{noise}</div>', f'<div class="{name}">{noise}<main>{body}</main></div>',
        f'<main><p>Home</p><div class="{name}"><article>{body}</article>{noise}</div></main>', f'<div id="{name}"><div class="col"><div class="{name}"><article>{body}</article></div></div></div>',
        f'<div class="{name}">{body}{noise}</div>',
    ):
        assert text(f"<html><body><nav>{say('menu')}</nav>{page}<footer>{say('foot')}</footer></body></html>") == want
    # what the same name hides beside an article stays hidden
    assert text(f'<article>{body}</article><div class="{name}"><p>{say("x")}</p><article><p>{say("card")}</p></article></div>') == want


def test_html_states_links_and_sections():
    text, say = html_extract.main_text, lambda n: " ".join(SENTENCE.format(f"{n}{i}") for i in range(5)) + "."
    for state in ("comments-on", "comments-open", "comments-enabled"):
        assert text(f'<article><p>{say("a")}</p></article><div class="{state}"><p>{say("reply")}</p></div>') == say("a")
        assert text(f'<article><p>{say("a")}</p><div class="{state}"><p>{say("reply")}</p></div></article>') == say("a")
        assert text(f'<body class="{state}"><article class="{state}"><p>{say("a")}</p></article>') == say("a")
        assert text(f'<div class="post {state}"><p>{say("a")}</p></div><div class="box"><p>{say("b")}</p></div>') == f"{say('a')} {say('b')}"
    linked = "See <a href=/x>the long linked title of another page</a> now."
    assert text(f"<article><p>{say('a')}</p><p>{linked}</p><p>{say('b')}</p></article>") == f"{say('a')} See the long linked title of another page now. {say('b')}"
    assert text(f"<article><p>{say('a')}</p><ul><li><a href=/x>The long linked title of a page.</a></li><li>More: <a href=/y>Another long title here.</a></li></ul></article>") == say("a")
    assert text(f"<article><p>{say('a')}</p><![CDATA[ x > y ]]><p>{say('b')}</p></article>") == f"{say('a')} {say('b')}"
    assert text(f"<div class=menu><p>{say('a')}</p></div><div class=cookie><p>{say('b')}</p></div>") == ""  # nothing but menus and notices
    assert text(f'<article><p>{say("a")} <span class="promo">Buy</span> {say("b")}</p></article>') == f"{say('a')} {say('b')}"


@pytest.mark.parametrize("page", ["<b>" * 40000 + "</i>" * 40000, "<a " * 40000 + '"', '<a "' * 40000, "<li><ul>" + "<b>" * 20000 + "<li></li>" * 20000, "<!--" * 40000, "<p><a href='x" * 20000])
def test_html_takes_linear_time(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 5
