"""Operators on whole corpora: near duplicates, repeats, components, mixing, neighbours, quality and the pipeline."""

import random

import brute
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import ann, mixing, near_dedup, quality, queries, repeats
from docweave.llm.components import components, grown, members


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def check_repeats(df, length):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute.repeats([r.text for r in rows], length), strict=True)), key=str)
    assert sorted((tuple(r) for r in repeats.digest(df, length).collect()), key=str) == want


def test_repeats_odd(odd, none):
    check_repeats(odd, 400)
    assert repeats.digest(none, 400).count() == 0
    cut = repeats.without_repeats(odd, 400)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r.doc_id: r.text for r in cut.collect()}[11] == ""


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_repeats_like_brute_force(spark, seed):
    """Texts that share pieces with small changes, so that runs begin and end anywhere."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde é") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pool = ["".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(25):
        t = "".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(words) * rng.randint(1, 30) for _ in range(rng.randint(0, 5)))
        if t and rng.random() < 0.5:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "x", "yy"]) + t[i + rng.randint(0, 2) :]
        texts.append(t)
    check_repeats(docs_of(spark, texts), rng.choice([24, 40, 100]))


@pytest.mark.parametrize("group", [1, 3, 8])
def test_repeats_of_names_with_many_entries(spark, monkeypatch, group):
    """Names with more entries than a task sorts are split into blocks of starts: down to single ones, or until few are left."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(group)
    passage = "".join(rng.choice("abcd ") for _ in range(300))
    texts = [f"{rng.choice('xyz')}{rng.choice('uvw')}{passage[: rng.randint(120, 300)]}{rng.choice('mn')}{rng.randint(0, 9)}" for _ in range(40)] + [passage[3:], passage[5:290] + "end"]
    check_repeats(docs_of(spark, texts), 100)


def test_intervals_of_an_array():
    """Each set of neighbours that share more with each other than with the rest, once."""
    words = sorted(["abab", "abac", "abad", "ac", "b", "ba", "bab"])
    shared = [0, *(repeats.common(a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False))]
    got = {(words[a], words[b], least, most) for a, b, least, most in repeats.intervals(shared)}
    assert got == {("abab", "bab", 0, 0), ("abab", "ac", 1, 1), ("abab", "abad", 2, 3), ("b", "bab", 1, 1), ("ba", "bab", 2, 2)}
    assert repeats.common(b"", b"x") == 0 and repeats.common(b"abc", b"abc") == 3 and repeats.common(b"\0\0a", b"\0\0b") == 2
    assert list(repeats.intervals([0])) == []


CLASHING = ("key", "t", "lo", "hi", "core", "h1", "h2", "n", "cid", "node", "comp", "component", "sig", "b", "p", "__repeats", "__repeats_key", "__repeats_own", "__row", "__text", "__mix_0", "__mix_cut", "__mix_id", "mix_copies", "__id", "__key", "__lone", "col")


def test_columns_with_clashing_names(spark, small):
    """Operators and stages keep or leave out columns that are called like their own."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)  # a fixture, not a query
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    plain = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns, name
        assert plain(out) == plain(stage(spark, docs, small)), name
        assert {tuple(r) for r in out.select(*CLASHING).distinct().collect()} == {tuple(range(len(CLASHING)))}, name
    assert sorted(map(str, repeats.digest(odd, 400).collect())) == sorted(map(str, repeats.digest(docs, 400).collect()))
    assert sorted(map(str, near_dedup.near_duplicates(odd).collect())) == sorted(map(str, near_dedup.near_duplicates(docs).collect()))


def test_repeats_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    data = (b"abcdefgh" * 20 + bytes(range(65, 120)) * 3) * 2
    found = [(int(t), int(a), int(b)) for part in repeats.phrases(data, 40) for t, a, b in zip(*part, strict=True)]
    assert [a for _, a, _ in found] == [0, *(b + 1 for _, _, b in found[:-1])] and found[-1][2] == len(data) - 40
    assert all(a <= t <= a + 40 and t - a >= 0 and b <= t for t, a, b in found)


def test_stage_cuts_short_passages_of_over_50_words(spark, small):
    """Planted passages of 51 words, in short and longer words and at signs, go from both documents; one of 50 words stays."""
    rng = random.Random(8)
    lone = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passages = [" ".join(rng.choice(letters) * rng.randint(1, most) for _ in range(51)) for letters, most in (("abcdefghij", 1), ("äbcdé", 4), ("klmnopqr", 9))]
    fifty = " ".join(rng.choice("stuvwxyz") * rng.randint(1, 3) for _ in range(50))
    texts = [f"{lone(30)} {p} {lone(30)}" for p in passages] + [f"{lone(30)}. **{p}.** | {lone(30)}" for p in passages] + [f"{lone(30)} {fifty} {lone(30)}" for _ in range(2)]
    docs = docs_of(spark, texts)
    cut = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, small).collect()}
    assert all(len(p.encode()) < 400 for p in passages)
    for i, p in enumerate(passages):
        assert cut[i] == texts[i].replace(p, "") and cut[i + 3] == texts[i + 3].replace(p, "")
    assert cut[6] == texts[6] and cut[7] == texts[7]


def test_stage_cuts_each_text_once(spark, small):
    """The stage's filter on what is left doesn't cut again in a second worker of the task."""
    stage = corpus_pipeline.without_repeats(spark, docs_of(spark, ["x " * 300] * 2 + ["one two"]), small)
    assert stage._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.text for r in stage.collect()] == ["one two"]


def check_near(df, width, percent):
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    want = brute.near(rows, width, percent)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(df, width, percent).collect() if r.doc_id is not None}
    assert got == want


def test_near_odd(odd, none):
    check_near(odd, 3, 85)
    out = near_dedup.near_duplicates(odd, 3, 85)
    assert out.count() == odd.count()
    assert tuple(out.where("doc_id is null").first()) == (None, 1, None, True)
    assert near_dedup.near_duplicates(none, 3, 85).count() == 0


def near_copies(rng, n, base_words, edits):
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_groups(spark, monkeypatch):
    """Large groups of near copies, with chains through the threshold, many small groups and loners; small nodes, so that all levels are used."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "DENSE", 16)
    rng = random.Random(5)
    texts = near_copies(rng, 120, 60, 8) + [t for _ in range(30) for t in near_copies(rng, 3, 40, 4)] + [" ".join(f"u{rng.randrange(10**7)}" for _ in range(30)) for _ in range(60)]
    texts += ["common start of texts " + t for t in near_copies(rng, 40, 20, 20)]
    rng.shuffle(texts)
    check_near(docs_of(spark, texts), 3, 85)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_recall_at_the_threshold(threshold):
    """Signatures of pairs that agree with the threshold's probability at each coordinate: how many pairs never meet, level by level, and what sketches rule out."""
    rng, pairs = np.random.default_rng(9), 6000
    a = rng.integers(0, 2**32, (pairs, near_dedup.COORDINATES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < threshold, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    sigs = np.concatenate((a, b))
    nodes, who = np.tile(near_dedup._roots(), 2 * pairs), np.repeat(np.arange(2 * pairs), near_dedup.TREES)
    missed = []
    for level in range(near_dedup.START + near_dedup.STEP * (near_dedup.DEPTH - 1)):
        nodes, who = near_dedup.branch(nodes, who, sigs, threshold, 1.0 if level < near_dedup.START else near_dedup.GROW)
        order = np.lexsort((nodes, who % pairs))
        n, w = nodes[order], who[order] % pairs
        twin = (n[1:] == n[:-1]) & (w[1:] == w[:-1])
        met = np.zeros(len(n), bool)
        met[1:] |= twin
        met[:-1] |= twin
        nodes, who = nodes[order[met]], who[order[met]]
        missed.append(1 - len(np.unique(who % pairs)) / pairs)
    assert missed[near_dedup.START - 1] <= 5e-4 and missed[-1] <= 5e-3
    assert ((a == b).sum(1) >= near_dedup.least_agreeing(threshold)).all()


def test_near_links_at_exactly_the_threshold(spark):
    """Pairs with 85 of 100 shingles in common are links, those with 84 are none; each of 400 pairs is found."""
    words = lambda c, i, n: [f"{c}{i}x{k}" for k in range(n)]
    rows = []
    for i in range(400):
        own = 15 + (i % 2)  # of the second text only
        rows += [(2 * i, " ".join(words("a", i, 85 - i % 2))), (2 * i + 1, " ".join(words("a", i, 85 - i % 2) + words("b", i, own)))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()}
    assert got == {d: d - 1 if d % 2 and d // 2 % 2 == 0 else d for d, _ in rows}


def test_near_several_texts_of_an_id(spark):
    """An id that is the smallest of two unlike sets links the near copies of both."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "none of it at all")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_near_on_test_data(spark, small):
    check_near(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), 5, 80)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent if i in got} and {i for a, b in links if a != b for i in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow(spark):
    """New links, in any order and also inside of known components, give what all links at once give."""
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(7, n) for n in range(400, 500)] + [(5, 5)]
    found = None
    for at in range(0, len(links), 120):
        found = grown(found, spark.createDataFrame(links[at : at + 120], "a long, b long"))
    found = grown(found, spark.createDataFrame([], "a long, b long"))
    whole = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, members(found).collect())) == sorted(map(tuple, whole))
    assert len(whole) == len({r.id for r in whole})


def test_waterfill():
    assert mixing.waterfill(100, [1, 1], [30, 500]) == [30, 70]
    assert mixing.waterfill(100, [3, 1, 0], [500, 500, 500]) == [75, 25, 0]
    assert mixing.waterfill(100, [1, 1], [30, 40]) == [30, 40]


def test_shortages_go_to_siblings_first():
    leaf = mixing.Node()
    tree = mixing.Node({"a": (0.5, mixing.Node({"x": (1, leaf), "y": (1, leaf)})), "b": (0.5, leaf)})
    room = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 100.0}
    assert mixing.allocate(tree, room, 100) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    room["a", "y"] = 20.0
    assert mixing.allocate(tree, room, 100) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}


def nested(node):
    return {n: (w, nested(c)) for n, (w, c) in node.children.items()}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from(["core", "wide", "else"]), st.sampled_from(["en", "de", "xx"]), st.sampled_from(["src0", "src1", "s"])), st.integers(0, 1000), min_size=1), st.floats(0, 1.2))
def test_budgets_like_bisection(room, part):
    amount = part * sum(room.values())
    got = mixing.allocate(queries.TREE, {k: float(v) for k, v in room.items()}, amount)
    want = brute.budgets(nested(queries.TREE), room, amount)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def copies_by_sorting(rows, budget_of, seed):
    """rows (id, leaf, tokens): whole epochs, and the rows whose keys come first as far as the rest goes; rows of one id together."""
    import hashlib

    have = {}
    for _, leaf, n in rows:
        have[leaf] = have.get(leaf, 0) + n
    want = {}
    for k, total in have.items():
        whole, rest = divmod(int(budget_of[k] + 1e-6), total) if total else (0, 0)
        sums = {}
        for i, leaf, n in rows:
            if leaf == k:
                sums[i] = sums.get(i, 0) + n
        upto = 0
        for i in sorted(sums, key=lambda i, e=whole: hashlib.md5(f"{seed}:{e}:{'null' if i is None else i}".encode()).hexdigest()):
            upto += sums[i]
            want[i, k] = whole + (upto <= rest)
    return want


def test_mix_like_brute_force(spark, small):
    """Budgets by bisection, tokens by the library, prefixes by sorting all rows."""
    import public_tokenizers

    from docweave.llm.token_counts import _ranks

    encode = _ranks(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).encode_ordinary
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    leaf = lambda r: ("core" if r.source in ("src0", "src1", "src2", "src3", "src4") else "wide", r.lang, r.source)
    rows = [(r.doc_id, leaf(r), len(encode(r.text or ""))) for r in docs]
    have = {}
    for _, k, n in rows:
        have[k] = have.get(k, 0) + n
    budget = brute.budgets(nested(queries.TREE), {k: 4 * v for k, v in have.items()}, 0.8 * sum(have.values()))
    want = copies_by_sorting(rows, budget, 11)
    tokens = {i: n for i, _, n in rows}
    found = queries.op2_mixing(spark, small).collect()
    assert {(r.doc_id, (r.domain, r.lang, r.source)): r.n_copies for r in found} == want
    assert {r.doc_id: r.n_tokens for r in found} == tokens


@pytest.mark.parametrize("few", [1, 64])
def test_mix_of_many_rows(spark, monkeypatch, few):
    """A leaf with most rows, repeated and null ids, rows without tokens, several cuts of its buckets."""
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(4)
    rows = [(rng.choice([None, 5, 5, *range(3000)]), "big" if rng.random() < 0.9 else rng.choice("xyz"), rng.choice([0, 1, 7, 400])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, leaf string, n long")
    budget = 0.6 * sum(n for _, _, n in rows)
    room = {}
    for _, k, n in rows:
        room[k,] = room.get((k,), 0) + 3 * n
    want = copies_by_sorting([(i, (k,), n) for i, k, n in rows], brute.budgets({}, room, budget), 3)
    out = mixing.mix(df, [F.col("leaf")], mixing.Node(), F.col("n"), budget=budget, max_epochs=3, seed=3)
    assert {(r.doc_id, (r.leaf,)): r.n_copies for r in out.collect()} == want and out.count() == len(rows)


def test_leaves_pass_no_python_worker(spark):
    """Tables of leaves go to the JVM without Python workers, whose pool stays in each executor."""
    df = spark.range(9).selectExpr("id as doc_id", "cast(id % 3 as string) as leaf")
    out = mixing.mix(df, [F.col("leaf")], mixing.Node(), F.lit(1), share=0.5)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString() and out.count() == 9


def test_mix_odd(odd, none):
    tokens = F.length("text")
    out = mixing.mix(odd, [F.col("lang"), F.col("source")], mixing.Node(), tokens, share=0.5, copies_col="copies")
    assert out.count() == odd.count() and out.columns == [*odd.columns, "copies"]
    assert mixing.mix(none, [F.col("lang")], mixing.Node(), tokens).count() == 0
    over = mixing.mix(odd, [F.col("lang")], mixing.Node(), tokens, share=2.0, copies_col="copies")
    assert {r.copies for r in over.collect()} == {2}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")


def check_nearest(spark, rows, k, recall):
    data = {i: v for i, v, _ in rows if i is not None}
    want = brute.nearest(data, [i for i in data if i % 20 == 0], k)
    got = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {q for q in want if want[q]}
    hits = total = 0
    for q, near in want.items():
        found = [got[q][n + 1] for n in range(len(near))] if near else []
        assert len(got.get(q, {})) == len(near) and q not in {i for i, _ in found}
        assert [(-round(s, 9), i) for i, s in found] == sorted((-round(s, 9), i) for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in near})
        total += len(near)
    assert hits >= recall * total


def test_nearest_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), 0.0) for i in range(60)]
    rows += [(100, None, 0.0), (120, [0.0] * 6, 0.0), (140, [float("nan")] * 6, 0.0), (160, [None] * 6, 0.0), (180, [], 0.0), (None, [1.0] * 6, 0.0), (200, [float("inf")] * 6, 0.0)]
    rows += [(1000 + i, [1.0, 0, 0, 0, 0, 0.5][:6], 0.0) for i in range(60)]
    check_nearest(spark, [(i, v and [x if x is None else float(x) for x in v], s) for i, v, s in rows], 20, 1.0)
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    check_nearest(spark, rows[:3], 20, 1.0)


def test_nearest_ties_of_many_vectors(spark):
    """Far more distinct vectors tie than are ranked: the smallest ids win."""
    rows = [(0, [1.0] + [0.0] * 40, 0.0)] + [(j, [1.0] + [float(i == j) for i in range(1, 41)], 0.0) for j in range(1, 41)]
    check_nearest(spark, rows, 3, 1.0)


def test_nearest_ties_and_blocks():
    """The best of each row, ties by the smallest id, rows with too few allowed."""
    score = np.array([[1.0, 2.0, 2.0, -np.inf, 2.0], [-np.inf, -np.inf, 0.5, -np.inf, -np.inf]])
    row, column = ann.best_of(score, np.array([9, 4, 1, 0, 7]), 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 2), (0, 1), (1, 2)]


def test_nearest_in_small_blocks(spark, monkeypatch):
    """Many blocks of rows and queries in each span, and a fit instead of all probes."""
    for name, value in (("BLOCK", 40), ("QUERIES", 16), ("ROWS", 8), ("SPAN", 4)):
        monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(5).normal(size=(700, 12))
    check_nearest(spark, [(i, v.tolist(), 0.0) for i, v in enumerate(x)], 20, 0.9)


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[::3] *= 3  # unlike norms
    x[700:1000] = x[700] + 0.01 * rng.normal(size=(300, 24))
    check_nearest(spark, [(i, v.tolist(), 0.0) for i, v in enumerate(x)], 20, 0.9)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 20))
    y = ann.rotated(x, 1, 7)
    assert np.allclose((x @ x.T), (y @ y.T)) and y.shape == (5, 32)


def test_quality(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    out = queries.op10_quality(spark, big).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [(r.predicted, marks[r.doc_id]) for r in out if r.held_out and r.doc_id in marks]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_features_and_score(spark, small):
    """Scores from features restated block by block."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit_on(docs, labels)
    w0, w1, w2 = model.weights
    for r in docs.select("text", model.score(F.col("text")).alias("s")).collect():
        d, ratio = brute.quality_features(r.text, model.good, model.bad)
        assert r.s == pytest.approx(1 / (1 + np.exp(-np.clip(w0 + w1 * d + w2 * ratio, -60, 60))), abs=1e-6)


def test_quality_is_calibrated(spark, small):
    """On held-out rows, scores come near the share of good texts: in total, and below and above the middle."""
    big = small.replace("sf0.001", "sf0.1")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [(r.score, marks[r.doc_id]) for r in queries.op10_quality(spark, big).where("held_out").select("doc_id", "score").collect() if r.doc_id in marks]
    score, mark = np.array(rows).T
    balanced = np.where(mark == 1, 0.5 / mark.mean(), 0.5 / (1 - mark.mean()))  # the fit weighs both classes alike
    for some in (score >= 0, score < 0.5, score >= 0.5):
        assert abs(np.average(score[some], weights=balanced[some]) - np.average(mark[some], weights=balanced[some])) < 0.1
    assert np.mean((score >= 0.7) == (mark == 1)) > 0.9


def test_quality_never_sees_held_out_labels(spark, small):
    """Labels of held-out rows turned round change no score."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.holdout(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert turned.exceptAll(labels).count() > 5
    one, other = (quality.fit_on(docs, x) for x in (labels, turned))
    assert (one.good, one.bad, one.weights) == (other.good, other.bad, other.weights)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 17)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(odd, labels)
    found = odd.select("doc_id", model.score(F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in found) and len({r.s for r in found if r.doc_id in (1, 2)}) == 1
    lone = quality.fit_on(odd, labels.where("quality = 1"))
    assert {r.s for r in odd.select(lone.score(F.col("text")).alias("s")).collect()} == {0.5}
    assert none.select(model.score(F.col("text"))).count() == 0


def test_near_stage_drops_repeats_only(spark, small):
    """Rows with a null id stay, and so do unlike texts of one id."""
    rows = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "delta"), (1, "one text"), (1, "one text"), (1, "another text here"), (2, "one text"), (3, None), (3, "")]
    out = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "alpha beta gamma"), (0, "alpha beta gamma"), (0, "delta"), (1, "another text here"), (1, "one text"), (3, "")]


@pytest.fixture
def tables(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(1, 17)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_quality_stage_without_a_model(spark, small, tmp_path):
    """Labels of one class or none teach nothing and reject nothing; labels of both classes do."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    for name, some in (("one", labels.where("quality = 1")), ("none", labels.where("false"))):
        some.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.good_quality(spark, docs, str(tmp_path / name)).count() == docs.count()
    assert 0 < corpus_pipeline.good_quality(spark, docs, small).count() < docs.count()


def test_stages_keep_columns(spark, odd, none, tables):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tables)
            assert out.columns == docs.columns, name
            out.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
        assert last.count() == docs.count()


def test_pipeline(spark, small):
    """Each stage against what its operator says of that stage's own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, small).cache()
    assert set(good.columns) == set(docs.columns) and 0 < good.count() < docs.count()
    one = stages["near duplicates"](spark, good, small).cache()
    kept = {i for i, (_, _, k) in brute.near([(r.doc_id, r.text) for r in good.collect()], 5, 80).items() if k}
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept)
    cut = {r.doc_id: r.text for r in stages["repeated passages"](spark, one, small).collect()}
    rows = one.collect()
    want = {r.doc_id: t for r, t in zip(rows, brute.without_repeats([r.text for r in rows], 400, 51), strict=True)}
    assert cut == {i: t for i, t in want.items() if t.strip()}
    assert sum(cut.get(r.doc_id) != r.text for r in rows) > 5
    assert corpus_pipeline.run(spark, small).count() > 0


def test_pipeline_of_nothing(spark, small, tmp_path):
    """An empty table runs through to an empty result."""
    for t in ("documents", "labels"):
        spark.read.parquet(f"{small}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n_tokens"]
