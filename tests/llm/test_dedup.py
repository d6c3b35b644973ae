"""Exact, near, line and embedding dedup against brute force, and their odd cases."""

import random
import re

import numpy as np
import pytest

from quire.llm import embedding_dedup, exact_dedup, line_dedup, near_dedup


def least_reachable(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_words(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(30):
        base = rng.choices(words, k=rng.randint(3, 150))
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append((len(out), " ".join(own)))
    return out


def test_near_duplicates_match_brute_force(spark, llm_docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(llm_docs(texts), 3, 85, 100).collect()}
    sets = {i: shingle_words(t, 3) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = least_reachable(sets, links)
    assert links
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_near_duplicates_large_nodes_branch(spark, llm_docs, monkeypatch):
    """Small limits force deep trees and the second round of comparisons."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "DEPTH", 3)
    monkeypatch.setattr(near_dedup, "SALT", 4)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(40):
        own = list(base)
        own[rng.randrange(80)] = f"x{i}"
        if i % 2:
            own[:25] = [f"y{j}" for j in range(25)]
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(llm_docs(rows), 3, 85, 100).collect()}
    sets = {i: shingle_words(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == least_reachable(sets, links)


def test_near_duplicates_odd_rows(spark, llm_docs, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(llm_docs(odd, clash=True)).collect()), key=str)
    assert len(got) == len(odd)
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g[1:])
    assert by[1] == by[2] and by[1][0][0] == 0 or by[1] == [(0, 1, True)]
    assert by[5] == [(6, 4, False)] and by[4] == [(6, 4, True)] * 2
    assert by[None][0][1] is None
    assert near_dedup.near_duplicates(llm_docs([])).count() == 0


def test_exact_dedup(spark, llm_docs, odd, tmp_path):
    llm_docs(odd, clash=True).repartition(3).write.parquet(str(tmp_path / "d.parquet"))
    got = exact_dedup.exact_dedup(spark, str(tmp_path / "d.parquet")).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert (by[5].keep_id, by[5].group_size, by[5].kept) == (5, 3, True)
    assert (by[4].keep_id, by[4].kept) == (5, False)
    assert (by[1].keep_id, by[2].kept, by[1].group_size) == (2, True, 2)
    assert by[None].group_size == 1
    llm_docs([]).write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0


def test_exact_dedup_state_takes_new_files_only(spark, llm_docs, tmp_path):
    path, at = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    llm_docs([(1, "a"), (2, "b")]).write.parquet(path)
    assert exact_dedup.digest_state(spark, path, checkpoint=at).count() == 2
    llm_docs([(3, "a")]).write.mode("append").parquet(path)
    again = {r.keep_id: r.n for r in exact_dedup.digest_state(spark, path, checkpoint=at).collect()}
    assert again == {3: 2, 2: 1}


def brute_lines(rows, width, num, den, min_words):
    earlier, out = [], set()
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            s = shingle_words(line, width)
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) < min_words:
                continue
            if any(den * len(s & e) >= num * len(s | e) for e in earlier):
                out.add((d, i))
            earlier.append(s)
    return out


@pytest.mark.parametrize("width", [1, 5])
def test_line_dedup_matches_brute_force(spark, llm_docs, width):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    pool = [rng.choices(words, k=rng.randint(1, 40)) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            lines.append(" ".join(own))
        rows.append((d, "\n".join(lines)))
    got = {(r.doc, r.line) for r in line_dedup.removed_lines(llm_docs(rows), width=width).collect()}
    assert got == brute_lines(rows, width, 80, 100, 1) and got
    long = {(r.doc, r.line) for r in line_dedup.removed_lines(llm_docs(rows), width=width, min_words=5).collect()}
    assert long == brute_lines(rows, width, 80, 100, 5) and long


def test_line_dedup_texts_and_odd_rows(spark, llm_docs, odd):
    rows = [(1, "a b c d e f\nshort\nA B C d e F\nshort"), (2, "other words here are five\na b c d e f")]
    got = {r.doc_id: (r.text, r["__removed"]) for r in line_dedup.deduped(llm_docs(rows, clash=True)).collect()}
    assert got == {1: ("a b c d e f\nshort", 2), 2: ("other words here are five", 1)}
    out = line_dedup.deduped(llm_docs(odd, clash=True))
    assert out.count() == len(odd) and {"id", "n", "comp"} <= set(out.columns)
    assert line_dedup.deduped(llm_docs([])).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, base[:60] + 0.05 * rng.standard_normal((60, 16)), base[0] + 0.03 * rng.standard_normal((80, 16)), base[:5]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    comp = least_reachable(range(len(x)), zip(*np.nonzero(near), strict=True))
    assert got == {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}
    assert embedding_dedup.recall(df, embedding_dedup.near_duplicates(df), every=10) == 1.0


def test_embeddings_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [1e-30, 1e-30]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as comp", "'x' as digest")
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert by[6] == (2, 6, True) and by[7] == (2, 6, False) and by[8] == (2, 6, False)
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 9, 10))
    assert by[None][0] == 0
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_embeddings(x):
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    comp = least_reachable(range(len(x)), zip(*np.nonzero(near), strict=True))
    return near, {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}


@pytest.mark.parametrize("centres", [16_384, 1])
def test_embeddings_saturated_groups_are_joined(spark, monkeypatch, centres):
    """Groups of more than K near copies that link with each other, and a lone vector beside one: no list of K has these links."""
    monkeypatch.setattr(embedding_dedup, "CENTRES", centres)
    rng = np.random.default_rng(4)
    a, b, c = np.linalg.qr(rng.standard_normal((64, 3)))[0].T
    near_a = 0.92 * a + np.sqrt(1 - 0.92**2) * b
    spread = lambda v, n: v + 0.008 * rng.standard_normal((n, 64))
    x = np.concatenate([spread(a, 30), spread(near_a, 30), spread(c, 15), rng.standard_normal((100, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    near, want = brute_embeddings(x)
    assert near[:30, 30:60].sum() > 800
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == want


def test_embeddings_are_audited_until_found(spark):
    """Lone pairs near the threshold, from one table and no round: more are added until the audit is met."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.standard_normal((600, 64))
    step -= (step * base[:600]).sum(1)[:, None] * base[:600]
    step /= np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate([base, 0.91 * base[:600] + np.sqrt(1 - 0.91**2) * step])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    out = embedding_dedup.near_duplicates(df, tables=1, rounds=0).collect()
    assert sum(r.n_links > 0 for r in out) >= 0.9 * 1200
    assert embedding_dedup.tables_for(20) > embedding_dedup.tables_for(10) > embedding_dedup.tables_for(0) == embedding_dedup.TABLES


def test_embeddings_of_two_groups_that_all_link(spark):
    """Two groups of 40 vectors, all pairs of which link: 79 links each and one component."""
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    near_a = 0.94 * a + np.sqrt(1 - 0.94**2) * b
    x = np.concatenate([v + 0.004 * rng.standard_normal((40, 64)) for v in (a, near_a)] + [rng.standard_normal((60, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    near, want = brute_embeddings(x)
    assert (near[:80].sum(1) == 79).all()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()} == want


def test_embeddings_at_the_threshold(spark):
    """Pairs just above and just below 0.9: only the first are linked and joined."""
    rows = []
    for k, c in enumerate([0.9 + 1e-10, 0.9 - 1e-10, 0.9 + 1e-7, 0.9 - 1e-7]):
        u, v = np.zeros(16), np.zeros(16)
        u[2 * k], v[2 * k], v[2 * k + 1] = 1, c, np.sqrt(1 - c * c)
        rows += [(2 * k, u.tolist()), (2 * k + 1, v.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_lists_are_cut_as_by_a_loop(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(6), w, 1 - w / 100, rng.randrange(2)) for w in (rng.randrange(30) for _ in range(400))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = sorted((r.u, r.w) for r in embedding_dedup._best(spark.createDataFrame(edges, "u bigint, w bigint, cos double, fresh int"), 4).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((u, w) for u in range(6) for w in sorted({w for v, w, *_ in edges if v == u})[:4])
    assert got == want


def test_near_duplicate_recall_is_what_is_stated():
    """The branching process's recall, by running it."""
    rng = np.random.default_rng(1)
    t, depth, runs = 0.85, 5, 4000
    lost = 0
    for _ in range(runs):
        now = 1
        for level in range(depth):
            picks = now + (rng.random(now) < (1 / t - 1) * (2 if level >= near_dedup.WIDER else 1)).sum()
            now = int((rng.random(picks) < t).sum())
        lost += now == 0
    assert abs(lost / runs - (1 - near_dedup.recall(t, depth=depth, trees=1))) < 0.03
    assert near_dedup.recall(0.85, depth=8) > 0.999 and near_dedup.recall(0.8, 0.85, depth=8) > 0.9999
