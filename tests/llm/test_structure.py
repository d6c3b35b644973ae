"""Periodic runs, fingerprints and tokenizer alignment, each against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, fingerprints, periodicity
from quire.llm.bpe import vocabulary_path


def words(text):
    return (text or "").encode().split()


def as_table(spark, tmp_path, df, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- periodic runs


def slow_runs(t, least=6, exponent=4):
    found = {}
    for q in range(1, len(t) // exponent + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, q, j - i) for (i, j), q in found.items())


def fast_runs(t, *how):
    begin, end, period = periodicity.find_runs(np.array(t, np.int64), len(t), *how)
    return [(int(b), int(p), int(e - b)) for b, e, p in zip(begin, end, period)]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randrange(130)
        t = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n:
                a = rng.randrange(n)
                p, e = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
                for i in range(a, e):
                    t[i] = t[a + (i - a) % p]
        exponent = rng.choice([3, 4, 5])
        assert fast_runs(t, 6, exponent) == slow_runs(t, 6, exponent), t


@pytest.mark.parametrize("scale", [40, 97, 250])
def test_long_periods_and_runs_within_runs(scale):
    rng = random.Random(scale)
    inner = [rng.randrange(50) for _ in range(scale)] + [7] * 9 + [1, 2] * 11
    t = [99, *inner * 5, 98, *[rng.randrange(9) for _ in range(400)], *inner[:-1] * 4]
    assert fast_runs(t) == slow_runs(t)


def test_one_word_many_times_and_none():
    assert fast_runs([3] * 100_000) == [(0, 1, 100_000)] and fast_runs([]) == [] and fast_runs([1, 1, 1, 1, 1]) == []
    with pytest.raises(ValueError):
        periodicity.find_runs(np.zeros(9, np.int64), 9, 6, 2)


def collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_odd_texts(spark, llm_docs, odd):
    docs = llm_docs([*odd, (9, "a b " * 5 + "c"), (10, "x y\n x\ty  x y x y x y")], clash=True)
    out = periodicity.periodic_runs(docs.withColumn("runs_", F.lit(1)), ["doc_id", "text", "n"]).collect()
    assert len(out) == len(odd) + 2
    for r in out:
        w = words(r.text)
        want = slow_runs([hash(x) for x in w]) if len(w) < 5000 else [(0, 1, 30000)]
        assert [(x.start, x.period, x.length) for x in r.runs] == want and r.n_words == len(w) and r.n == 7
        assert r.collapsed.encode() == collapsed(w, want)
    assert periodicity.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0


def test_batches_are_cut_between_documents(spark, llm_docs, monkeypatch):
    docs = llm_docs([(i, "a b c " * (i % 7)) for i in range(60)]).coalesce(1)
    got = {r.doc_id: len(r.runs) for r in periodicity.periodic_runs(docs, ["doc_id"]).collect()}
    assert got == {i: int(i % 7 >= 4) for i in range(60)}


def test_op11_equals_brute_force(spark, llm_docs, odd, tmp_path):
    rng = random.Random(2)
    rows = [*odd, *((i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 160)))) for i in range(100, 300))]
    sf = as_table(spark, tmp_path, llm_docs(rows, clash=True))
    want = Counter()
    for r in rows:
        w = words(r[1])
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = slow_runs([hash(x) for x in w]) if n < 5000 else [(0, 1, n - (w[-1] == b"end"))]
        best = min(((-n, s, q) for s, q, n in found), default=None)
        head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        want[(r[0], len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found)).hexdigest())] += 1
    got = Counter(tuple(r) for r in periodicity.op11_periodicity(spark, sf).collect())
    assert got == want and sum(x[1] for x in want) > 3


# --- fingerprints


def slow_keys(text):
    import re

    c = [zlib.crc32(w.encode()) % (1 << 28) for w in re.findall(fingerprints.TOKEN, text or "")]
    if not c:
        return []
    c += [0] * max(0, fingerprints.K - len(c))
    h = [sum(c[i + j] * pow(fingerprints.BASE, fingerprints.K - 1 - j, fingerprints.PRIME) for j in range(fingerprints.K)) % fingerprints.PRIME for i in range(len(c) - fingerprints.K + 1)]
    chosen = {min((h[j], -j) for j in range(i, min(i + fingerprints.WINDOW, len(h)))) for i in range(max(len(h) - fingerprints.WINDOW + 1, 1))}
    return sorted((-j, v) for v, j in chosen)


def slow_likeness(a, b):
    a, b = {v for _, v in a}, {v for _, v in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_odd_texts(spark, llm_docs, odd):
    docs = llm_docs([*odd, (8, "a b"), (9, " a b c d e "), (9, "the same words again and " * 9), (10, "日本語" * 40)], clash=True)
    rows = fingerprints.fingerprints(docs, name="fp").collect()
    assert len(rows) == len(odd) + 4 and rows[0].n == 7
    for r in rows:
        assert [(v % (1 << 32), v >> 32) for v in r.fp] == slow_keys(r.text)
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_shared_words_share_a_hash(spark, llm_docs):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(60):
        shared = [word() for _ in range(fingerprints.K + fingerprints.WINDOW - 1)]
        rows += [(2 * i + k, " ".join([word() for _ in range(rng.randrange(60))] + shared + [word() for _ in range(rng.randrange(60))])) for k in (0, 1)]
    by = {r.doc_id: {v >> 32 for v in r.fingerprint} for r in fingerprints.fingerprints(llm_docs(rows)).collect()}
    assert all(by[2 * i] & by[2 * i + 1] for i in range(60))


@pytest.mark.parametrize("ids", [range(500), [7] * 20 + [3] * 300 + list(range(40)), [5]])
def test_each_row_beside_the_next(spark, ids, monkeypatch):
    rows = [(i, f"{k} text") for k, i in enumerate(ids)] + ([(None, "no id"), (None, None)] if len(ids) > 1 else [])
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = fingerprints.bucketed
    monkeypatch.setattr(fingerprints, "bucketed", lambda d, key: real(d, key, rows=9, most=40))
    got = fingerprints.neighbours(docs).collect()
    pairs = Counter((r.doc_id, r.text, r.next_text) for r in got)
    tie = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i is not None, i or 0, tie[t or ""]), i, t or "") for i, t in rows)
    assert pairs == Counter((a[1], a[2], b[2]) for a, b in zip(order, order[1:] + order[:1]))


def test_op12_equals_brute_force(spark, llm_docs, odd, tmp_path):
    rng = random.Random(4)
    rows = [r for r in odd if r[0] != 4] + [(4, "one two three four")] + [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(120)))) for i in range(50, 130)]
    sf = as_table(spark, tmp_path, llm_docs(rows, clash=True))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for r, after in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", after[1] or ""
        m = len(t) // 4
        x = t[: len(t) - m] + u[:m]
        a, e, o = slow_keys(t), slow_keys(x), slow_keys(u)
        text = lambda keys: " ".join(f"{p}:{v}" for p, v in keys)
        want[r[0]] = (len(t), hashlib.sha256(x.encode()).hexdigest(), text(a), text(e), slow_likeness(a, e), slow_likeness(a, o))
    got = {r[0]: tuple(r)[1:] for r in fingerprints.op12_fingerprints(spark, sf).collect()}
    assert got == want


# --- alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.load(vocabulary_path(alignment.A)), alignment.load(vocabulary_path(alignment.B))


def slow_alignment(text, first, second):
    """Groups as text, and how many links each id pair has, token by token and from the libraries' own encodings of the whole text."""
    ids = first.slow.encode(" " + text, add_special_tokens=False).ids, second.model.encode(text)
    pieces = [[p[i].as_py() for i in own] for p, own in zip((first.pieces, second.pieces), ids)]
    if not text or any(b"".join(p) != (" " + text).encode() for p in pieces):
        return "", Counter(), 0, 0
    ends = [np.cumsum([len(p) for p in own]).tolist() for own in pieces]
    groups, pairs, at = [], Counter(), [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        upto = [e.index(cut) + 1 for e in ends]
        a, b = (own[i:j] for own, i, j in zip(ids, at, upto))
        groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        pairs.update(x << alignment.BITS | y for x in a for y in b)
        at = upto
    return ";".join(groups), pairs, len(ids[0]), len(ids[1])


TEXTS = [
    None, "", " ", "  ", "a", " a  b ", "a\n\n\t b", "▁x", "a▁b", "<s> hi </s> <|endoftext|> x", "日本語のテキスト 🎉🎉🎉", "a" * 70, "🎉" * 50, "\x00\x01", "é" * 300, "=-" * 400, " " * 3000, "ﬁ Ａ ①", "x" * 4000, "the end. The end 　.", "ends with space ",
]


def test_alignment_equals_brute_force(spark, llm_docs, tokenizers):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice(["a", "b", "é", " ", "  ", "日", "🎉", "\n", "<0x0A>", "the", "ing", ".", " \t", "▁"]) for _ in range(rng.randrange(70))) for _ in range(150)]
    docs = llm_docs([(i, t) for i, t in enumerate(texts)], clash=True).coalesce(2)
    got = {r.doc_id: r for r in alignment.align(docs, ["doc_id", "n"]).collect()}
    for i, t in enumerate(texts):
        groups, pairs, n_a, n_b = slow_alignment(t or "", *tokenizers)
        r = got[i]
        assert (r.groups, dict(zip(r.pairs, r.links)), r.n_a, r.n_b, r.n_links, r.n) == (groups, dict(pairs), n_a, n_b, sum(pairs.values()), 7), t
        assert r.n_groups == (groups.count(";") + 1 if groups else 0)
    assert alignment.align(docs.limit(0), ["doc_id"]).count() == 0


def test_splitter_failures_fall_back(tokenizers):
    first, _ = tokenizers
    text = " a" + " " * 200_000 + "b"
    assert first.encode([text])[0] == first.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("heavy", [1, 40, 10**6])
def test_op13_equals_brute_force(spark, llm_docs, tokenizers, tmp_path, monkeypatch, heavy):
    rng = random.Random(9)
    some = ["the cat sat on the mat", "naïve café owners", "tokenization of words", "die Straße ist lang", "zzxqy 12345"]
    rows = [(k, t) for k, t in enumerate(TEXTS[:12])] + [(100 + k, " ".join(rng.choice(some) for _ in range(rng.randrange(1, 4)))) for k in range(60)] + [(None, some[0]), (100, some[0]), (100, some[0])]
    sf = as_table(spark, tmp_path, llm_docs(rows, clash=True))
    monkeypatch.setattr(alignment.linked, "__defaults__", (heavy,))
    aligned = [slow_alignment(t or "", *tokenizers) for _, t in rows]
    counts = Counter(p for _, pairs, _, _ in aligned for p in pairs)
    most = defaultdict(int)
    for p, n in counts.items():
        most[p >> alignment.BITS] = max(most[p >> alignment.BITS], n)
    want = Counter()
    for (i, _), (groups, pairs, n_a, n_b) in zip(rows, aligned):
        best = sum(n for p, n in pairs.items() if counts[p] == most[p >> alignment.BITS])
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want[(i, n_a, n_b, groups.count(";") + 1 if groups else 0, sum(pairs.values()), best, sum(n * counts[p] for p, n in pairs.items()), digest)] += 1
    got = Counter(tuple(r) for r in alignment.op13_alignment(spark, sf).collect())
    assert got == want
