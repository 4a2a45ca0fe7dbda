"""Spelling variants, nearest neighbours and ranked search against brute force."""

import collections
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from fairlead.llm import lexical, queries, spelling, sql, vantage  # noqa: E402


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{small}/{name}'")
    return con


def texts_frame(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, 7, "x", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string, shard int")


@pytest.mark.parametrize("name", ["op11_spelling", "op12_vantage", "op13_lexical"])
def test_query_equals_sql(spark, duck, small, name):
    found = getattr(queries, name)(spark, small)
    told = duck.sql(sql.ORACLES[name])
    assert sorted(found.columns) == sorted(told.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found.select(told.columns).collect()), key=key) == sorted(told.fetchall(), key=key)


# -- spelling -------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(texts, least=3):
    counts = collections.Counter()
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        counts.update(w for w in re.findall("[a-zÀ-ÿ]+", low) if len(w) >= 5)
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, len(near[w]), words.get(forms[w])) for w, n in words.items()}


def told(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_of_random_words(spark, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(spelling, "BLOCK", 16)  # so that keys are cut into blocks that meet in pairs
    texts = [" ".join("".join(random.choice("aé") for _ in range(random.randint(4, 9))) for _ in range(400)) for _ in range(30)]
    want = spelled(texts)
    assert len(want) > 300 and told(spelling.variants(texts_frame(spark, texts)).collect()) == want


def test_spelling_chains_ties_and_edges(spark):
    texts = [None, "", " \n", "lone", "Chain! chain chain", "chaint " * 6, "chainte " * 12, "chaintes " * 24, "tiexa " * 3 + "tiexb " * 6 + "tiexc " * 6, "É" * 300 + " "]
    texts += [texts[-1]] * 2 + ["É" * 150 + "x" + "É" * 149 + " "] * 6 + ["ÉTAGE étage ÉTAGE ÉTAGE", "a×÷bcd a×÷bcd a×÷bcd"]
    found = told(spelling.variants(texts_frame(spark, texts)).collect())
    assert found == spelled(texts)
    assert found["chain"][:2] == ("chaint", "chaintes") and found["tiexa"][0] == "tiexb" and found["É" * 300][0] is not None
    assert spelling.variants(texts_frame(spark, [])).isEmpty()
    assert spelling.variants(texts_frame(spark, [None, "once only here"])).isEmpty()


def test_long_texts_are_cut_between_words():
    text = "Word één " * 5000 + "tail" * 2000
    parts = list(spelling.parts_of(text, 1000))
    assert "".join(parts) == text and len(parts) > 30
    assert sum((collections.Counter(spelling.RUN.findall(p.lower())) for p in parts), collections.Counter()) == collections.Counter(spelling.RUN.findall(text.lower()))


def test_spoiled_words(spark, small):
    run, doc = next((w, d) for d in range(1000) for w in ("hello", "spoiled", "étage") if zlib.crc32(f"{d}:{w}".encode()) % 97 == 0)
    h = zlib.crc32(f"{doc}:{run}".encode())
    assert spelling.spoiled(run, doc, 97) == run[: h % len(run)] + run[h % len(run) + 1 :]


# -- nearest neighbours ---------------------------------------------------------------------------


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, leaf int, score double")


def nearest(rows, every=100, k=10):
    """Brute force; rows of finite vectors of one dimension."""
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = []
    for i, (q, _) in enumerate(rows):
        if q is not None and q % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            found = sorted((d[j], rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != i)[:k]
            out += [(q, n, None if none else v, s) for n, (s, none, v) in enumerate(found, 1)]
    return out


def same(found, want):
    order = lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0)
    found, want = sorted(map(tuple, found), key=order), sorted(want, key=order)
    return [r[:3] for r in found] == [r[:3] for r in want] and np.allclose([r[3] for r in found], [r[3] for r in want], atol=1e-9)


def test_exact_search_over_many_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.2 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(500)]  # a large group of copies, queries among them
    for parts in ({"shard": 64, "leaf": 8, "sample": 300, "block": 7}, {}):
        assert same(vantage.neighbours(vectors_frame(spark, rows), factor=1.0, **parts).collect(), nearest(rows))


def test_recall_of_relaxed_search(spark, small):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=32)).tolist()) for i in range(4000)]
    want = collections.defaultdict(set)
    for q, _, v, _ in nearest(rows):
        want[q].add(v)
    found = collections.defaultdict(set)
    for r in vantage.neighbours(vectors_frame(spark, rows), factor=queries.FACTOR, shard=256, leaf=16).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert sum(len(want[q] & found[q]) for q in want) >= 0.9 * 10 * len(want)


def test_relaxing_visits_less():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 4))
    x = np.concatenate([c + 0.1 * rng.normal(size=(100, 4)) for c in centres])
    tree, q = vantage.Tree(x, 6), x[::100]
    visits = []
    for factor in (1.0, 2.0, 4.0):
        seen = []
        tree.visit(q, np.full(len(q), 0.3), factor, lambda leaf, active, seen=seen: seen.append(len(active)))
        visits.append(sum(seen))
    assert visits[0] > visits[1] > visits[2] >= len(q)


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (None, [1.0, 0.5]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (100, [3.0, 0.0]), (9, []), (100, [3.0, 0.0]), (200, [0.0, 0.0])]
    fine = [r for r in rows if r[0] in (0, 6, None, 7, 100)]
    assert same(vantage.neighbours(vectors_frame(spark, rows)).collect(), nearest(fine))
    assert vantage.neighbours(vectors_frame(spark, [])).isEmpty()
    assert vantage.neighbours(vectors_frame(spark, [(0, [1.0, 2.0])])).isEmpty()


# -- ranked search --------------------------------------------------------------------------------


def ranked(items, docs, top=10):
    found = lambda t: collections.Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
    counts = [(d, found(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in found(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, n, None if none else d, -s) for n, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def search(spark, items, docs, **parts):
    items = spark.createDataFrame([(*r, 0, 1) for r in items], "item_id long, text string, rank int, term int")
    docs = spark.createDataFrame([(*r, 0, 1) for r in docs], "doc_id long, text string, score int, shard int")
    rows = lexical.search(items, docs, **parts).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=repr)


def test_search_prunes_exactly(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(random.choices(words, weights, k=random.randint(1, 60)))) for i in range(1200)]
    items = [(i, " ".join(random.choices(words, weights, k=12))) for i in range(30)]
    for parts in ({"shard_size": 40, "bundle_size": 7, "n_owners": 5}, {"n_owners": 1}):
        assert search(spark, items, docs, **parts) == ranked(items, docs)


def test_search_edges(spark):
    long = "Ünï-code tie " * 30_000
    docs = [(0, None), (1, ""), (2, " .,;"), (3, "tie A-Z"), (4, "tie a z"), (5, "tie a z"), (5, "tie a z"), (None, "tie a z"), (6, long), (7, "x"), (8, "ünï 数据 数据x"), (9, "filler"), (10, "filler")]
    items = [(0, "TIE"), (0, "TIE"), (1, None), (2, ""), (3, "nowhere"), (None, "ünï 数据x Tie"), (4, "code tie tie Z")]
    assert search(spark, items, docs) == ranked(items, docs)
    assert search(spark, items, docs, shard_size=1, bundle_size=1) == ranked(items, docs)
    assert search(spark, [], docs) == [] and search(spark, items, []) == []
    assert search(spark, items, [(1, None), (2, "...")]) == []


def test_terms_of_long_texts(monkeypatch):
    text = "Ab-Cé 12 " * 4000
    want = lexical.terms_of(text)
    monkeypatch.setattr(lexical, "BYTES_AT_ONCE", 100)
    assert lexical.terms_of(text) == want and want[b"ab"] == 4000

