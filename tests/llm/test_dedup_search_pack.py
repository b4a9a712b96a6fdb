import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import lattice_dedup, prefix_forest, prob_minhash, template_dedup, variable_packing
from graphloom.llm.lattice_dedup import decode_e8
from graphloom.llm.prob_minhash import shingle_hashes, signatures
from graphloom.llm.variable_packing import Planner

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def grouped(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


# MinHash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_shingle_hashes_are_those_of_sets():
    texts = ["a b c d e f", "x a b  c\nd e", "a b c", "", "c a b", "  ", "é ü a b c d é ü a b c d"]
    h, starts = shingle_hashes([t.encode() for t in texts])
    sets = [set(h[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert len(sets[0] & sets[1]) == 1 and not sets[2] & sets[4]


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    for share in (0.5, 0.9):
        a = [rng.choice(vocab) for _ in range(300)]
        b = [w if rng.random() < share**0.2 else rng.choice(vocab) for w in a]
        h, s = shingle_hashes([" ".join(a).encode(), " ".join(b).encode()])
        sig = signatures(h, s, 2000)
        x, y = (collections.Counter(h[i:j].tolist()) for i, j in zip(s, s[1:]))
        wx, wy = ({k: 1 + np.log(n) for k, n in c.items()} for c in (x, y))
        want = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in wx.keys() | wy.keys()) for d in wx.keys() & wy.keys())
        assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    assert (signatures(np.zeros(0, np.uint64), np.array([0])) == 0).all()


def near_corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(200)], {}
    edit = lambda ws, n: [word() if i in set(rng.sample(range(len(ws)), n)) else w for i, w in enumerate(ws)]
    for i in range(60):  # one large group of near copies around a text
        rows[i] = " ".join(edit(base, 3))
    rows[60] = " ".join(base)
    for i in range(61, 90):  # a chain in which only neighbours are alike
        base = edit(base, 3)
        rows[i] = " ".join(base)
    passage = [word() for _ in range(80)]
    for i in range(90, 130):  # a shared passage does not make texts alike
        rows[i] = " ".join(passage + [word() for _ in range(100)])
    for i in range(130, 140):
        rows[i] = " ".join(word() for _ in range(100))
    rows |= {140: rows[130], 141: rows[130], 142: rows[131].upper(), 143: "one two", 144: "one two", 145: "one  two", 146: None, 147: "", 148: " \n ", 149: None, 150: "tail " * 40_000}
    return rows


def test_minhash_classes_equal_brute_force(spark):
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows.items()}
    alike = [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, t, 0, "clash", 1) for i, t in rows.items()], DOCS + ", bucket int, id string, h int")
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(df).collect()}
    assert got == grouped(alike, rows)
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], DOCS)
    assert sorted(((r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(odd).collect()), key=str) == [(1, 1), (1, 1), (None, None)]
    assert prob_minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_links_do_not_depend_on_occurrences(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = {}
    for k in range(20):  # a line that only one of both texts repeats, in some pairs with other words at the end
        line, rest, tail = ([word() for _ in range(n)] for n in (60, 180, 12))
        rows[2 * k] = "\n".join([" ".join(line)] * 30 + [" ".join(rest)])
        rows[2 * k + 1] = "\n".join([" ".join(line)] * (1 + k % 2) + [" ".join(rest + tail * (k % 3))])
    sets = {i: shingles(t) for i, t in rows.items()}
    alike = [(a, a + 1) for a in range(0, 40, 2) if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])]
    assert len(alike) == 20
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(spark.createDataFrame(list(rows.items()), DOCS)).collect()}
    assert got == grouped(alike, rows)
    h, s = shingle_hashes([t.encode() for t in rows.values()])
    sig = signatures(h, s, weighted=False)
    share = (sig[::2] == sig[1::2]).mean(1)
    want = [len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in range(0, 40, 2)]
    assert np.abs(share - want).max() < 0.15


# Lines


def lines_left(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], DOCS + ", pos int, line string")
    return {(r.doc_id, k): (r.text, r.lines_dropped) for k, r in enumerate(template_dedup.drop_recurring(df).orderBy("doc_id", "text").collect())}


def test_recurring_templates_go_except_in_the_first_document(spark):
    log = lambda n, who: f"user {who} logged in from host {n} at noon today"
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = [f"only document {'abcdefgh'[i]} says this very thing here" for i in range(5)]
    rows = [(i, "\n".join([own[i], log(i, f"n{i}"), "", "Hi.", passage if i > 2 else own[i] + " again"])) for i in range(5)]
    out = lines_left(spark, rows)
    text = {k[0]: v[0].split("\n") for k, v in out.items()}
    assert log(0, "n0") in text[0] and not any(log(i, f"n{i}") in text[i] for i in range(1, 5))
    assert passage in text[3] and passage not in text[4]
    assert all("Hi." in t and "" in t for t in text.values())  # short lines need more occurrences
    assert all(own[i] in text[i] for i in range(1)) and out[0, 0][1] == 0


def masked(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in line.split()]


def open_sets(n):
    if n >= 8:
        return [set()] + [{i, j} for j in range(8) for i in range(j)]
    return [set()] + [{i} for i in range(8)] if n >= 4 else [set()]


def template_of(tokens, open_):
    n = len(tokens)
    inside = [k for i in open_ for k in range(n * i // 8, n * (i + 1) // 8) if k >= 3]
    return tuple(None if k in inside else t for k, t in enumerate(tokens)), tuple(sorted(open_))


def lines_by_brute_force(rows):
    """What must be left: every template of every line, with the documents that have it."""
    having = collections.defaultdict(list)
    for i, text in rows:
        for line in text.split("\n"):
            tokens = masked(line)
            for t in {template_of(tokens, o) for o in open_sets(len(tokens))} if tokens else ():
                having[t].append(i)
    out = {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            tokens, firsts = masked(line), []
            for t in {template_of(tokens, o) for o in open_sets(len(tokens))} if tokens else ():
                docs = having[t]
                constants = sum(x not in (None, "<*>") for x in t[0])
                if min(docs) != max(docs) and (constants >= 5 or len(docs) >= 8):
                    firsts.append(min(docs))
            if not firsts or min(firsts) == i:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    words = "kappa lamda my ny xi pi rho tau".split()
    stock = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 20))) for _ in range(150)]
    stock += [f"user {w} of group {k} did come from the host n{k} at noon" for k, w in enumerate(words)]

    def varied(line):
        tokens = line.split()
        for _ in range(rng.randrange(4)):
            tokens[rng.randrange(len(tokens))] = rng.choice([*words, "7", "new"])
        return " ".join(tokens)

    rows = [(i, "\n".join(varied(rng.choice(stock)) for _ in range(8))) for i in range(60)]
    out = {k[0]: v[0] for k, v in lines_left(spark, rows).items()}
    want = lines_by_brute_force(rows)
    assert out == want and 0.2 < sum(map(len, want.values())) / sum(len(t) for _, t in rows) < 0.9


def test_lines_clashing_columns(spark):
    rows = [(1, "one two three four five six", 5), (2, "one two three four five six", 5)]
    out = template_dedup.drop_recurring(spark.createDataFrame(rows, DOCS + ", lines_dropped int"))
    assert out.columns == ["doc_id", "text", "lines_dropped"] and sorted(map(tuple, out.collect())) == [(1, rows[0][1], 0), (2, "", 1)]
    with pytest.raises(ValueError, match="clash"):
        template_dedup.drop_recurring(spark.createDataFrame(rows, DOCS + ", _dedup_doc int"))


def test_lines_odd_rows(spark):
    long = "\n".join(f"line number {'x' * (i % 50)} of the very long text {i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b  c d\te f\n"), (6, long)]
    out = lines_left(spark, rows)
    assert sorted((str(k[0]), str(v[0])) for k, v in out.items() if k[0] != 6) == sorted(
        [("1", "None"), ("2", ""), ("3", "  \n\t"), ("None", "a b c d e f"), ("4", "a b c d e f"), ("4", "a b c d e f"), ("5", "")]
    )
    assert next(v for k, v in out.items() if k[0] == 6)[0] == long
    assert template_dedup.drop_recurring(spark.createDataFrame([], DOCS)).count() == 0


# Packing


def packed_piece_by_piece(sizes, plan):
    """Best fit with one bin at a time; ``plan`` only says what a new bin would cost."""
    bins, counts = [], collections.Counter(sizes)
    left, free = sum(sizes), 0
    for need in sorted(counts, reverse=True):
        count, new, step = counts[need], 0, None
        for k in range(count):
            fits = [b for b in bins if b[0] - b[1] >= need]
            if not fits:
                step = step or max(1, -(-(count - k) // variable_packing.SIXTEENTH))
                plan.left, plan.free = left, free
                capacity = plan.cheapest(need)
                new = -(-min(step, count - k) // (capacity // need))
                bins += [[capacity, 0] for _ in range(new)]
                free += new * capacity
                fits = bins[-new:]
            best = min(fits, key=lambda b: b[0] - b[1])
            best[1] += need
            left, free = left - need, free - need
    return sorted(c - u for c, u in bins)  # bins with equal free space are ties


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=90))
def test_plan_like_piece_by_piece(sizes):
    plan = Planner(collections.Counter(sizes), (16, 32, 64), 2)
    bins = [(c, u) for _, n, c, u in plan.final for _ in range(n)]
    spans = collections.defaultdict(list)
    for need, at, pieces, first, each, offset in plan.runs:
        for k in range(pieces):
            spans[first + k // each].append((offset + k % each * need, need))
    assert sorted(n for s in spans.values() for _, n in s) == sorted(sizes)
    for b, (capacity, used) in enumerate(bins):  # without gaps, in the least capacity
        at = 0
        for start, n in sorted(spans[b]):
            assert start == at
            at += n
        assert at == used <= capacity and all(c < used for c in (16, 32, 64) if c < capacity)
    assert sorted(space for space, ranges in plan.by_space.items() for _, n, _ in ranges for _ in range(n)) == packed_piece_by_piece(sizes, plan)


def test_plan_near_the_lower_bound():
    rng = random.Random(3)
    sizes = [min(4096, int(rng.lognormvariate(5.5, 1))) + 1 if rng.random() < 0.9 else 4096 for _ in range(5000)]
    plan = Planner(collections.Counter(min(s, 4096) for s in sizes))
    cost = sum(n * (c + 16) for _, n, c, _ in plan.final)
    total = sum(min(s, 4096) for s in sizes)
    assert total + 16 * -(-total // 4096) <= cost <= 1.002 * (total + 16 * -(-total // 4096))


def best_cost(sizes, capacities, overhead):
    """The least cost of any packing, by trying all partitions."""
    def place(i, bins):
        if i == len(sizes):
            return sum(min(c for c in capacities if c >= u) + overhead for u in bins)
        options = [place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :]) for k in range(len(bins)) if bins[k] + sizes[i] <= max(capacities)]
        return min([*options, place(i + 1, [*bins, sizes[i]])])

    return place(0, [])


def test_plan_near_the_optimum_of_small_cases():
    rng = random.Random(8)
    shares = []
    for _ in range(60):
        sizes = [rng.randrange(1, 33) for _ in range(7)]
        plan = Planner(collections.Counter(sizes), (8, 16, 32), 2)
        shares.append(sum(n * (c + 2) for _, n, c, _ in plan.final) / best_cost(sizes, (8, 16, 32), 2))
    assert min(shares) >= 1 and sum(shares) / 60 < 1.08 and max(shares) < 1.5


def test_pack_covers_all_texts(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "y" * 50_000), (4, "y" * 50_000), (None, "é" * 9), (5, "z" * 16_384)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], DOCS + ", piece int, g string")
    out = variable_packing.pack(df).collect()
    chars = collections.Counter()
    for r in out:
        chars[r.doc_id] += r.char_end - r.char_start
        assert r.tokens == -(-(r.char_end - r.char_start) // 4) and r.used <= r.capacity
    assert chars == {3: 1, 4: 100_000, None: 9, 5: 16_384}
    assert variable_packing.pack(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = variable_packing.pack(docs.repartition(5)).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r.token_offset)
        assert [r.token_offset for r in parts] == [sum(x.tokens for x in parts[:i]) for i in range(len(parts))]
        assert sum(r.tokens for r in parts) == parts[0].used <= parts[0].capacity
    assert sum(p[0].used for p in bins.values()) / sum(p[0].capacity for p in bins.values()) > 0.99
    hot = spark.createDataFrame([(None, "x" * 400)] * 500, DOCS)
    assert variable_packing.pack(hot).groupBy("sequence_id").agg(F.sum("tokens").alias("n")).where("n > 4096").count() == 0


# Vectors


def cloud(n=700, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:90] = x[50] + 0.02 * rng.normal(size=(40, d))  # a group of near copies
    x[90:100] = x[90]  # exact copies
    return x.astype(np.float32)


VEC = "vec_id bigint, embedding array<float>, label int, cell int, id string"


def vectors(spark, x, labels):
    odd = [(9001, None, 1, 0, ""), (9002, [0.0] * x.shape[1], 1, 0, ""), (9003, [float("nan")] + [1.0] * (x.shape[1] - 1), 1, 0, ""), (9004, [float("inf")] + [1.0] * (x.shape[1] - 1), 1, 0, ""),
           (9005, [None] + [1.0] * (x.shape[1] - 1), 1, 0, ""), (9006, [1.0, 2.0], 1, 0, ""), (9007, [2.0, 4.0], 1, 0, ""), (9008, [], 1, 0, ""), (9009, x[50].tolist(), None, 0, "")]
    return spark.createDataFrame([(i, v.tolist(), int(lab), 0, "clash") for i, (v, lab) in enumerate(zip(x, labels))] + odd, VEC)


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.normal(scale=1.5, size=(40, 8))
    first, second = decode_e8(x)
    for p in (first, second):
        assert (p.sum(1) % 4 == 0).all() and ((p % 2 == 0).all(1) | (p % 2 != 0).all(1)).all()
    assert ((first % 2 == 0).all(1) != (second % 2 == 0).all(1)).all()
    best = ((x - first / 2) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()  # the covering radius is 1
    roots = [np.array(s) for s in _roots()]
    assert len(roots) == 240
    for r in roots:
        assert (best <= ((x - first / 2 - r) ** 2).sum(1) + 1e-9).all()


def _roots():
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = [0.0] * 8
                    v[i], v[j] = a, b
                    yield v
    for m in range(256):
        signs = [(-1) ** (m >> k & 1) for k in range(8)]
        if np.prod(signs) == 1:
            yield [s / 2 for s in signs]


@pytest.mark.parametrize("block", [2000, 12])
def test_lattice_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    x = cloud()
    labels = np.arange(len(x)) % 2
    labels[50:100] = 0
    labels[55] = 1
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_duplicates(vectors(spark, x, labels)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (labels[:, None] == labels[None]) & ~np.eye(len(x), dtype=bool)
    roots = grouped(list(zip(*np.nonzero(link))), range(len(x)))
    for i in range(len(x)):
        assert out[i] == (link[i].sum(), roots[i], roots[i] == i)
    assert out[9006] == (1, 9006, True) and out[9007] == (1, 9006, False) and len(out) == len(x) + 9
    assert all(out[i] == (0, i, True) for i in (9001, 9002, 9003, 9004, 9005, 9008, 9009))


def test_lattice_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 16)).astype(np.float32)
    x[3] = x[2] + 0.005
    rows = [(i, x[0].tolist(), 1) for i in range(40)] + [(100 + i, x[2].tolist(), 1) for i in range(5)] + [(200 + i, x[3].tolist(), 1) for i in range(3)]
    rows += [(300, x[0].tolist(), 2), (301, x[0].tolist(), None), (400, x[4].tolist(), 1), (400, x[4].tolist(), 1), (401, x[5].tolist(), 1), (401, x[0].tolist(), 3), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = lattice_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert all(got[i] == (39, 0) for i in range(40))  # one group of equal vectors
    assert all(got[i] == (7, 100) for i in [*range(100, 105), *range(200, 203)])  # two that are alike
    assert got[300] == (0, 300) and got[301] == (0, 301) and got[400] == (0, 400) and got[401] == (0, 401) and got[None] == (0, None)


def test_lattice_empty(spark):
    assert lattice_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_forest_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SHARD_ROWS", 300)
    monkeypatch.setattr(prefix_forest, "QUERY_ROWS", 16)
    x = cloud(1200)
    x[::3] *= 2.5  # inner products favour long vectors
    df = vectors(spark, x, np.zeros(len(x)))
    out = collections.defaultdict(list)
    for r in prefix_forest.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score, r["rank"]))
    X = x.astype(np.float64)
    hits = 0
    for q, found in out.items():
        score = X @ X[q]
        score[q] = -np.inf
        top = np.lexsort((np.arange(len(X)), -score))[:10]
        hits += len(set(top.tolist()) & {v for v, _, _ in found})
        assert [r for _, _, r in found] == list(range(1, 11)) and all(abs(s - score[v]) < 1e-12 for v, s, _ in found)
        assert sorted(found, key=lambda f: (-f[1], f[0])) == found
    assert len(out) == 60 and hits / 600 >= 0.9
    # few candidates: all of them, by score and then id
    tiny = spark.createDataFrame([(20, [1.0, 0.0]), (5, [1.0, 1.0]), (4, [1.0, 1.0]), (7, [0.5, 0.0])], "vec_id bigint, embedding array<float>")
    got = prefix_forest.nearest(tiny, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(20, 4), (20, 5), (20, 7)]
    assert prefix_forest.nearest(tiny.limit(0), F.lit(True)).count() == 0


def test_forest_recall_of_vectors_without_clusters(spark):
    """Several shards of isotropic vectors, the hardest case; the shards follow the rows, not the cores."""
    x = np.random.default_rng(12).normal(size=(12_000, 64)).astype(np.float32)
    df = vectors(spark, x, np.zeros(len(x)))
    found = collections.defaultdict(set)
    for r in prefix_forest.nearest(df.repartition(3), F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    X = x.astype(np.float64)
    hits = 0
    for q, got in found.items():
        score = X @ X[q]
        score[q] = -np.inf
        hits += len(got & set(np.argsort(-score)[:20].tolist()))
    assert len(found) == 600 and hits / 12_000 >= 0.9


def test_forest_scores_few_rows_where_vectors_cluster():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(100, 32)), 60, axis=0) + 0.3 * rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = prefix_forest.Forest(x, 64, 48)
    queries = x[::50]
    found = list(forest.candidates(queries, 200))
    top = [set(np.argsort(-(x @ q))[:10].tolist()) for q in queries]
    assert sum(len(t & set(f.tolist())) for t, f in zip(top, found)) >= 0.9 * 10 * len(queries)
    assert all(200 <= len(f) for f in found) and sum(map(len, found)) < 0.1 * len(x) * len(queries)
    assert prefix_forest.share(10**9) < 0.011 < prefix_forest.share(10**5) < prefix_forest.share(2_000) < 0.81
    whole = list(forest.candidates(queries[:3], 10**9))
    assert all(len(f) == len(x) for f in whole)
