"""Centroids, spelling variants and packing against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sessionloom.llm import centroids, packing, spelling

# -- centroids


def brute_centroids(rows, k, rounds):
    """rows(vec_id, ints) -> sorted (vec_id, cluster, distance), centroids; plain Python integers."""
    h = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    c = [list(r[1]) for r in sorted(rows, key=h)[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x: min(range(len(c)), key=lambda j: (d2(x, c[j]), j))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, x in rows:
            held[nearest(x)].append(x)
        for j, xs in held.items():
            c[j] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, nearest(x)) for i, x in rows]
    return sorted(((-1 if i is None else i, j, d2(x, c[j])) for (i, j), (_, x) in zip(out, rows)), key=str), c


def vectors(rng, n, d, spread=0.5):
    return [(i, [rng.choice((-1, 0, 1)) * 0.25 + rng.gauss(0, spread) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.5, 0.01])
def test_centroids_equal_plain_assignment(spark, spread):
    rng = random.Random(3)
    rows = vectors(rng, 300, 6, spread)
    rows += [rows[4], rows[5], (None, rows[6][1]), (1000, [0.0] * 6), (1001, [0.0] * 6)]  # repeated rows, a null id, ties
    bad = [(2000, None), (2001, [1.0] * 5), (2002, [1.0] * 5 + [None]), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got, c = centroids.clusters(df, k=9, rounds=4, components=6)
    want, final = brute_centroids([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows], 9, 4)
    assert sorted(((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=str) == want
    assert c.tolist() == final


def test_centroids_measure_less_than_all(spark):
    rows = [(i, [float(i % 4) * 50 + random.Random(i).random() for _ in range(4)]) for i in range(400)]
    got, _ = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=8, rounds=5, components=4)
    assert got.agg({"n_exact": "avg"}).first()[0] < 0.6 * 8 * 6


def test_bounds_use_the_norm_of_the_whole_displacement():
    """A centroid that came back to where it was doesn't loosen a bound."""
    a, b = np.array([[0, 0], [100, 0]], np.int64), np.array([[0, 0], [130, 40]], np.int64)
    moved = centroids.displacement([a, b, a])
    assert moved[0].tolist() == [0, 0] and moved[2].tolist() == [0, 0]
    assert moved[1][1] == pytest.approx(50)


def test_centroids_large_components_are_exact():
    x = np.array([[centroids.MOST - 1] * 64, [1 - centroids.MOST] * 64], np.int32)
    c = np.array([[0] * 64, [centroids.MOST - 1] * 64], np.int64)
    want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(r, s)) for s in c] for r in x]
    assert want[1][1] < 1 << 63
    assert centroids.all_squared(x, c).tolist() == want


def test_centroids_few_and_none(spark):
    three = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    out = centroids.described(*centroids.clusters(three))
    assert sorted((r["vec_id"], r["distance"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 0)]
    none = three.where("vec_id > 5")
    assert centroids.described(*centroids.clusters(none)).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark.createDataFrame([(1, [1e7] * 64)], "vec_id long, embedding array<double>"))


# -- spelling variants


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        low = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).decode()
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    links = {w: [v for v in n if v != w and near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in links.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(links[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 3000, "x" * 3001, "Réservé", "RÉservé"]
    rows = []
    for i in range(80):
        out = []
        for w in rng.choices(base, [1 + 60 * (k % 7 == 0) for k in range(len(base))], k=60):
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "b" + w[k + 1 :]))
            out.append(w)
        out += ["kettenwort"] * 10 + ["kettenwert"] * (i % 2) + ["kettewert"] * (i % 30 == 0)  # a chain of forms
        rows.append((i, rng.choice((" ", ", ", "1")).join(out)))
    return [*rows, rows[3], (None, rows[4][1]), (500, None), (501, ""), (502, " ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ ")]


@pytest.mark.parametrize("most", [4096, 2])
def test_spelling_variants(spark, spelled, most):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in spelled], "doc_id long, text string, n int, word string").repartition(3)
    got = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(docs, most=most).collect()]
    want = brute_variants(brute_words(spelled))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[3] for r in want) and any(r[5] not in (r[0], r[3]) for r in want)


def test_spelling_blocks_are_cut(spark):
    """One beginning that most words have: no block keeps over ``most`` words while its window can be cut."""
    words = [("gleiche" + "".join(random.Random(i).choices("abcdefgh", k=6)), 2) for i in range(3000)]
    b = spelling.blocks(spark.createDataFrame(list(set(words)), "word string, n long"), most=50)
    sizes = b.groupBy("key", "m", "lo", "hi").count()
    assert sizes.where("count > 50 and m - lo - hi > 1").count() == 0
    pairs = spelling.near_pairs(b)
    got = {(r["word"], r["near"]) for r in pairs.collect()}
    ws = [w for w, _ in set(words)]
    by = defaultdict(set)
    for w in ws:
        for k in range(len(w)):
            by[w[:k], w[k + 1 :]].add(w)
    assert pairs.count() == len(got)
    assert got == {(a, c) for g in by.values() for a in g for c in g if a != c}


def test_spelling_sql(spark, spelled):
    documents = duckdb.connect()
    documents.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    documents.executemany("INSERT INTO documents VALUES (?, ?)", spelled)
    got = set(documents.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({spelling.ORACLE})").fetchall())
    assert got == brute_variants(brute_words(spelled))


def test_spelling_empty(spark, empty):
    assert spelling.variants(empty).collect() == []


# -- packing


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_packing_ids_are_the_librarys(rows):
    odd = ["İstanbul it's don't a.'s x,́y <|endoftext|> ΑΣ. Σ'll ﬁ x　y  \t\n z", "é.cole é!", "á.b", "x" * 30000, "'s 've '", "1,2 3.a.b;c", "\x00\x01 \x85 a", "가각 각"]
    texts = [r[1] for r in rows] + odd
    own = packing.WordIds(packing.VOCABULARY)
    assert [[*x.tolist(), 1] for x in own.encode(texts)] == library_ids(texts)
    own.chars = packing.REMEMBERED_CHARS + 1  # starts anew
    assert [[*x.tolist(), 1] for x in own.encode(texts)] == library_ids(texts)


def test_words_of_letters_are_encoded_together():
    words = [f"{a}{b}{c}" for a in ("Wor", "tele", "gr", "ña") for b in ("ba", "ÉT", "mis", "ou", "x") for c in ("n", "ing", "ades", "", "zzz", "ß")]
    odd = ["İzmir", "ΑΣ", "ﬁn", "\u0958", "abc'sd", "x1y"]  # letters that become more than one pre-token, or are none
    own, sent = packing.WordIds(packing.VOCABULARY), []
    tokenizer = own.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            sent.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **options)

    own.tokenizer = Counted()
    assert [[*x.tolist(), 1] for x in own.encode([" ".join(words)])] == library_ids([" ".join(words)])
    assert sum(sent) == -(-len(words) // packing.TOGETHER)
    texts = [" ".join([*words[:7], x, "more" * k, x + "a"]) for k, x in enumerate(odd)]
    assert [[*x.tolist(), 1] for x in own.encode(texts)] == library_ids(texts)


def check_packing(got, want, most):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


@pytest.mark.parametrize("group", [packing.GROUP, 7])
def test_packing(spark, rows, docs, clashing, group):
    most, want, total = 512, Counter(), 0
    for r, ids in zip(rows, library_ids([r[1] for r in rows])):
        total += len(ids)
        for j in range(0, len(ids), most):
            want[r[0], j // most, j, len(ids[j : j + most]), zlib.crc32(np.array(ids[j : j + most], "<u4").tobytes())] += 1
    for d in (docs, clashing) if group > 7 else (docs,):
        p = packing.stored(packing.pieces(d, most=most), "pieces")
        n = check_packing(packing.packed(p, most, group).collect(), want, most)
        assert n <= -(-total // most) + (3 if group > 7 else 8)


def test_sequences_hold_the_ids(spark, rows, docs):
    got = packing.sequences(docs, most=512).collect()
    ids = {(r[0], tuple(x)) for r, x in zip(rows, library_ids([r[1] for r in rows]))}
    found = defaultdict(dict)
    for s in got:
        flat = np.frombuffer(s["ids"], "<u4").tolist()
        assert len(flat) == s["n_tokens"] <= 512
        for p in s["pieces"]:
            found[p["doc_id"]].setdefault(p["start"], []).append(flat[p["offset"] : p["offset"] + p["length"]])
    whole = {(i, tuple(t for k in sorted(parts) for t in parts[k][0])) for i, parts in found.items()}
    assert whole == ids


def test_search_beats_best_fit():
    rng = random.Random(2)
    sizes = [rng.randint(600, 1500) for _ in range(800)]
    plain = packing.best_fit(sizes, 4096)
    better = packing.packed_group(sizes, 4096)
    assert sorted(i for b in better for i in b) == list(range(800))
    assert all(sum(sizes[i] for i in b) <= 4096 for b in better)
    assert -(-sum(sizes) // 4096) <= len(better) < len(plain)


@pytest.mark.parametrize(("bins", "most"), [([[6, 3], [5, 4]], 10), ([[7, 2], [4, 4]], 10), ([[5, 4], [6, 2], [1]], 10), ([[4], [5]], 10)])
def test_exchanges_raise_the_squared_fill(bins, most):
    sizes = [s for b in bins for s in b]
    at = iter(range(len(sizes)))
    s = packing.Search([[next(at) for _ in b] for b in bins], sizes, most)
    fill = lambda: sum((most - r) ** 2 for r in s.room)
    before = fill()
    donor = max(range(len(bins)), key=lambda k: s.room[k])
    s._leave(donor)
    best = s.exchange(donor)
    if best:
        s.apply(donor, *best[1:])
        assert fill() == before + best[0]
    assert sorted(i for b in s.bins for i in b) == list(range(len(sizes)))


def test_packing_empty(spark, empty):
    assert packing.packed(packing.stored(packing.pieces(empty), "pieces")).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    got = packing.packed(packing.stored(packing.pieces(blank), "pieces")).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(1, 1), (2, 1), (2, 1)] and len({r["sequence_id"] for r in got}) == 1
