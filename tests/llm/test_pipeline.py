"""The pipeline against a brute-force version of its stages after the classifier."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, prose
from test_ten_operators import brute_fingerprint, brute_removed, grouped

from sessionloom.llm import bpe, suffix_dedup

pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables(spark, path):
    rng = random.Random(12)
    passage = prose(rng, 110)
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, rng.choice([30, 120, 260]))
        if i % 8 == 0:
            w = text.split()
            for k in rng.sample(range(len(w)), 4):
                w[k] = "grumpo" + rng.choice("abcdef") + "x"
            text = " ".join(w)
        rows.append((i, text, "en", f"src{i % 4}" if i % 9 else None, len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    for k in range(4):
        rows.append((300 + k, rows[1][1], "en", "src1", len(rows[1][1])))
        text = f"{prose(rng, 20)} {passage} {prose(rng, 20 + k)}"
        rows.append((310 + k, text, "en", "src2", len(text)))
    rows += [(400, "", "en", "src0", 0), (401, "é" * 450, "en", "src3", 450)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def brute(rows):
    rows = [r for r in rows if "grumpo" not in r[1]]
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    ids = sorted(fps)
    group = grouped(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    rows = [r for r in rows if group[r[0]] == r[0]]
    data = [r[1].encode() for r in rows]
    length = suffix_dedup.PASSAGE
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    texts = {}
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        texts[r[0]] = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore")
    size = {i: len(WORD.findall(x)) for i, x in texts.items()}
    source = {r[0]: r[3] for r in rows}
    per = Counter()
    for i, s in source.items():
        per[s] += size[i]
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(per.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * per[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * per[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    c, out = bpe.codec(*bpe.default_vocabulary()), Counter()
    for i, x in texts.items():
        rate = target[source[i]] / per[source[i]]
        draw = int(hashlib.md5(f"{i}|{hashlib.md5(x.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 16**12
        times = math.floor(rate) + (draw < rate - math.floor(rate))
        if times:
            out[i, bytes(next(c.encode([x]))), hashlib.sha256(x.encode()).hexdigest()] += times
    return out


def test_pipeline(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_brute_force_of_removal_agrees_with_itself():
    assert brute_removed(["a" * 500, None], 400)[0][1] == 500


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_bear_odd_rows(spark, tmp_path):
    """Null texts, ids, sources and labels, repeated rows and columns named like the operators' own: what each stage gives is stated."""
    rng = random.Random(3)
    body = [prose(rng, 120) for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", 7) for i, t in enumerate(body)]
    odd = [(10, None, "en", "s0", None), (11, "", "en", None, 0), (None, prose(rng, 90), "en", "s1", 7), rows[2], rows[2]]
    extra = "size string, fp string, features string, score string, gram string, _size string, label string, root string"
    docs = spark.createDataFrame([(*r, *["x"] * 8) for r in rows + odd], f"{SCHEMA}, {extra}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, None), (1, 1, 0), (None, 0, 1), (3, 1, 2), (4, 1, -1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        at[name] = d.collect()
        if name != pipeline.STAGES[-1][0]:
            assert d.columns == docs.columns, name
    ids = lambda name: Counter(r["doc_id"] for r in at[name])
    assert len(at["toxicity"]) == len(rows) + len(odd), "too few labels of a kind: every document stays"
    assert ids("simhash_near_dedup") == Counter([*range(6), 10, None]), "repeated rows are one; the null text and the empty one have one fingerprint, the lesser id stays"
    assert ids("suffix_array_dedup") == ids("simhash_near_dedup")
    assert set(ids("source_mixing")) <= {*range(6), 10, None}, "a text without words is taken at its source's rate"
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in at["byte_level_bpe"]) and len(at["byte_level_bpe"]) == len(at["source_mixing"])
