"""The pipeline stage by stage on the small corpus."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline as pipeline

from shelfcheck.llm import secret_scan, simhash

from .test_queries import LOWER, linked_components, read, rows


def five_word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, folder)
        out.append((before, docs.columns, docs.collect()))
        docs = spark.createDataFrame(out[-1][2], docs.schema)
    return out


def test_each_stage_acts_on_what_is_left(spark, corpus):
    found = stages(spark, corpus)
    assert all(a == b for a, b, _ in found[:-1])
    ids = [[r.doc_id for r in x] for _, _, x in found]
    scored = {r["doc_id"]: r["predicted"] for r in rows(spark, corpus, "op3_byte_cnn_quality")}
    assert sorted(map(str, ids[0])) == sorted(str(d["doc_id"]) for d in read(corpus, "documents") if scored[d["doc_id"]])
    sets = [five_word_set(r.text) for r in found[0][2]]
    parts = linked_components(ids[0], [s or frozenset([()]) for s in sets])
    left = {p["component_id"] for p in parts if p["component_id"] is not None}
    assert sorted(i for i in ids[1] if i is not None) == sorted(left) and len(ids[1]) == len(set(ids[1])) < len(ids[0]) - 3
    bad = {r["doc_id"] for r in rows(spark, corpus, "op5_winnowing_decontamination") if r["contaminated"]}
    assert set(ids[2]) == set(ids[1]) - bad and bad & set(ids[1])
    assert ids[3] and sorted(map(str, ids[3])) == sorted(map(str, ids[2]))
    before = {r.doc_id: r.text for r in found[2][2]}
    for r in found[3][2]:
        assert r.text == secret_scan.redact(before[r.doc_id]) and (r.text is None or r.n_chars == len(r.text))
    assert set(ids[4]) == set(ids[3])


def test_run_gives_the_same_pieces(spark, corpus, empty):
    pieces = sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in pipeline.run(spark, corpus).collect())
    assert pieces == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in stages(spark, corpus)[-1][2])
    assert pipeline.run(spark, empty).count() == 0


def test_near_duplicate_recall_by_similarity(spark):
    """Edited copies in bands of similarity: at least 0.9 of the pairs at 0.8 and above are found, and none below is."""
    rng, words = random.Random(21), [f"w{int(k)}" for k in range(4000)]
    docs, pairs, similarity = [], [], {}
    for i in range(900):
        text = [words[min(3999, int(rng.paretovariate(0.5)))] for _ in range(rng.randint(60, 500))]
        copy = list(text)
        for _ in range(max(1, int(len(text) * rng.uniform(0.002, 0.03)))):
            at, kind = rng.randrange(len(copy)), rng.random()
            if kind < 0.6:
                copy[at] = rng.choice(words)
            elif kind < 0.8:
                del copy[at]
            else:
                copy.insert(at, rng.choice(words))
        a, b = five_word_set(" ".join(text)), five_word_set(" ".join(copy))
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
        similarity[i] = len(a & b) / len(a | b)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}
    met, all_ = Counter(), Counter()
    for i, s in similarity.items():
        band = int(s * 20) / 20
        all_[band] += 1
        met[band] += group[2 * i + 1] == 2 * i
        assert s >= 0.8 or group[2 * i + 1] == 2 * i + 1
    print({b: (met[b], n) for b, n in sorted(all_.items())})
    assert all(met[b] >= 0.9 * n for b, n in all_.items() if b >= 0.8) and min(all_[b] for b in (0.8, 0.85, 0.9, 0.95)) > 50
    assert len(simhash.one_of_similar(frame).collect()) == len(set(group.values()))
