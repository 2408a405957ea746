"""Every registered query of the subpackage against a brute-force version on a small corpus."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from shelfcheck.llm import queries as q

pytestmark = pytest.mark.filterwarnings("ignore")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def read(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows(spark, folder, name):
    return [r.asDict() for r in q.QUERIES[name](spark, folder).collect()]


def counted(found):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in found)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows(spark, empty, name) == []


def test_op1_shards(spark, corpus):
    docs, found = read(corpus, "documents"), rows(spark, corpus, "op1_best_fit_shards")
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d["doc_id"], size(d["text"]), zlib.crc32((d["text"] or "").encode())) for d in docs)
    homes, slots, total = defaultdict(set), defaultdict(list), Counter()
    for r in found:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in homes.values()) and set(slots) <= set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    # two texts are larger than an equal share; the other six shards are near equal
    rest = sorted(total.values())[:6]
    assert rest[-1] - rest[0] <= 200
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_op2_licenses(spark, corpus):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for d in read(corpus, "documents"):
        w = words(d["text"])
        hits = [(k, v) for p, v in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in hits]
        want.append({"doc_id": d["doc_id"], "n_words": len(w), "n_base": len(hits), "first_word": min(starts, default=None),
                     "last_word": max(starts, default=None), "base_labels": ",".join(sorted({v for _, v in hits}))})
    found = rows(spark, corpus, "op2_diagonal_licenses")
    assert counted([{k: r[k] for k in want[0]} for r in found]) == counted(want)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in found)
    assert next(r["labels"] for r in found if r["doc_id"] == 28) == "apache,apache-2.0,mit"


def test_op3_quality(spark, corpus):
    found = rows(spark, corpus, "op3_byte_cnn_quality")
    assert Counter(r["doc_id"] for r in found) == Counter(d["doc_id"] for d in read(corpus, "documents"))
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None]
    assert all(r["predicted"] == 0 for r in held if r["doc_id"] >= 1000)
    good = [r["predicted"] for r in held if r["doc_id"] % 3 == 0 and r["doc_id"] < 300]
    assert sum(good) >= 0.9 * len(good)


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4_simhash(spark, corpus):
    docs = read(corpus, "documents")
    prints = [simhash(d["text"]) for d in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[root(i)].append(d["doc_id"])
    want = [{"doc_id": d["doc_id"], "fingerprint": f"{prints[i]:016x}", "component_id": min(least[root(i)], default=None)} for i, d in enumerate(docs)]
    assert counted(rows(spark, corpus, "op4_simhash_tiles")) == counted(want)


def test_op5_decontamination(spark, corpus):
    windows = defaultdict(set)
    for b in read(corpus, "benchmark"):
        w = words(b["text"])
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(b["item_id"]))
    want = []
    for d in read(corpus, "documents"):
        w, hit, items = words(d["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= got
        want.append({"doc_id": d["doc_id"], "n_words": len(w), "n_hit": len(hit), "n_items": len(items),
                     "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                     "contaminated": len(hit) > 0 and 20 * len(hit) >= len(w)})
    assert counted(rows(spark, corpus, "op5_winnowing_decontamination")) == counted(want)
    assert sum(r["contaminated"] for r in want) >= 4


def library_ids(name, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op6_packing(spark, corpus):
    want = Counter()
    for d in read(corpus, "documents"):
        ids = [*library_ids("word_bpe_49k.json", d["text"]), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d["doc_id"], k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])] += 1
    found = rows(spark, corpus, "op6_best_fit_packing")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= -(-sum(r["length"] for r in found) // 4096) + 1


def test_op7_secrets(spark, corpus):
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for d in read(corpus, "documents"):
        t = d["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        want.append({"doc_id": d["doc_id"], "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(said.encode()).hexdigest()})
    found = rows(spark, corpus, "op7_assignment_secrets")
    assert counted([{k: r[k] for k in want[0]} for r in found]) == counted(want)
    text = next(d["text"] for d in read(corpus, "documents") if d["doc_id"] == 25)
    spans = next(r["spans"] for r in found if r["doc_id"] == 25)
    assert any(text[int(a) : int(b)] == "q8ZkP0wXv3Lm9" for k, a, b in (s.split(":") for s in spans.split(",")) if k == "lexed")


def test_op8_warc(spark, corpus):
    pages = read(corpus, "pages")
    largest: dict = {}
    for p in pages:
        html = p["html"] or ""
        if p["page_id"] is not None:
            largest[html] = max(largest.get(html, -1), p["page_id"])
    want = []
    for p in pages:
        data = (p["html"] or "").encode()
        first = largest.get(p["html"] or "")
        whole = p["page_id"] == first
        want.append({"page_id": p["page_id"], "payload_bytes": len(data), "payload_digest": base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "record_type": "response" if whole else "revisit", "refers_to": None if whole else first})
    assert counted(rows(spark, corpus, "op8_dictionary_warc")) == counted(want)


def test_op9_fingerprints(spark, corpus):
    docs = [(d["doc_id"], d["text"] or "") for d in read(corpus, "documents")]
    found = rows(spark, corpus, "op9_imatch_fingerprints")
    ids = Counter(i for i, _ in docs)
    ordered = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    want = {}
    for k, (i, t) in enumerate(ordered):
        after, n = ordered[(k + 1) % len(ordered)], len(t) // 4
        if ids[i] == 1 and ids[after[0]] == 1:
            want[i] = (len(t), hashlib.sha256((t[: len(t) - n] + after[1][:n]).encode()).hexdigest())
    assert len(found) == len(docs) and len(want) > 100
    by_text = defaultdict(set)
    texts = dict(docs)
    for r in found:
        if r["doc_id"] in want:
            assert (r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]]
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    # the corpus here has few words, so that few are rare enough for the lexicon
    assert np.mean([r["near_edited"] for r in found]) > 2 * np.mean([r["near_next"] for r in found])
    repeated = [r for r in found if r["doc_id"] == 7]
    assert len(repeated) == 2 and max(r["near_next"] for r in repeated) == 1


def test_op10_token_files(spark, corpus):
    found = sorted(rows(spark, corpus, "op10_token_files"), key=lambda r: r["start"])
    docs = Counter()
    for d in read(corpus, "documents"):
        ids = [*library_ids("byte_bpe_50k.json", d["text"]), 2]
        docs[d["doc_id"], len(ids), crc(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == docs
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert order == sorted(order)


def four_word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def linked_components(ids, sets, per_cent=80):
    """(size, component, kept) of each row, by comparing every pair of sets."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)].append(k)
    out = []
    for i, k in enumerate(ids):
        component = (min(least[root(i)], default=None)) if sets[i] else k
        out.append({"doc_id": k, "n_shingles": len(sets[i]), "component_id": component, "kept": k == component})
    return out


def test_op11_near_dedup(spark, corpus):
    docs = read(corpus, "documents")
    want = linked_components([d["doc_id"] for d in docs], [four_word_set(d["text"]) for d in docs])
    assert counted(rows(spark, corpus, "op11_odd_sketch_near_dedup")) == counted(want)
    assert len({r["component_id"] for r in want}) < len(want) - 5


def test_op12_whitening(spark, corpus):
    good = []
    for r in read(corpus, "embeddings"):
        v = r["embedding"]
        if v and len(v) == 12 and all(c is not None and np.isfinite(c) and abs(c) < 1e12 for c in v):
            good.append((r["vec_id"], [int(np.floor(1024 * float(c))) + 100_000 for c in v]))
    n, x = len(good), np.array([v for _, v in good], object)
    sums = x.sum(0)
    y = ((n * x - sums) / n).astype(np.float64)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    found = rows(spark, corpus, "op12_refined_whitening")
    assert len(found) == 8 * n and {r["n"] for r in found} == {n}
    deviations = Counter((i, sum(int(a) ** 2 for a in n * v - sums)) for (i, _), v in zip(good, x, strict=True))
    assert Counter((r["vec_id"], r["deviation"]) for r in found) == Counter({k: 8 * c for k, c in deviations.items()})
    white = y @ (vectors / np.sqrt(values))
    for k in range(8):
        got = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["whitened"]) for r in found if r["component"] == k + 1)
        want = [sorted((i is not None, i or 0, s * w) for (i, _), w in zip(good, white[:, k], strict=True)) for s in (1, -1)]
        assert min(max(abs(a[2] - b[2]) for a, b in zip(got, w, strict=True)) for w in want) < 1e-9
    assert max(abs(r["explained"] - values[r["component"] - 1] / np.trace(y.T @ y / n)) for r in found) < 1e-12
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-10


def test_op13_fill_in_middle(spark, corpus):
    want = []
    for d in read(corpus, "documents"):
        text = d["text"] or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"7:{'' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>"))
        form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
        out = text if plain else f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
        want.append({"doc_id": d["doc_id"], "n": len(units), "form": form, "prefix_chars": None if plain else len(pre), "middle_chars": None if plain else len(mid),
                     "output_sha256": hashlib.sha256(out.encode()).hexdigest(), "restored_sha256": hashlib.sha256(text.encode()).hexdigest()})
    assert counted(rows(spark, corpus, "op13_skip_list_fim")) == counted(want)
    assert {r["form"] for r in want} == {"plain", "psm", "spm"}
