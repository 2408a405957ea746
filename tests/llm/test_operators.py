"""Parts of the operators against plain versions."""

from __future__ import annotations

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfcheck.llm import bestfit, bytewords, components, packing, pieces, secret_scan, sharding, simhash, warc


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_runs_equal_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    sizes = sorted((rng.randint(1, capacity + 3) for _ in range(rng.randint(1, 120))), reverse=True)
    rem = []
    for s in sizes:
        fits = [i for i, r in enumerate(rem) if r >= s]
        if fits:
            best = min(fits, key=lambda i: rem[i])
            rem[best] -= s
        else:
            rem.append(capacity - s)
    classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    runs, bins = bestfit.best_fit_runs(classes, capacity)
    load = [0] * bins
    for r in runs:
        for i in range(r.n):
            load[r.first_bin + i // r.per_bin] += r.size
    assert bins == len(rem) and sorted(capacity - x for x in load) == sorted(rem)


def test_balanced_tree_keeps_its_height():
    tree = bestfit.BalancedTree()
    for k in range(1000):
        tree.add(k, k)
    for k in range(0, 1000, 2):
        tree.remove(k)
    assert tree.root.high <= 13 and tree.ceiling(500).key == 501 and tree.ceiling(1000) is None


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 64, 512]))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan, used = packing.packing_plan(counts, capacity)
    spans: dict[int, list] = {}
    for length, n in counts.items():
        own = plan[plan[:, 0] == length]
        for r in range(n):
            row = own[np.searchsorted(own[:, 1], r, "right") - 1]
            past = r - row[1]
            spans.setdefault(int(row[3] + past // row[2]), []).append((int(row[4] + past % row[2] * length), length))
    assert len(spans) == used
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert used <= -(-int(lengths.sum()) // capacity) * 1.15 + 1


def test_shards_with_a_hot_group():
    runs = sharding.near_equal_runs([(1000, 1), (50, 3), (10, 40), (3, 7)], 4)
    load = [0] * 4
    for r in runs:
        for i in range(r.n):
            load[r.first_bin + i // r.per_bin] += r.size
    assert sorted(load)[-1] == 1000 and max(load[1:]) - min(load[1:]) <= 10 and sum(load) == 1571


@pytest.mark.parametrize("text", ["", "A bc", "  x1-y2_é ß z", "wordsö" * 300_000, "a b " * 400_000])
def test_byte_words(text):
    texts = [text, None, "Tail End", ""]
    data, at = bytewords.buffers(pa.array(["skip", *texts]).slice(1))
    starts, ends, hashes = bytewords.word_spans(data, at)
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    want = [w for t in texts for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    assert got == want
    by = dict(zip(hashes.tolist(), (w.lower() for w in got), strict=True))
    assert len(by) == len({w.lower() for w in want})


def test_majority_of_long_runs():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 130_000, dtype=np.uint64) << np.uint64(1)
    at = np.array([0, 0, 3, 125_000, 130_000])
    got = simhash.majority(h, at)
    for k in range(4):
        part = h[at[k] : at[k + 1]]
        want = sum(1 << b for b in range(64) if 2 * int((part >> np.uint64(b) & np.uint64(1)).sum()) > len(part))
        assert int(got[k]) == want


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    linked = rng.random((60, 70)) < 0.05
    linked[:20, :20] = True
    edges = simhash.forest(linked)
    assert len(edges) < 130

    def groups(pairs):
        parent = list(range(130))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in pairs:
            parent[root(i)] = root(60 + j)
        return [root(x) for x in range(130)]

    a, b = groups(zip(*np.nonzero(linked), strict=True)), groups(edges)
    assert len(set(a)) == len(set(b)) and len(set(zip(a, b, strict=True))) == len(set(a))


@pytest.mark.parametrize("blocks", [2, 4, 8])
def test_simhash_links_of_near_fingerprints(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    monkeypatch.setattr(simhash, "CHUNK", 40)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(200)]
    prints = set(base)
    for x in base[:80]:
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            prints.add(y)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    prints = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp long")
    found = {r.node: r.root for r in components.star_components(simhash.links(df)).collect()}
    parent = {x: x for (x,) in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                a, b = root(signed[i][0]), root(signed[j][0])
                parent[max(a, b)] = min(a, b)
    assert {x: found.get(x, x) for (x,) in signed} == {x: root(x) for (x,) in signed}


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 400)] + [(7, 7)]
    got = {r.node: r.root for r in components.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 for x in range(61)} | {x: 100 for x in range(100, 400)}


def test_archive_round_trip():
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", ("<p>" + "row " * rng.randint(0, 400) + str(rng.random())).encode()) for i in range(300)]
    out = io.BytesIO()
    n, size = warc.write_archive(out, iter([warc.page_record(i, u, p, None, True, "2026-01-01T00:00:00Z") for i, u, p in pages]), "2026-01-01T00:00:00Z")
    assert n == 300 and size == len(out.getvalue()) < sum(len(p) for _, _, p in pages) / 2
    out.seek(0)
    info, *read = list(warc.read_archive(out))
    assert info[0]["WARC-Type"] == "warcinfo"
    assert [(int(f["X-Page-ID"]), b.partition(b"\r\n\r\n")[2]) for f, b in read] == [(i, p) for i, _, p in pages]


def test_lexer_pairs_and_constants():
    text = 'a = "x1y2z3w4"\nb: str\nkey_part = a + "tail9Q"\nfoo(auth_token=key_part, n=3)\nx = x + x'
    found = {n: v for n, v, _ in secret_scan.pairs(text)}
    assert found["auth_token"] == "x1y2z3w4tail9Q" and found["n"] == "3"
    grown = "x = aaaaaaaa\n" + "x = x + x\n" * 60
    assert max(len(v) for _, v, _ in secret_scan.pairs(grown)) <= 2 * secret_scan.LONGEST
    assert secret_scan.redact('db_password: "s3cr3tPa55"') == 'db_[REDACTED]"'
    assert secret_scan.redact(None) is None and secret_scan.redact("plain words") == "plain words"


def test_lexing_does_not_depend_on_the_prefilter(monkeypatch):
    words = sorted(secret_scan.NAME_WEIGHTS)
    texts = [f'{a}_{b} = "aB3dE5gH9kLm"' for a in words for b in words] + [f'{a}: "aB3dE5gH9kLm-+/xyz"' for a in words]
    found = [secret_scan.lexed_spans(t, []) for t in texts]
    monkeypatch.setattr(secret_scan, "_HINT", re.compile(""))
    assert found == [secret_scan.lexed_spans(t, []) for t in texts]
    assert secret_scan.redact('api_pass = "aB3dE5gH9kLm"') == 'api_pass = "[REDACTED]"'


@pytest.mark.parametrize("line", [
    'config["db_passphrase"] = "{}"', 'os.environ["CLIENT_SECRET"] = "{}"', "$config['db']['client_secret'] = '{}';", 'a[CLIENT_SECRET] = "{}"',
    'config["client_secret"].value = "{}"', 'config["db_passphrase"]: str = "{}"', 'char client_secret[32] = "{}";', '{{[CLIENT_SECRET]: "{}"}}',
    'client_secret: str = "{}"', 'def f(a, client_passphrase: Optional[str] = "{}", n: int = 3):', 'clientSecret?: string | null = "{}";',
    'private readonly clientSecret: Map<string, string> = "{}";', 'const CLIENT_SECRET: &str = "{}";', "static CLIENT_SECRET: &'static str = \"{}\"; // don't",
    'var authToken string = "{}"', 'const (\n\tauthToken string = "{}"\n)', 'var clientSecret *pkg.Text = "{}"', 'var clientSecret []byte = "{}"',
    'String clientPassphrase = "{}";', 'else: passphrase = "{}"', 'cfg["k"] = "{}"\nclient_secret = cfg["k"]', 'var k string = "{}"\npassphrase = k',
    'k: str = "{}"\npassphrase: str = k', 'if ready: k = "{}"\npassphrase = k',
])
def test_targets_with_subscripts_and_types(line):
    text, want = line.format("aB3dE5gH9kLm"), line.format("[REDACTED]")
    assert secret_scan.redact(text) == want


@pytest.mark.parametrize("text", [
    'if secret: y = "aB3dE5gH9kLm"', 'name: str = "aB3dE5gH9kLm"\npassword: str\n', 'if k in ["password", "token"]: continue_processing()',
    'x[0] = "aB3dE5gH9kLm"', '<input type=password id="aB3dE5gH9kLm">', 'client_secret: SecretString = "short"',
])
def test_neighbours_that_are_no_targets(text):
    assert secret_scan.lexed_spans(text, []) == []


def test_long_constants_are_propagated():
    rng = random.Random(5)
    long, tail = ("".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789+/", k=n)) for n in (6000, 3000))
    assert secret_scan.redact(f'blob = "{long}"; private_key = blob') == 'blob = "[REDACTED]"; private_key = blob'
    text = f'a = "{tail}"\nb = a + "{long}"\nc = b + a\nprivate_key = c'
    assert secret_scan.redact(text) == 'a = "[REDACTED]"\nb = a + "[REDACTED]"\nc = b + a\nprivate_key = c'
    grown = 'x = "aB3dE5gH9kLm"\n' + "x = x + x\n" * 5000 + "passphrase = x"
    assert secret_scan.redact(grown).startswith('x = "[REDACTED]"\nx = x + x\n')
    many = "x = aB3dE5gH9kLm\n" + "x = x + aB3dE5gH9kLm\n" * 3000 + "passphrase = x"
    assert len(secret_scan.lexed_spans(many, [])) == 3001
    # joined or whole, a value has the same score
    joined = secret_scan.Value(tail, len(tail), (0, 1)) + secret_scan.Value(long, len(long), (1, 2))
    assert secret_scan._score("private_key", joined.counts, joined.length) == secret_scan.literal_score("private_key", tail + long)


def test_triples_beyond_many_longer_lengths():
    # 2000 + 700 + 698 + 698 = 4096; the other lengths are in no combination, and more than 64 are longer than each of these
    counts = {2000: 1, 700: 1, 698: 2, **dict.fromkeys([*range(1400, 1500), *range(2101, 2181)], 1)}
    plan, _ = packing.packing_plan(counts, 4096)
    assert len({int(row[3]) for row in plan if row[0] in (2000, 700, 698)}) == 1


@pytest.mark.parametrize("seed", range(40))
def test_complements_against_all_combinations(seed):
    from itertools import combinations_with_replacement

    rng = random.Random(seed)
    capacity = rng.choice([12, 40])
    counts = {x: rng.choice([0, 0, 1, 1, 2, 3]) for x in range(1, capacity)}
    free = packing._Free(counts, capacity)
    for gap in range(1, capacity):
        there = [c for k in (1, 2, 3) for c in combinations_with_replacement(range(1, gap + 1), k)
                 if sum(c) == gap and all(counts[x] >= c.count(x) for x in c)]
        got = free.complement(gap, capacity)
        assert (got is None) == (not there) and (got is None or len(got) == len(there[0]) and tuple(sorted(got)) in there)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_plain_words_and_line_breaks_need_no_library_call(name, monkeypatch):
    """New pieces of plain words, also two around a line break, have the library's ids without a call of the whole library."""
    import public_tokenizers

    rng, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJéÀÿßñÖ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "!?"])
    texts = [" ".join(word() + rng.choice(["", "", "\n" + word()]) for _ in range(40)) for _ in range(60)]
    encoder = pieces.PieceEncoder(public_tokenizers.path(name), most=50)
    want = encoder._encode(texts + ["a\n\nb", "a \nb", "\na", "a\n", "x.\n y", "a\u0301\nb", "don't\nI'm", "a1\nb"])
    assert [encoder.ids(t) for t in texts + ["a\n\nb", "a \nb", "\na", "a\n", "x.\n y", "a\u0301\nb", "don't\nI'm", "a1\nb"]] == want
    monkeypatch.setattr(encoder, "_encode", lambda _: pytest.fail("the whole library was called"))
    assert [encoder.ids(t) for t in texts] == want[: len(texts)]
