"""Parts of the near-duplicate search, the whitening and the fill-in-the-middle operator against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from shelfcheck.llm import fim, oddsketch, secret_scan, simhash, whitening

from .test_queries import counted, four_word_set, linked_components


def runs_of(sets):
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    return oddsketch.minhashes(flat, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64))


def test_minhashes_do_not_depend_on_the_runs_beside():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 3, 9000, 2, 40_000, 5, 8191, 8192, 8193, 1)]
    together = runs_of(sets)
    for k, s in enumerate(sets):
        plain = (((s >> np.uint64(32)).astype(np.uint32)[None, :] ^ oddsketch._FLIP[:, None]) * oddsketch._TIMES[:, None]).min(1)
        assert (together[:, k] == plain).all()


@pytest.mark.parametrize("jaccard", [0.7, 0.8, 0.9, 0.97])
def test_odd_sketches_estimate_similarities(jaccard):
    rng = np.random.default_rng(int(100 * jaccard))
    both, found, met = 400, [], 0
    own = round(both * (1 - jaccard) / jaccard / 2)
    for _ in range(200):
        pool = rng.integers(0, 1 << 64, both + 2 * own, dtype=np.uint64)
        samples = runs_of([pool[: both + own], np.concatenate([pool[:both], pool[both + own :]])])
        a, b = oddsketch.sketches(samples).view(np.uint64)
        bits = int(np.bitwise_count(a ^ b).sum())
        found.append(oddsketch.similarity(bits))
        keys = oddsketch.band_keys(samples)
        met += bool((keys[0] == keys[1]).any())
        if jaccard >= 0.8:
            assert bits <= oddsketch.limit(0.8)
    assert abs(np.mean(found) - jaccard) < 0.01 and np.std(found) < 0.035
    assert met == 200 or jaccard < 0.8


def test_a_large_group_of_near_copies(spark):
    """Copies of one text edited more and more, so that similarities cross the limit, chains, and other texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(420):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text)))
    chain = [rng.choice(words) for _ in range(60)]
    for i in range(420, 470):
        chain[rng.randrange(len(chain))] = rng.choice(words)
        docs.append((i, " ".join(chain)))
    docs += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(470, 600)]
    docs += [(700 + i, docs[i][1]) for i in range(40)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = linked_components([i for i, _ in docs], [four_word_set(t) for _, t in docs])
    assert counted(r.asDict() for r in oddsketch.near_duplicates(frame).collect()) == counted(want)


def symmetric(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T, q


@pytest.mark.parametrize("values", [
    [5.0, 4, 3, 2, 1], [1e6, 1e3, 1, 1e-3, 1e-6], [2.0] * 6, [3.0, 3 + 1e-7, 3 + 2e-7, 1, 1 + 1e-9, 0.5], [1.0, 0, 0, 0], [0.0, 0, 0],
    [1 + k * 1e-6 for k in range(30)], list(np.linspace(1, 2, 64))])
def test_refined_eigenvectors(values):
    m, _ = symmetric(values, len(values))
    m = (m + m.T) / 2
    found, x = whitening.eigenvectors(m)
    top = max(abs(v) for v in values) or 1
    assert np.abs(x.T @ x - np.eye(len(m))).max() < 1e-15 * len(m)
    assert np.abs(m @ x - x * found).max() < 2e-15 * top * len(m) ** 0.5 + 1e-300
    assert (np.diff(found) <= 0).all() and np.abs(found - sorted(values, reverse=True)).max() < 1e-14 * top * len(m)


def test_refinement_corrects_float32():
    m, q = symmetric(np.linspace(1, 9, 20), 5)
    rough = np.linalg.eigh(m.astype(np.float32))[1]
    _, x = whitening.eigenvectors(m)
    error = lambda v: np.abs(np.abs(v.T @ q[:, ::-1]) - np.eye(20)).max()
    assert error(x) < 1e-13 < 1e-8 < error(rough[:, ::-1])


def test_whitening_without_variance_and_with_large_sums(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])], "vec_id long, embedding array<double>")
    for r in whitening.whitening(same).collect():
        assert (r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, 0.0, 0.0)
    one = whitening.whitening(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 1 and one[0].n == 1
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(70)]
    found = whitening.whitening(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found if r.whitened is not None} == {1} and found[0].identity_error < 1e-12
    big = [(i, [float(1 << 41) * (1 if i % 2 else -1), 0.0]) for i in range(4)]
    found = whitening.whitening(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in found} == {None}
    assert {round(abs(r.whitened), 9) for r in found if r.component == 1} == {1.0}


@pytest.mark.parametrize("seed", range(10))
def test_skip_list_reaches_every_rank(seed):
    rng = random.Random(seed)
    items = ["x" * rng.randint(0, 9) + "é\U0001f600" * rng.randint(0, 2) for _ in range(rng.choice([0, 1, 2, 50, 3000]))]
    units, at = fim.SkipList(items), 0
    for k in range(len(items) + 1):
        assert units.reach(k) == at
        at += len(items[k]) if k < len(items) else 0
    with pytest.raises(IndexError):
        units.reach(len(items) + 1)
    assert units.high <= 24 and sum(map(len, units.step[1:])) <= 2 * len(items) + 24


def test_skip_list_descends_in_few_steps():
    units, seen = fim.SkipList(["ab\n"] * 20_000), []
    for rank in range(0, 20_001, 500):
        node, left, steps = 0, rank, 0
        for lane in range(units.high - 1, -1, -1):
            while (to := units.step[node][lane]) is not None and units.units[node][lane] <= left:
                left, node, steps = left - units.units[node][lane], to, steps + 1
        seen.append(steps)
        assert units.reach(rank) == 3 * rank
    assert max(seen) < 80


@pytest.mark.parametrize("text", ["", "a", "\n", "<S", "S><", "<\n<\n<P\n>", "a<\n>b\n<S\n>", "x <M", "<P>", "no\nmarks\nhere"])
def test_forms_are_reversible(text):
    forms = set()
    for i in range(200):
        _, form, _, _, out = fim.transform(i, text)
        forms.add(form)
        assert fim.restore(form, out) == text
    assert forms == ({"plain"} if text in ("", "<P>") else {"psm", "spm"})
    assert {fim.transform(i, text, rate=0)[1] for i in range(20)} == {"plain"}


# ---------------------------------------------------------------------------
# Secret scan: forms, time, generated files
# ---------------------------------------------------------------------------

SECRET = "aB3dE5gH9kLm2"


@pytest.mark.parametrize("text", [
    "don't set client_key = \"%s\", it's live", "# user's note: auth_key = '%s'", "# the users' note: auth_key = '%s'",
    'private_key = ("%s")', 'private_key = f"%s"', "private_key = rb'%s'", 'private_key = """%s"""', "private_key = '''\n  %s\n'''",
    '#define CLIENT_AUTH_KEY "%s"', "<private_key>%s</private_key>", '<add key="db_passphrase" value="%s"/>', 'private_key:\n  "%s"\n',
    "private_key: >-\n  %s\n", 'config.set("db_passphrase", "%s")', 'Authorization: "Bearer %s"', "Authorization: Bearer %s",
    'secretkey = "%s"', 'accesskey = "%s"', 'privatekey = "%s"', 'authkey = "%s"', 'dbpass = "%s"', 'userpwd = "%s"', 'auth_tokens = ["%s"]',
    'auth_tokens = ["zZ9yY8xX7wW6", "%s",\n "qQ1wW2eE3rR4"]', 'signing_key = "%s"', 'encryption_key = "%s"', '{\\"private_key\\": \\"%s\\"}',
    "let k: &'static str = \"%s\"; let private_key = k;", 'private_key = os.getenv("PRIVATE_KEY", "%s")', '{"a": "it\'s", "private_key": "%s"}'])
def test_forms_of_secrets(text):
    text %= SECRET
    found = [text[a:b] for a, _, b in secret_scan.lexed_spans(text, [])]
    assert SECRET in found and not {"os.getenv", "PRIVATE_KEY"} & set(found)


@pytest.mark.parametrize("text", ['monkey = "%s"', 'passport_no = "%s"', 'compass: "%s"', 'author: "%s"', 'tokenizer = "%s"', "private_key = read(%s)",
                                  "it's a pass: 'abc' key", "The key, in short: walk slowly and well", 'row.set("colour", "%s")'])
def test_ordinary_texts_have_no_secret(text):
    text = text % SECRET if "%s" in text else text
    assert secret_scan.lexed_spans(text, []) == []


def test_closings_equal_a_scan_from_each_mark():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice('"\'`\\\\ab=\n ') for _ in range(rng.randint(0, 40)))
        got = secret_scan._closings(text)
        run = lambda i: len(text[:i]) - len(text[:i].rstrip("\\"))
        for i, c in enumerate(text):
            if c not in "\"'`":
                assert i not in got
                continue
            own = run(i) if run(i) % 2 and c != "`" else 0
            line = text.find("\n", i) if "\n" in text[i:] else len(text)
            ends = [j for j in range(i + 1, line) if text[j] == c and (run(j) if run(j) % 2 and c != "`" else 0) == own]
            assert got.get(i) == ((ends[0] - own, ends[0]) if ends else None)


@pytest.mark.parametrize("unit", ['{\\"a\\": \\"b\\", \\"key\\": 1} ', "don't \"x 'k ` key= ", 'private_key["a"]["b"]', "\"\"\"'''key=", "\\\\\\ key=",
                                  "<key a key: <key>x", "key: ( key: [ a: b = ", '"a", ("key", "b" '])
def test_lexing_takes_time_in_proportion(unit):
    def took(n):
        start = time.perf_counter()
        secret_scan.lexed_spans("private_key " + unit * (n // len(unit)), [])
        return time.perf_counter() - start

    took(1 << 12)
    assert took(1 << 20) < 40 * took(1 << 16) + 2


def test_ten_megabytes_of_escaped_json():
    start = time.perf_counter()
    assert secret_scan.lexed_spans("key " + '{\\"a\\": \\"b\\"} ' * 770_000, []) == []
    assert time.perf_counter() - start < 240


def generated(rng):
    """(text, secrets) of a source or configuration file; the base patterns find none of the secrets."""
    value = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.randint(12, 32)))
    name = rng.choice(["private_key", "auth_key", "db_passphrase", "signing_key", "accesskey", "clientCredential", "smtp_pwd", "encryptionKey"])
    plain = rng.choice(["region", "colour", "monkey", "author", "user_name", "key_size", "title", "checksum_of_page"])
    forms = {
        "py": '{n} = "{v}"\n', "py2": "self.{n}: str = '{v}'\n", "py3": 'os.environ["{n}"] = ("{v}")\n', "go": 'var {n} string = "{v}"\n', "go2": '{n} := "{v}"\n',
        "java": 'private static final String {n} = "{v}";\n', "java2": 'props.setProperty("{n}", "{v}");\n', "yaml": "{n}: {v}\n", "yaml2": '{n}:\n  "{v}"\n',
        "toml": '{n} = "{v}"\n', "env": "export {n}={v}\n", "json": '  "{n}": "{v}",\n', "sh": "{n}='{v}'\n", "c": '#define {n} "{v}"\n', "xml": "<{n}>{v}</{n}>\n",
        "js": "const k = '{v}';\nlet {n} = k;\n"}
    form = forms[rng.choice(sorted(forms))]
    text, secrets = "# it's the users' file, don't edit\n", []
    for _ in range(rng.randint(1, 6)):
        v = value()
        secret = rng.random() < 0.5
        if secret:
            secrets.append(v)
        text += form.format(n=name if secret else plain, v=v) + rng.choice(["", "# note: all's well\n", "\n"])
    return text, secrets


def test_generated_files_precision_and_recall():
    rng = random.Random(12)
    hits = wrong = total = 0
    for _ in range(2000):
        text, secrets = generated(rng)
        base = secret_scan.base_spans(text)
        found = [text[a:b] for a, _, b in secret_scan.lexed_spans(text, base)]
        hits += sum(x in secrets for x in found)
        wrong += sum(x not in secrets for x in found)
        total += len(secrets)
    print("recall", hits / total, "precision", hits / (hits + wrong))
    assert hits >= 0.97 * total and hits >= 0.97 * (hits + wrong)


def test_archive_records_have_urns_of_their_own():
    import io

    from shelfcheck.llm import warc

    rows = [(1, "u", b"one", None, True), (2, "u", b"one", 1, False), (2, "u", b"one", 1, False), (2, "u", b"two", None, True)]
    seen = []
    for archive in ("a", "b"):
        out = io.BytesIO()
        records = (warc.page_record(*r, "2024-01-01T00:00:00Z", f"{archive}:{i}") for i, r in enumerate(rows))
        warc.write_archive(out, records, "2024-01-01T00:00:00Z", archive)
        fields = [f for f, _ in warc.read_archive(io.BytesIO(out.getvalue()))]
        ids = [f["WARC-Record-ID"] for f in fields]
        assert len(set(ids)) == 5 and fields[2]["WARC-Refers-To"] == fields[3]["WARC-Refers-To"] == ids[1]
        seen += [ids[0], ids[2], ids[3]]
    assert len(set(seen)) == 6


def test_texts_are_dropped_before_the_shuffle_by_a_bit_map(spark):
    """All rows whose key is wanted pass, repeated ones too, and few others; no keys, no rows; null keys match no other."""
    rows = spark.createDataFrame([(f"t{i % 4000}", i) for i in range(5000)] + [(None, 1)], "k string, v long")
    keys = spark.createDataFrame([(f"t{i}",) for i in range(0, 4000, 40)] * 2 + [("absent",)], "k string")
    left = [r.k for r in oddsketch._among(rows, keys, "k").collect()]
    want = [f"t{i % 4000}" for i in range(5000) if i % 4000 % 40 == 0]
    assert not counted({"k": k} for k in want) - counted({"k": k} for k in left) and len(left) < len(want) + 20
    assert oddsketch._among(rows, keys.limit(0), "k").count() == 0


def test_candidates_of_the_simhash_tiles(spark):
    """Classes with equal first fingerprints, or such that differ in three bits, are candidates; four bits are not."""
    base = 0x0F0F_1234_5678_9ABC
    rows = [(b"a", 5, [base, 1]), (b"b", 5, [base, 2]), (b"c", 5, [base ^ 0b111, 3]), (b"d", 5, [base ^ 0b1111 << 20, 4]), (b"e", 0, [base, 5])]
    classes = spark.createDataFrame(rows, "cls binary, n long, sketch array<long>")
    assert {frozenset(map(bytes, r)) for r in simhash.tile_candidates(classes).collect()} == {frozenset([b"a", b"b"]), frozenset([b"a", b"c"])}
