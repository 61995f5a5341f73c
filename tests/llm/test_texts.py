"""Operators on documents against plain versions, with odd rows and empty tables."""

import hashlib
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest

from peptarium.llm import bbit_minhash, components, line_runs, rule_ledger, scaled_sketch, super_kmers
from peptarium.llm.common import NULL_ID, Words


@pytest.fixture(scope="module", params=["corpus", "edges", "empty"])
def rows(request, edge_rows):
    return {"corpus": brute.corpus(), "edges": edge_rows, "empty": []}[request.param]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_words_split_at_ascii_space_only():
    texts = ["a　b c", "\x1cd\x0be", "", None, "x\n", "y"]
    words = Words(pa.array(texts, pa.large_string()))
    raw = words.data.tobytes()
    got = [[raw[words.starts[k] : words.ends[k]].decode() for k in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == [brute.WORD.findall(t or "") for t in texts]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_lines(frame, rows, batches, fanout):
    out = line_runs.dedup_lines(frame(rows), batches=batches, fanout=fanout)
    assert [c for c in out.columns if c == "n_lines"] == ["n_lines"]
    same([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()], brute.dedup_lines(rows))


def test_line_keys_fold_ascii_capitals_only(spark):
    lines = ["Ünïcode Line", "ünïcode line", "ünÏcode line", "ABC", "abc", "É", "é", "É©", "騩", "Ð\u0090", "İ", "i̇", "ſ", "s"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", line_runs.line_key("x").alias("k"))
    got = {r.x: r.k for r in df.collect()}
    for a in lines:
        for b in lines:
            assert (got[a] == got[b]) == (brute.ascii_lower(a) == brute.ascii_lower(b)), (a, b)


def test_runs_are_levelled_and_disjoint(spark, frame):
    store = line_runs.RunStore(spark, fanout=2)
    hashed = line_runs.hashed_lines(frame(brute.corpus()))
    for k in range(5):
        store.add(hashed.where(f"_id >= {k * 36} and _id < {(k + 1) * 36}"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    keys = store.rows()
    assert keys.count() == keys.select("h1", "h2").distinct().count() == hashed.where("_id < 180").select("h1", "h2").distinct().count()
    files = [f for run in store.live() for f in spark.table(run).inputFiles()]
    assert len(files) <= len(store.live()) * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = Path(spark.sql(f"DESCRIBE DATABASE {store.name}").where("info_name = 'Location'").first().info_value.removeprefix("file:"))
    assert place.exists()
    store.close()
    assert not place.exists()


def test_no_run_is_left_after_a_call(spark, frame):
    line_runs.dedup_lines(frame(brute.corpus())).collect()
    assert not spark.sql("SHOW DATABASES LIKE 'line_runs_*'").count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


@pytest.mark.parametrize("share", [None, 1e-9])
def test_windows(frame, rows, share, monkeypatch):
    if share:
        hot = super_kmers.hot_minimisers

        def all_hot(docs):
            seen = docs.select("text").collect()
            stretches = super_kmers.Stretches(Words(pa.array([r.text or "" for r in seen], pa.large_string())))
            return np.unique(stretches.key)

        monkeypatch.setattr(super_kmers, "hot_minimisers", all_hot)
        assert hot is not all_hot
    got = super_kmers.cut_repeats(frame(rows))
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], brute.cut_windows(rows))


def test_hot_list_finds_the_common_passage(frame):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = frame([(k, passage) for k in range(200)] + [(1000 + k, " ".join(f"q{k}_{j}" for j in range(60))) for k in range(50)])
    hot = super_kmers.hot_minimisers(docs, 0.01)
    want = super_kmers.Stretches(Words(pa.array([passage], pa.large_string()))).key
    assert set(want.tolist()) >= set(hot.tolist()) and len(hot)


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(super_kmers, "run_hashes", lambda w, size: np.zeros(max(0, len(w) - size + 1), np.uint64))
    texts = [" ".join(f"a{k}" for k in range(25)), " ".join(f"b{k}" for k in range(25)), " ".join(f"a{k}" for k in range(25))]
    words = Words(pa.array(texts, pa.large_string()))
    box = super_kmers.Outbox(np.zeros(0, np.uint64), 1)
    known = box.add(words, np.array([1, 2, 3]), np.zeros(3, np.int64))
    found = super_kmers._later_windows([n.to_bytes(8, "little") + block for _, n, block in box.flush()])
    assert found == [] and known == [(3, 0, 0, 6)]


def test_an_earlier_copy_may_be_sent_later(monkeypatch):
    text = " ".join(f"a{k}" for k in range(25))
    box = super_kmers.Outbox(np.zeros(0, np.uint64), 1)
    words = Words(pa.array([text, text, text], pa.large_string()))
    known = box.add(words, np.array([5, 3, 9]), np.zeros(3, np.int64))
    found = super_kmers._later_windows([n.to_bytes(8, "little") + block for _, n, block in box.flush()])
    late = {(i, s + k) for i, _, s, n in known + found for k in range(n)}
    assert late == {(i, k) for i in (5, 9) for k in range(6)}


def test_near_duplicates(frame, rows):
    found = bbit_minhash.near_duplicates(frame(rows)).collect()
    same([(None if r._id == NULL_ID else r._id, r.n_shingles, r.component) for r in found], brute.near_duplicates(rows))


@pytest.mark.parametrize("bits_block,bits_run,block,run", [(2, 3, 2, 3), (3, 2, 100, 1000), (100, 1000, 2, 3), (4096, 65_536, 512, 8192)])
def test_near_duplicates_open_buckets(frame, monkeypatch, bits_block, bits_run, block, run):
    """Members that are unlike the hub but like each other are still linked, however the buckets are cut."""
    for name, value in (("BITS_BLOCK", bits_block), ("BITS_RUN", bits_run), ("BLOCK", block), ("RUN", run)):
        monkeypatch.setattr(bbit_minhash, name, value)
    rows = brute.corpus(7, 150, 3000)
    chain = [f"c{k}" for k in range(120)]
    rows += [(5000 + k, " ".join(chain[: 118 - 8 * k] + [f"d{k}_{j}" for j in range(8 * k)])) for k in range(6)]
    rows += [(6000 + k, " ".join(chain[8 * k :])) for k in range(12)]
    found = bbit_minhash.near_duplicates(frame(rows)).collect()
    same([(r._id, r.n_shingles, r.component) for r in found], brute.near_duplicates(rows))


def test_estimate_is_corrected_for_collisions(spark):
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(a[:1000]), np.sort(a[250:1250]), np.sort(a[1000:])]
    _, packed = bbit_minhash.signatures(sets)
    df = spark.createDataFrame([(packed[0].tolist(), p.tolist()) for p in packed], "a array<bigint>, b array<bigint>")
    same_set, part, none = (r[0] for r in df.select(bbit_minhash.estimate(df.a, df.b)).collect())
    assert same_set == 1 and abs(part - 0.6) < 0.12 and abs(none) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100, 100 + k) for k in range(1, 50)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {k: 1 for k in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20} | {k: 100 for k in range(100, 150)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ledger(frame, rows):
    got = rule_ledger.ledger(frame(rows), ["doc_id", "fail_bits"])
    assert got.columns == ["doc_id", *rule_ledger.MEASURES, "fail_bits"]
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in got.collect()], [(i, *brute.quality(t)) for i, t in rows])


def test_repeated_rows_make_one_link(spark, frame, monkeypatch):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text)] * 200 + [(2, text + " more")] * 200 + [(3, "quite another text with words of its own")]
    sizes, confirm = [], bbit_minhash.confirm
    monkeypatch.setattr(bbit_minhash, "confirm", lambda *a: (sizes.append(confirm(*a)), sizes[-1])[1])
    got = bbit_minhash.near_duplicate_report(frame(rows)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}
    assert sizes[0].count() == 1


def test_ablations(spark, frame):
    texts = ["a b", "good words " * 60, " ".join(f"w{k}" for k in range(80)), " ".join(f"### w{k}" for k in range(80)), " ".join(f"W{chr(65 + k % 20)}" for k in range(40))]
    entries = rule_ledger.ledger(frame(list(enumerate(texts)))).cache()
    bits = [r.fail_bits for r in entries.orderBy("doc_id").collect()]
    got = {(r.policy, r.rule): r for r in rule_ledger.ablations(entries).collect()}
    for policy, rules in rule_ledger.POLICIES.items():
        mask = rule_ledger.mask_of(rules)
        for rule in rules:
            bit, r = rule_ledger.mask_of([rule]), got[policy, rule]
            assert r.kept == sum(b & mask == 0 for b in bits) == len(bits) - r.rejected
            assert r.failing == sum(b & bit != 0 for b in bits) and r.lost_by_rule_alone == sum(b & mask == bit for b in bits)
    kept = rule_ledger.keep_good(frame(list(enumerate(texts))))
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == frame([]).columns


def test_fingerprints(frame, rows):
    got = scaled_sketch.fingerprints_with_edits(frame(rows)).collect()
    ordered = sorted(rows, key=lambda r: (-brute.order(r[0]), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edit = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = scaled_sketch.sketches(pa.array([t, edit, after], pa.large_string()))
        want.append((i, len(t), brute.sha(edit), scaled_sketch.encoded(a), scaled_sketch.encoded(b), scaled_sketch.likeness(a, b), scaled_sketch.likeness(a, c)))
    same([tuple(r)[:7] for r in got], want)


def test_sketch_by_definition():
    def plain(text):
        raw = text.encode()
        if not raw:
            return set()
        width = min(scaled_sketch.WIDTH, len(raw))
        pieces = {raw[k : k + width] for k in range(len(raw) - width + 1)}
        # the hash itself is taken from one-shingle sketches
        hashes = {int(scaled_sketch.sketches(pa.array([p.decode("latin-1")], pa.large_string()))[0][0]) for p in pieces}
        low = {h for h in hashes if h < 2**64 // scaled_sketch.SCALE}
        return low or {min(hashes)}

    texts = ["", "a", "short text", "x" * 24, "the quick brown fox jumps over the lazy dog " * 3, " ".join(f"n{k}" for k in range(300))]
    got = scaled_sketch.sketches(pa.array(texts, pa.large_string()))
    assert [set(map(int, s)) for s in got] == [plain(t) for t in texts]
    assert all(np.array_equal(scaled_sketch.decoded(scaled_sketch.encoded(s)), s) for s in got)


def test_sketches_merge_and_contain():
    words = [f"t{k * 7919 % 10007}" for k in range(6000)]
    whole, part, other = (" ".join(w) for w in (words, words[2000:2300], [f"o{k}" for k in range(3000)]))
    a, b, c, both = scaled_sketch.sketches(pa.array([whole, part, other, whole + "\0" * 30 + other], pa.large_string()))
    assert scaled_sketch.containment(b, a) > 0.95 and scaled_sketch.containment(a, b) < 0.1 and scaled_sketch.containment(b, c) < 0.1
    assert len(np.setdiff1d(scaled_sketch.merged(a, c), both)) == 0


def test_same_digest_as_hashlib():
    assert brute.sha("é") == hashlib.sha256("é".encode()).hexdigest()
