"""Whitening, rendezvous shards and cross-tokenizer alignment against plain versions."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peptarium.llm import bit_whitening, rendezvous, spill_alignment
from peptarium.llm.catalog import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


# --- whitening


def vectors_of(spark, rows, kind="float"):
    schema = f"vec_id bigint, embedding array<{kind}>, label int, d string, x string, deviation string, _key string"
    return spark.createDataFrame([(i, v, 0, "d", "x", "y", "k") for i, v in rows], schema)


def usable(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for v in {tuple(np.floor(256 * np.array(v, float)).tolist()) for _, v in good})
    size = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    return [(i, [math.floor(256 * c) for c in v]) for i, v in good if len(v) == size]


def check_whitening(got, rows):
    own = usable(rows)
    fit = sorted({tuple(x) for _, x in own})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3)) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    trace = np.trace(cov)
    k = int((values[::-1][:4] > trace * d * 2.3e-16).sum())
    assert len(got) == len(own) * k
    by_row = {}
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[d - r.component] / trace, rel=1e-4)
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    want = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in own)
    assert {key: len(v) for key, v in by_row.items()} == {key: k * m for key, m in want.items()}
    # whitened over the fit list: no mean, unit covariance, on the eigenvector up to one sign
    for c in range(1, k + 1):
        e = vectors[:, d - c] / math.sqrt(values[d - c])
        pairs = []
        for i, x in own:
            dev = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            pairs.append(([r.whitened for r in by_row[i, dev] if r.component == c], float((np.array(x) - np.array(sums) / n) @ e)))
        sign = next((1 if abs(g[0] - w) <= abs(g[0] + w) else -1 for g, w in pairs if abs(w) > 1e-3), 1)
        for g, w in pairs:
            assert g == pytest.approx([sign * w] * len(g), abs=1e-6)


def test_whitening_matches_fractions(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * np.array([3, 2, 1.3, 0.8, 0.3, 0.1])
    rows = [(k, (rng.normal(size=6) @ mix).astype(np.float32).tolist()) for k in range(300)]
    rows += [(7, rows[7][1])] * 200 + [(900, rows[3][1]), (None, rows[4][1])]
    rows += [(901, None), (902, []), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("-inf"), *[0.0] * 5]), (906, [1.0, 2.0])]
    check_whitening(bit_whitening.whitening_report(vectors_of(spark, rows).repartition(5)).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(k, [0.25, 3.0]) for k in range(9)]], ids=["empty", "nulls", "one", "equal"])
def test_whitening_without_variance(spark, rows):
    assert bit_whitening.whitening_report(vectors_of(spark, rows)).collect() == []


def test_whitening_of_few_dimensions_and_wide_values(spark):
    rows = [(k, [1e3 * k, -3e4 * (k % 5)]) for k in range(40)]
    check_whitening(bit_whitening.whitening_report(vectors_of(spark, rows, "double")).collect(), rows)
    far = bit_whitening.whitening_report(vectors_of(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "double")).collect()
    assert {r.deviation for r in far if r.vec_id != 3} == {None} and all(math.isfinite(r.whitened) for r in far)


def test_scatter_is_exact_at_every_width():
    rng = np.random.default_rng(1)
    for bits in (1, 9, 31, 62):
        for n in (1, 63, 64, 65, 1000):
            x = rng.integers(-(2**bits), 2**bits, (n, 5))
            sums, products = bit_whitening.scatter(x)
            o = x.astype(object)
            assert sums.tolist() == o.sum(axis=0).tolist()
            assert np.triu(products).tolist() == np.triu(o.T @ o).tolist()


def test_packed_vectors_come_back():
    x = np.array([[1, -128], [128, 0], [2**31 - 1, 0], [-(2**63), 2**63 - 1], [127, 1]])
    raw = bit_whitening.packed(x)
    assert [r[0] for r in raw] == [1, 2, 4, 8, 1]
    assert sorted(bit_whitening.unpacked(raw).tolist()) == sorted(x.tolist())


# --- rendezvous shards


def shard(i, weights):
    name = "" if i is None else str(i)
    draws = [(int(hashlib.md5(f"{name}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(len(weights))]
    return min((-math.log(u) / w, s) for s, (u, w) in enumerate(zip(draws, weights, strict=True)) if w)[1]


@pytest.mark.parametrize("weights", [(1,) * 8, (1, 0, 3.5, 0.25), (2,)])
def test_shards(spark, frame, edge_rows, weights):
    rows = edge_rows + [(k, f"text {k % 40}") for k in range(100, 400)] + [(77, "hot")] * 200
    got = rendezvous.shard_records(frame(rows), weights).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = Counter((i, len(b) + 1, zlib.crc32(b), shard(i, weights), shard(i, [*weights, 1])) for i, b in raw)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(len(weights)):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [brute.order(r.doc_id) for r in own] == sorted(brute.order(r.doc_id) for r in own)
    assert all(r.grown_shard in (r.shard, len(weights)) for r in got)


def test_shards_in_slices(sliced, frame):
    rows = [(k, f"text {k % 40}") for k in range(300)] + [(77, "hot")] * 300
    got = rendezvous.shard_records(frame(rows)).collect()
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_follow_weights(spark):
    weights = (1.0, 2.0, 5.0)
    rows = spark.range(40_000).select(rendezvous.shard_of(F.col("id"), weights).alias("s")).groupBy("s").count().collect()
    for r in rows:
        assert r["count"] == pytest.approx(40_000 * weights[r.s] / 8, rel=0.05)
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.col("id"), [0.0])


def test_written_shards_hold_whole_rows(spark, frame, edge_rows, tmp_path):
    docs = frame(edge_rows)
    back = rendezvous.write_shards(docs.withColumn("shard", F.lit("old")), str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert all(r.shard == shard(r.doc_id, (1,) * 8) for r in back.select("doc_id", "shard").collect())
    assert rendezvous.shard_records(frame([])).collect() == []


# --- alignment of two tokenizers


A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Whole-text alignment by offsets alone."""
    import sentencepiece

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(b): b for b in chars}
    level |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in chars)}

    def piece(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    def align(text):
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        raw_a, raw_b = [bytes(level[c] for c in ta.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            return 0, 0, [], ""
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links, groups, last_a, last_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[last_a:p])) + "|" + ",".join(map(str, b[last_b:q])))
            links.append((a[p - 1], b[q - 1]))
            last_a, last_b = p, q
        return len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    return align


def alignment(plain, rows):
    own = [(i, *plain(t)) for i, t in rows]
    counts = Counter(x for r in own for x in r[3])
    best = Counter()
    for (_, b), k in counts.items():
        best[b] = max(best[b], k)
    return Counter(
        (i, na, nb, len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, na, nb, ls, sha in own
    )


ODD = ["İ. GAZETESİ, x", "a  b", " a", "a ", "\n", "x\n y", "½ ² ﬁ", "<s> <|endoftext|> </s>", "▁ ▁a", "漢字 かな", "🙂 🙂🙂", "\x00 \x1c \x85", "don't  stop", "á é", "<0x41> <unk>"]


@pytest.mark.parametrize("fan_in", [64, 2])
def test_alignment(spark, frame, edge_rows, plain, fan_in):
    rng = random.Random(8)
    letters = "ab cdE  .,'s\n\t0½İé漢🙂　"
    rows = [r for r in edge_rows if len(r[1] or "") < 50_000] + brute.corpus(4, 40) + [(1000 + k, t) for k, t in enumerate(ODD)]
    rows += [(2000 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for k in range(200)]
    rows += [(5000, "hot words again")] * 50 + [(6000, " ".join(f"w{k % 70}" for k in range(3000)))]
    if fan_in == 2:  # several levels of merging
        rows = rows[:120]
    got = spill_alignment.alignment_report(frame(rows).repartition(7 if fan_in == 64 else 23), A, B, fan_in).collect()
    assert Counter(map(tuple, got)) == alignment(plain, rows)


def test_alignment_of_nothing(spark, frame):
    assert spill_alignment.alignment_report(frame([]), A, B).collect() == []
    assert [tuple(r) for r in spill_alignment.alignment_report(frame([(1, None), (None, "")]), A, B).orderBy("doc_id").collect()] == [
        (None, 0, 0, 0, 0, 0, 0, ""),
        (1, 0, 0, 0, 0, 0, 0, ""),
    ]


def test_alignment_query_over_its_whole_table(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op13_spill_counting"](spark, SF)
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(map(tuple, got)) == alignment(plain, rows)


def test_segments_join_back_and_code_alike(monkeypatch):
    pair = spill_alignment.TokenPair(A, B)
    assert pair.by_words and pair.fast_a is not None
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab cE .'s\n0½İé漢▁\x1c　") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    whole = pair.align(texts)
    monkeypatch.setattr(spill_alignment, "SEGMENT", 3)
    assert all(" ".join(pair.segments(t)) == t for t in texts) and max(len(pair.segments(t)) for t in texts) > 2
    cut = pair.align(texts)
    assert whole[0] == cut[0] and whole[1].tolist() == cut[1].tolist() and whole[2].tolist() == cut[2].tolist()


def test_fast_coder_agrees_with_the_tokenizer_file():
    pair, plain = spill_alignment.TokenPair(A, B), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    rng = random.Random(10)
    for _ in range(3000):
        text = "".join(rng.choice("ab cEthe ing .'s\n0½İé漢ß🙂\x00\x85<|endoftext|>") for _ in range(rng.randrange(1, 40)))
        assert pair._code_a(text) == plain.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_coded_whole(tmp_path):
    spec = json.loads(open(A, encoding="utf-8").read())
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    pair = spill_alignment.TokenPair(str(tmp_path / "t.json"), B)
    assert not pair.by_words and pair.fast_a is None and pair.segments("a b " * 100_000) == ["a b " * 100_000]


def test_merges_are_exact_in_any_grouping():
    rng = np.random.default_rng(4)
    runs, want = [], Counter()
    for _ in range(20):
        pairs = np.unique(rng.integers(0, 2**40, 3000) % 20_000)
        counts = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
        runs.append(spill_alignment.frames(pairs, counts))
    assert list(spill_alignment.merged(runs)) == sorted(want.items())
