"""Operators against brute force, an exact round trip, or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from steerframe.llm import (
    bpe, catalog, common, multi_index, packing, quality_qda, quality_rules, simhash, site_tree,
    suffix_dedup, suffix_tree_lm, toxicity,
)

import oracle

SF = "/root/testdata/sf0.001"


def rows_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


# ---- op1
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = np.concatenate([rng.standard_normal((300, 16)),
                        centres[rng.integers(0, 20, 300)] + 0.05 * rng.standard_normal((300, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (650, [0.0] * 16), (700, [float("nan")] * 16), (None, [1.0] * 16),
             (750, [1.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -2
        best = set(np.argsort(-s)[:5].tolist())
        own = sorted(got[q])
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in own)
        hits += len(best & {v for _, v, _ in own})
    assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert multi_index.nearest(df.limit(0)).count() == 0


def test_probing_finds_all_codes_within_the_radius():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 16, 500).astype(np.uint16)
    index = multi_index.SubstringIndex(values)
    for level in (0, 1, 3, 7):
        found = set(index.probe(12345, level, multi_index._masks(level)).tolist())
        apart = np.bitwise_count(values ^ np.uint16(12345))
        assert found == set(np.flatnonzero(apart == level).tolist())


# ---- op2
def removed_by_brute_force(rows, size=100):
    seen, out = set(), []
    for key, raw in sorted(rows):
        gone = [False] * len(raw)
        new = set()
        for p in range(len(raw) - size + 1):
            s = raw[p : p + size]
            if s in seen or s in new:
                gone[p : p + size] = [True] * size
            new.add(s)
        seen |= new
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key[0], sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def keyed(docs):
    rows = {
        ((common.NULL_ID if i is None else i), common.text_key(i, t)): t for i, t in rows_of(docs)
    }
    return list(rows.items())


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats_against_brute_force(docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    want = sorted(
        (i, n, s, hashlib.sha256(k).hexdigest()) for i, n, s, k in removed_by_brute_force(keyed(docs))
    )
    got = {
        (common.NULL_ID if r.doc_id is None else r.doc_id, r.n_removed, r.n_spans, r.kept_sha256)
        for r in suffix_dedup.remove_repeats(docs).collect()
    }
    assert sorted(got) == sorted(set(want))
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()


def test_repeats_on_tables(spark):
    con = oracle.connect(SF)
    name = "op2_suffix_dedup"
    difference = oracle.differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])
    assert difference is None, difference


@pytest.mark.parametrize("batch", [2000, 1])
def test_equal_rows_are_one_document(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    own, other = "".join(f"line {i} of a text, " for i in range(30)), "".join(f"{i} more " for i in range(40))
    rows = [(20, own), (20, own), (20, own), (21, own + other), (22, other), (22, other)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        want = {(i, n, s) for i, n, s, _ in removed_by_brute_force(keyed(df))}
        got = Counter((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect())
        assert set(got) == want and sum(got.values()) == len(rows)
        assert got[20, 0, 0] == 3
        cut = [r.text for r in suffix_dedup.cut_repeats(df).collect() if r.doc_id == 20]
        assert cut == [own] * 3


def test_cut_texts_stay_text(docs):
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for r in cut.collect():
        assert (r.text is None) or len(r.text) == r.n_chars


# ---- op3
def test_packing_is_whole_and_tight(docs):
    path = catalog.vocabulary()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    want = Counter()
    for i, raw in rows_of(docs):
        ids = lib.encode(raw.decode(), add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], np.uint32)
            want[i, k // 256, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(docs, path, 256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    # no two sequences of the one group would fit into one
    filled = sorted(sum(n for _, n in parts) for parts in bins.values())
    assert filled[0] + filled[1] > 256


def test_best_fit_takes_the_tightest():
    rnd = random.Random(4)
    lengths = sorted((rnd.randint(1, 64) for _ in range(300)), reverse=True)
    bins, offsets = packing.best_fit(np.array(lengths), 64)
    room = []
    for length, b, at in zip(lengths, bins, offsets):
        fits = [r for r in room if r >= length]
        if b == len(room):
            assert not fits
            room.append(64)
        assert not fits or room[b] == min(fits)
        assert at == 64 - room[b]
        room[b] -= length


# ---- op4
def slow_print(raw):
    words = raw.lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_against_brute_force(docs):
    rows = [(i, slow_print(t)) for i, t in rows_of(docs)]
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, p in rows:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, f"{p:016x}", least.get(root[p])) for i, p in rows)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.keep_one(docs).count() == len(set(root.values()))


def test_links_in_split_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    values = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(6)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and a != b:
                assert found[a] == found[b]


# ---- op5, op7, op8
def test_base_counts():
    from steerframe.llm.text_stats import base_counts

    raw = ("a b c d e f g h i\n" * 2 + "é# <x>\n").encode()
    n, chars, symbols, lines, repeats = base_counts(raw, raw.split())
    assert (n, chars, symbols, lines, repeats) == (20, 23, 3, 1, 18)


@pytest.mark.parametrize("target, module, least", [("quality", "qda", 0.9), ("toxic", "tox", 0.8)])
def test_held_out_accuracy(spark, target, module, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    part = quality_qda if module == "qda" else toxicity
    scored = part.score(docs, part.train(docs, labels)).filter("held_out")
    got = scored.join(labels, "doc_id").select((F.col("predicted") == F.col(target)).cast("int")).collect()
    assert np.mean([r[0] for r in got]) >= least


def test_toxic_texts_are_found_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = common.table(spark, sf, "labels")
    docs = common.table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out")
    rows = scored.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    found = Counter((r.lang, r.toxic, r.predicted) for r in rows)
    by = {k: sum(n for (_, *yp), n in found.items() if tuple(yp) == k) for k in ((1, 1), (1, 0), (0, 1))}
    assert by[1, 1] >= 0.8 * (by[1, 1] + by[1, 0]), found
    assert by[1, 1] >= 0.8 * (by[1, 1] + by[0, 1]), found
    assert all(found[lang, 1, 1] for lang in ("en", "de", "fr", "es")), found


def test_classifiers_on_edge_cases(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (docs, no_docs):
        for out in (
            quality_rules.judge(some, quality_rules.train(some, labels)),
            quality_qda.score(some, quality_qda.train(some, labels)),
            toxicity.score(some, toxicity.train(some, labels)),
        ):
            assert out.count() == some.count()
        assert quality_rules.keep_good(some, quality_rules.train(some, labels)).columns == some.columns
        assert toxicity.drop_toxic(some, toxicity.train(some, labels)).columns == some.columns


# ---- op6
def test_article_without_the_rest(spark):
    def page(i):
        return (
            f"<html><body><nav><a>Home</a></nav><div class='tip'>Read more on our site</div>"
            f"<p>Story &eacute; number {i} <b>bold\n</b> text<p>Second <i>{i * 7}</i></p>"
            f"<div class=comments>first!</div><script>var a='<p>x</p>'</script><footer>f</footer>"
        )
    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(20)]
    rows += [(20, None, None), (21, "x", ""), (22, "y", "<p>lone<div>text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    assert got[3] == "Story é number 3 bold text\nSecond 21"  # the tip is on every page
    assert (got[20], got[21], got[22]) == ("", "", "lone\ntext")
    assert site_tree.extract(df.limit(0)).count() == 0


def test_copies_are_no_boilerplate(spark):
    def page(body):
        return f"<html><body><article>{body}</article></body></html>"
    story = "<p>One story that many pages copy</p><blockquote>quoted words</blockquote>"
    rows = [(i, f"http://a/{i}", page(story)) for i in range(12)]
    rows += [(100 + i, f"http://b/{i}", page(story)) for i in range(12)]
    rows += [(200 + i, f"http://b/o{i}", page(f"<p>Other {i}</p><h6>Read more</h6>")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    whole = "One story that many pages copy\nquoted words"
    assert all(got[i] == whole for i in [*range(12), *range(100, 112)])
    assert all(got[200 + i] == f"Other {i}" for i in range(12))  # differing articles share it


# ---- op9
def test_language_model(docs, no_docs):
    rows = rows_of(docs)
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t.lower().split())
    n, v = counts.total() + len(train), len(counts) + 1
    norm = n + 0.1 * (v + 1)
    want = Counter()
    for i, t in rows:
        words = t.lower().split()
        base = sum(math.log10((counts[w] + 0.1) / norm) for w in words)
        base += math.log10((len(train) + 0.1) / norm)
        want[i, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, round(base, 6)] += 1
    got = suffix_tree_lm.score(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert suffix_tree_lm.score(no_docs).count() == 0


# ---- op10
def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = catalog.vocabulary()
    own, lib, rnd = bpe.Encoder(path), Tokenizer.from_file(path), random.Random(6)
    texts = ["", " ", "ΑΣ Σ İ", "a<|endoftext|>b", "é x y", "it's we'll", "日本語 😀"]
    for letters in ("ab", "the ", "etaoins", "é!1a", "aA "):
        texts += ["".join(rnd.choice(letters) for _ in range(n)) for n in (1, 9, 60, 300, 4000)]
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.text_ids(text.encode()), np.uint32).tolist() == ids
        assert bpe.decoded(np.array(ids, np.int32), own.table) == lib.decode(ids, skip_special_tokens=False)


def test_transducer_keeps_a_bounded_buffer():
    table = bpe.MergeTable(catalog.vocabulary())
    machine, rnd = bpe.Transducer(table), random.Random(7)
    out = []
    for _ in range(60):
        out += machine.read("".join(rnd.choice("etaoin") for _ in range(100)).encode())
        assert len(machine.buffer) <= table.lookahead + 3 * bpe.READ
    assert len(out) > 0


def test_encoding_edge_cases(docs, no_docs):
    path = catalog.vocabulary()
    got = bpe.digests(bpe.decode(bpe.encode(docs, path), path))
    assert got.count() == docs.count()
    assert bpe.encode(no_docs, path).count() == 0


def test_pipeline_stages_keep_columns(docs, no_docs, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    for some in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, str(tmp_path))
            assert some.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, some, str(tmp_path)).collect()
