"""The suffix trees against a slow walk, and their distributions adding up to one."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from steerframe.llm import suffix_tree_lm as lm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    """The byte tree and the head tree of a small corpus, and its word counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lm.word_counts(docs).cache()
    counts = {r.word: r.c for r in words.collect()}
    tree = lm.grow(words, float(sum(c * (len(w) + 1) for w, c in counts.items())))
    training = docs.filter(~lm.held_out(F.col("doc_id")))
    texts = training.count()
    tokens = sum(counts.values()) + texts
    scorer = lm.Scorer(None, {}, np.zeros(0), np.zeros(0), tokens, len(counts) + 1, texts)
    shares = lm._head_shares(words, tree, scorer)
    return tree, lm.grow_heads(training, shares, tokens), shares, counts, scorer


def slow_log(tree, word):
    """log10 of a word and its blank, byte by byte from the longest retained context."""
    symbols, out = b" " + word + b" ", 0.0
    for i in range(1, len(symbols)):
        state, value = 0, 0
        for k in range(1, min(i, lm.DEPTH) + 1):
            value |= symbols[i - k] << 8 * (k - 1)
            found = np.flatnonzero(tree.contexts[k] == value)
            if not len(found):
                break
            state = tree.first[k] + int(found[0])
        out += float(tree.table[state, tree.column[symbols[i]]])
    return out


def test_words_against_a_slow_walk(model):
    tree, _, _, counts, _ = model
    rng = random.Random(1)
    words = rng.sample(sorted(counts), 300) + [b"x", b"qzqz", "été".encode(), b"a" * 3000]
    assert np.allclose(tree.log_words(words), [slow_log(tree, w) for w in words], atol=1e-3)
    assert sum(len(c) for c in tree.contexts) > 50


def test_distributions_add_up_to_one(model):
    tree, heads, shares, counts, scorer = model
    p = 10.0 ** tree.table.astype(np.float64)
    used = p.shape[1] - 1
    assert np.allclose(p[:, :used].sum(1) + (256 - used) * p[:, used], 1, atol=1e-4)
    root = np.array([shares[h] for h in sorted(shares)])
    assert np.isclose(root.sum(), 1, atol=1e-2)  # the rest is for heads that no word has
    order = heads.column[np.array(sorted(shares))]
    for change in heads.change.astype(np.float64):
        moved = (root * 10.0 ** change[order]).sum() + (1 - root.sum()) * 10.0 ** change[-1]
        assert np.isclose(moved, 1, atol=1e-3)
    # words: what the counts give up is what the bytes give out
    words = sorted(counts)
    n = np.array([counts[w] for w in words], np.float64)
    spelled = tree.log_words(words)
    told = (10.0 ** scorer.share(n, spelled)).sum() + scorer.texts / scorer.tokens
    spare = lm.DISCOUNT * len(words) / scorer.tokens
    assert np.isclose(told + spare * (1 - (10.0**spelled).sum()), 1, atol=1e-6)


def test_score_against_a_plain_sum(spark, model):
    """Every text again from the counts and the two trees, one token after the other."""
    tree, heads, shares, counts, scorer = model
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").collect()
    got = {r.doc_id: r for r in lm.score(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for doc in docs:
        words = doc.text.encode().lower().split()
        symbols, starts = lm.stream([words])
        total = float(heads.log_changes(symbols, starts).sum())
        base = 0.0
        for w, n in Counter(words).items():
            c = counts.get(w, 0)
            spelled = 10.0 ** slow_log(tree, w)
            share = (max(c - lm.DISCOUNT, 0) + lm.DISCOUNT * len(counts) * spelled) / scorer.tokens
            total += n * math.log10(share + 1e-300)
            base += n * math.log10((c + 0.1) / (scorer.tokens + 0.1 * (len(counts) + 2)))
        total += math.log10(scorer.texts / scorer.tokens)
        base += math.log10((scorer.texts + 0.1) / (scorer.tokens + 0.1 * (len(counts) + 2)))
        row = got[doc.doc_id]
        assert row.n_tokens == len(words) + 1
        assert row.score == pytest.approx(total, rel=1e-3)
        assert row.base_score == pytest.approx(base, rel=1e-9)


def test_very_long_text_and_pieces(spark):
    long = "word " * 200_000
    rows = [(1, long), (2, None), (3, "a b a"), (4, long), (5, "zz"), (5, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score(df).collect()}
    assert len(got) == 5 and {n for i, n, _ in got if i in (1, 4)} == {200_001}
    # equal texts score alike
    assert len({s for i, _, s in got if i in (1, 4)}) == 1
