"""Language-model scores by a probabilistic suffix tree, beside a smoothed unigram base.

A text is its lower-case words and one end. Two suffix trees score it. The first predicts the
head of the next word (two bytes, or the end) from the bytes before it; its root is the share
of each head among words. The second predicts a word byte by byte from the bytes before it in
the word. A word has the probability of its head in its context, times its own share among
words of that head; shares are counts less a discount, which goes to the second tree, so new
words have a probability too, and all add up to one.

Contexts have variable lengths. One is looked at if it makes up a given share of the corpus,
which bounds the trees whatever the corpus, and retained if the distribution of what follows
diverges from that of its suffix by more than its size costs. Distributions are smoothed with
those of their suffixes down to the root, and the longest retained suffix scores.

All counts cover the whole training corpus: heads in their contexts from the texts, words from
the texts, bytes in their contexts from the table of different words. Words too rare for the
list that every task gets are joined by key.

Defined results: a null or empty text is the end alone; a null id is trained on and not held
out; equal rows get equal results; without training texts every token has base logarithm 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bytes_of, id_remainder, materialized, slices

DEPTH = 7
#: least share of all symbols for a context: at most 1 / SUPPORT contexts a level
SUPPORT = 5e-6
#: words whose counts every task gets; the counts of others are joined
FREQUENT = 150_000
#: words whose contexts are counted at a time
COUNTED = 100_000
#: bytes of texts whose words a worker holds at a time (a longer text alone), to count and to score
HELD, SCORED = 8_000_000, 300_000
ALPHA = 0.1
#: bytes of context for heads, and the least share of all tokens for such a context
REACH, HEAD_SUPPORT = 3, 5e-5
#: what each different word gives to words that were not seen
DISCOUNT = 0.75
END = 10  # no byte of a word
END_HEAD = END << 8

SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 10) == 0, F.lit(False))


def _word_batches(batches):
    for batch in batches:
        counts: Counter = Counter()
        for part in slices(iter([batch])):
            for raw in bytes_of(part.column("text")):
                counts.update(raw.lower().split())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"],
        )


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the training texts, counted in tasks before the shuffle."""
    return (
        docs.filter(~held_out(F.col("doc_id"))).select("text")
        .mapInArrow(_word_batches, "word binary, n long")
        .groupBy("word").agg(F.sum("n").alias("c"))
    )


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All symbols; the places that are predicted, how far back their words go, word numbers."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    symbols = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8)
    starts = np.cumsum(lengths) - lengths
    back = np.arange(len(symbols)) - np.repeat(starts, lengths)
    at = np.flatnonzero(back > 0)
    return symbols, at, back[at], np.repeat(np.arange(len(words)), lengths - 1)


def contexts(symbols: np.ndarray, at: np.ndarray, back: np.ndarray):
    """For each length: rows that have so much context, and their contexts as numbers."""
    rows, value = np.arange(len(at)), np.zeros(len(at), np.uint64)
    yield 0, rows, value
    for k in range(1, DEPTH + 1):
        far = back[rows] >= k
        rows, value = rows[far], value[far]
        value = value | symbols[at[rows] - k].astype(np.uint64) << np.uint64(8 * (k - 1))
        yield k, rows, value


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Places of values in an ordered list, -1 where they are not in it."""
    if not len(ordered):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[place] == values, place, -1)


def _context_batches(batches, level, parents):
    """(context, next, n) of one length over a task, where the suffix has support."""
    words: list[bytes] = []
    weights: list[int] = []

    def counted():
        symbols, at, back, owner = positions(words)
        n = np.array(weights, np.float64)[owner]
        rows = value = None
        for k, rows, value in contexts(symbols, at, back):
            if k == level:
                break
            if k == level - 1 and parents is not None:
                keep = _among(value, parents) >= 0
                supported = np.zeros(len(at), bool)
                supported[rows[keep]] = True
        if parents is not None:
            keep = supported[rows]
            rows, value = rows[keep], value[keep]
        pair = value << np.uint64(8) | symbols[at[rows]].astype(np.uint64)
        found, which = np.unique(pair, return_inverse=True)
        total = np.bincount(which, weights=n[rows], minlength=len(found))
        return pa.RecordBatch.from_arrays(
            [pa.array((found >> np.uint64(8)).view(np.int64)),
             pa.array((found & np.uint64(255)).astype(np.int32)),
             pa.array(total.astype(np.int64))],
            ["context", "next", "n"],
        )

    for batch in batches:
        words += batch.column("word").to_pylist()
        weights += batch.column("c").to_pylist()
        if len(words) >= COUNTED:
            yield counted()
            words, weights = [], []
    if words:
        yield counted()


@dataclass
class SuffixTree:
    """Retained contexts by length, and the log10 distribution of each."""

    contexts: list[np.ndarray]  # ordered, for each length
    first: list[int]  # row of the first context of each length
    table: np.ndarray  # rows: contexts; columns: symbols that occur, then any other
    column: np.ndarray  # of each byte

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word with the blank that closes it."""
        if not words:
            return np.zeros(0)
        symbols, at, back, owner = positions(words)
        state = np.zeros(len(at), np.int64)
        live = np.ones(len(at), bool)
        for k, rows, value in contexts(symbols, at, back):
            if k == 0:
                continue
            rows_live = live[rows]
            rows_k = rows[rows_live]
            place = _among(value[rows_live], self.contexts[k])
            hit = place >= 0
            state[rows_k[hit]] = self.first[k] + place[hit]
            still = np.zeros(len(at), bool)
            still[rows_k[hit]] = True
            live = still
            if not hit.any():
                break
        logs = self.table[state, self.column[symbols[at]]].astype(np.float64)
        return np.bincount(owner, weights=logs, minlength=len(words))

    def log_heads(self, heads: np.ndarray) -> np.ndarray:
        """log10 probability that a word begins with two bytes (the second may be its blank)."""
        first, second = heads >> 8, heads & 255
        start = _among(np.full(len(heads), 32, np.uint64), self.contexts[1])
        logs = self.table[np.where(start >= 0, self.first[1] + start, 0), self.column[first]]
        state = np.zeros(len(heads), np.int64)
        for k, value in ((1, first), (2, 32 << 8 | first)):
            place = _among(value.astype(np.uint64), self.contexts[k])
            state = np.where(place >= 0, self.first[k] + place, state)
        return logs.astype(np.float64) + self.table[state, self.column[second]]


def _supported(words: DataFrame, level: int, parents: np.ndarray | None, least: float):
    """Pairs of the contexts of one length that have support; their number is bounded."""
    pairs = words.mapInArrow(
        partial(_context_batches, level=level, parents=parents), "context long, next int, n long"
    ).repartition("context")
    whole = Window.partitionBy("context")
    found = (
        pairs.groupBy("context", "next").agg(F.sum("n").alias("n"))
        .withColumn("all", F.sum("n").over(whole)).filter(F.col("all") >= least)
        .select("context", "next", "n").toArrow()
    )
    context = found["context"].to_numpy().view(np.uint64)
    follow = found["next"].to_numpy().astype(np.int64)
    order = np.lexsort((follow, context))
    return context[order], follow[order], found["n"].to_numpy()[order].astype(np.float64)


def grow(words: DataFrame, symbols: float) -> SuffixTree:
    """The tree of the bytes of words, for a table of words with counts ``c``."""
    least = max(2.0, SUPPORT * symbols)
    levels = []
    parents = None
    for level in range(DEPTH + 1):
        context, follow, n = _supported(words, level, parents, least)
        levels.append((context, follow, n))
        if not len(context):
            break
        parents = np.unique(context)
    return _pruned(levels)


def _pruned(levels) -> SuffixTree:
    """Divergence tests from the longest contexts up; suffixes of retained ones stay."""
    total = max(float(levels[0][2].sum()), 2.0)
    keep: list[set[int]] = [set() for _ in range(DEPTH + 2)]
    for k in range(len(levels) - 1, 0, -1):
        context, follow, n = levels[k]
        if not len(context):
            continue
        mask = np.uint64((1 << 8 * (k - 1)) - 1)
        parent_context, parent_follow, parent_n = levels[k - 1]
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        size = np.diff(np.append(starts, len(context)))
        of_context = np.repeat(np.add.reduceat(n, starts), size)
        pairs = parent_context << np.uint64(8) | parent_follow.astype(np.uint64)
        place = _among((context & mask) << np.uint64(8) | follow.astype(np.uint64), pairs)
        own_parent = np.unique(parent_context)
        parent_total = np.bincount(
            np.searchsorted(own_parent, parent_context), weights=parent_n, minlength=len(own_parent)
        )
        of_parent = parent_total[np.maximum(_among(context & mask, own_parent), 0)]
        shorter = np.where(place >= 0, parent_n[np.maximum(place, 0)], 0.5) / of_parent
        gain = np.add.reduceat(n * np.log((n / of_context) / shorter), starts)
        passed = gain > 0.5 * size * np.log(total)
        keep[k].update(context[starts][passed].tolist())
        keep[k - 1].update((np.array(sorted(keep[k]), np.uint64) & mask).tolist() if k > 1 else [])
    used = np.unique(levels[0][1]) if len(levels[0][1]) else np.zeros(0, np.int64)
    column = np.full(256, len(used), np.int64)
    column[used] = np.arange(len(used))
    width = len(used) + 1
    kept = [np.zeros(1, np.uint64)] + [
        np.array(sorted(keep[k]), np.uint64) for k in range(1, DEPTH + 1)
    ]
    first = np.concatenate([[0], np.cumsum([len(c) for c in kept])])[:-1].tolist()
    table = np.zeros((sum(len(c) for c in kept), width))
    for k, own in enumerate(kept):
        if not len(own):
            continue
        context, follow, n = levels[k] if k < len(levels) else (np.zeros(0, np.uint64),) * 3
        place = _among(context, own)
        counts = np.zeros((len(own), width))
        np.add.at(counts, (place[place >= 0], column[follow[place >= 0].astype(np.int64)]), n[place >= 0])
        kinds = np.maximum((counts > 0).sum(1, keepdims=True), 1)
        if k == 0:
            shorter = np.full((1, width), 1 / 256)
        else:
            mask = np.uint64((1 << 8 * (k - 1)) - 1)
            shorter = table[first[k - 1] + _among(own & mask, kept[k - 1])]
        rows = (counts + kinds * shorter) / (counts.sum(1, keepdims=True) + kinds)
        table[first[k] : first[k] + len(own)] = rows
    return SuffixTree(kept, first, np.log10(table).astype(np.float32), column)


def stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts in one row of bytes, and where words and ends start.

    Each text is led in by ends, as many as a context has bytes.
    """
    lead = bytes([END]) * REACH + b" "
    joined = b"".join(
        [lead + b" ".join(words) + (b" " if words else b"") + bytes([END]) for words in texts]
    )
    symbols = np.frombuffer(joined, np.uint8)
    return symbols, np.flatnonzero(symbols[:-1] == 32) + 1


def word_lists(batches, held: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Pieces of batches with the words of their texts, some ``held`` bytes of text at a time."""
    for batch in slices(batches, 4000):
        raws = bytes_of(batch.column("text"))
        start = size = 0
        for i, raw in enumerate(raws):
            size += len(raw)
            if size >= held or i + 1 == len(raws):
                part = [raw.lower().split() for raw in raws[start : i + 1]]
                yield batch.slice(start, i + 1 - start), part
                start, size = i + 1, 0


def heads_of(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    heads = symbols[starts].astype(np.int64) << 8
    return heads | np.where(heads == END_HEAD, 0, symbols[np.minimum(starts + 1, len(symbols) - 1)])


def head_contexts(symbols: np.ndarray, starts: np.ndarray):
    """For each length: the bytes before the blank in front of each start, as numbers."""
    value = np.zeros(len(starts), np.int64)
    for k in range(1, REACH + 1):
        value = value | symbols[starts - 1 - k].astype(np.int64) << 8 * (k - 1)
        yield k, value


def _head_batches(batches):
    for _, words in word_lists(batches, HELD):
        symbols, starts = stream(words)
        heads = heads_of(symbols, starts)
        for k, value in head_contexts(symbols, starts):
            found, n = np.unique(value << 16 | heads, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), k, np.int32)), pa.array(found >> 16),
                 pa.array((found & 0xFFFF).astype(np.int32)), pa.array(n.astype(np.int64))],
                ["length", "context", "head", "n"],
            )


@dataclass
class HeadTree:
    """Retained contexts of heads, and how much each changes the share of a head (log10)."""

    contexts: list[np.ndarray]  # ordered, for each length; none for length 0
    states: list[np.ndarray]  # number of each
    change: np.ndarray  # rows: states; columns: heads that occur, then any other
    column: np.ndarray  # of each head

    def log_changes(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        state = np.zeros(len(starts), np.int64)
        for k, value in head_contexts(symbols, starts):
            if k <= 2:  # at most 65,536 numbers: a plain table
                table = np.full(1 << 8 * k, -1)
                table[self.contexts[k]] = self.states[k]
                found = table[value]
                state = np.where(found >= 0, found, state)
            elif len(self.states[k]):
                place = _among(value, self.contexts[k])
                state = np.where(place >= 0, self.states[k][place], state)
        return self.change[state, self.column[heads_of(symbols, starts)]].astype(np.float64)


def grow_heads(docs: DataFrame, shares: dict[int, float], tokens: int) -> HeadTree:
    """The tree of heads for training texts and the share of each head among all tokens."""
    least = max(2.0, HEAD_SUPPORT * tokens)
    counted = (
        docs.select("text")
        .mapInArrow(_head_batches, "length int, context long, head int, n long")
        .groupBy("length", "context", "head").agg(F.sum("n").alias("n"))
        .withColumn("all", F.sum("n").over(Window.partitionBy("length", "context")))
        .filter(F.col("all") >= least).drop("all").toArrow()
    )
    length, context, head, n = (counted[c].to_numpy() for c in ("length", "context", "head", "n"))
    root = np.zeros(1 << 16)
    root[list(shares)] = list(shares.values())
    nodes: dict[tuple[int, int], int] = {}
    dense, escape = [root], [0.0]  # distributions by state
    parent_of = lambda k, c: nodes.get((k - 1, c & ((1 << 8 * (k - 1)) - 1)), 0)
    total = max(float(tokens), 2.0)
    contexts_of, states_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, REACH + 1):
        rows = np.flatnonzero(length == k)
        rows = rows[np.lexsort((head[rows], context[rows]))]
        cuts = np.flatnonzero(np.diff(context[rows])) + 1
        own, numbers = [], []
        for part in np.split(rows, cuts) if len(rows) else []:
            value = int(context[part[0]])
            above = parent_of(k, value)
            seen, count = head[part], n[part].astype(np.float64)
            size, kinds = count.sum(), float(len(part))
            shorter = dense[above][seen]
            gain = (count * np.log(count / size / np.maximum(shorter, 1e-300))).sum()
            if gain <= 0.5 * kinds * np.log(total):
                if above:  # its longer contexts fall back on its suffix
                    nodes[k, value] = above
                continue
            state = len(escape)
            nodes[k, value] = state
            probability = dense[above] * (kinds / (size + kinds))
            probability[seen] += count / (size + kinds)
            dense.append(probability.astype(np.float32))
            escape.append(escape[above] + float(np.log10(kinds / (size + kinds))))
            own.append(value)
            numbers.append(state)
        contexts_of.append(np.array(own, np.int64))
        states_of.append(np.array(numbers, np.int64))
    used = np.flatnonzero(root > 0)
    column = np.full(1 << 16, len(used), np.int64)
    column[used] = np.arange(len(used))
    change = np.empty((len(dense), len(used) + 1), np.float32)
    change[:, -1] = escape
    for state, probability in enumerate(dense):
        change[state, :-1] = np.log10(probability[used] / root[used])
    return HeadTree(contexts_of, states_of, change, column)


@dataclass
class Scorer:
    """What every task gets: the tree of heads, and the logarithms of frequent words."""

    heads: HeadTree | None
    frequent: dict[bytes, int]  # places in the two lists
    shares: np.ndarray
    bases: np.ndarray
    tokens: int
    kinds: int
    texts: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ALPHA) / (self.tokens + ALPHA * (self.kinds + 1)))

    def share(self, count: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 share of words with a count and a log10 probability of their bytes."""
        spare = DISCOUNT * (self.kinds - (self.texts > 0))
        return np.log10(
            (np.maximum(count - DISCOUNT, 0) + max(spare, 1e-9) * 10.0**spelled)
            / max(self.tokens, 1) + 1e-300
        )


def _spell_batches(batches, shared):
    """Words with counts, and the log10 probability of their bytes."""
    for batch in slices(batches, COUNTED):
        spelled = shared.value.log_words(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("c"), pa.array(spelled)], ["word", "c", "spelled"]
        )


def _score_batches(batches, shared):
    scorer = shared.value
    texts = float(scorer.texts)
    end_base = float(scorer.base(np.array(texts)))
    end_share = float(np.log10(max(texts, 1e-9) / max(scorer.tokens, 1)))
    for batch, words in word_lists(batches, SCORED):
        n = len(words)
        sizes = np.array([len(own) for own in words], np.int64)
        flat = list(chain.from_iterable(words))
        place = np.fromiter(map(scorer.frequent.get, flat, repeat(-1)), np.int64, len(flat))
        owner = np.repeat(np.arange(n), sizes)
        symbols, starts = stream(words)
        moved = np.bincount(
            np.repeat(np.arange(n), sizes + 1), scorer.heads.log_changes(symbols, starts), n
        )
        sure = place >= 0
        frequent, of = place[sure], owner[sure]
        part = np.bincount(of, scorer.shares[frequent], n) + end_share + moved
        base = np.bincount(of, scorer.bases[frequent], n) + end_base
        seen = np.bincount(of, minlength=n) + int(texts > 0)
        # words too rare for the list, once for each text
        rare = np.flatnonzero(~sure)
        cuts = np.searchsorted(owner[rare], np.arange(n + 1))
        names = [flat[i] for i in rare.tolist()]
        own = [Counter(names[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        structs = pa.StructArray.from_arrays(
            [
                pa.array(list(chain.from_iterable(own)), pa.binary()),
                pa.array(list(chain.from_iterable(c.values() for c in own)), pa.int64()),
            ],
            ["word", "n"],
        )
        ends = np.concatenate([[0], np.cumsum([len(c) for c in own])])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), batch.column("held_out"),
                pa.array(sizes + 1), pa.array(seen, pa.int64()), pa.array(base), pa.array(part),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs),
            ],
            ["doc_id", "held_out", "n_tokens", "known", "sure", "part", "rare"],
        )


def score(docs: DataFrame) -> DataFrame:
    """Train on the texts that are not held out, and score every text."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(F.col("doc_id")))
    words = materialized(word_counts(docs), "lm-words")
    sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum(F.col("c") * (F.length("word") + 1)), F.lit(0)).alias("symbols"),
    ).first()
    texts = training.count()
    tokens, kinds = sums["n"] + texts, sums["v"] + (texts > 0)
    tree = grow(words, float(sums["symbols"]))
    trees = spark.sparkContext.broadcast(tree)
    # each different word is spelled once
    words = materialized(
        words.mapInArrow(partial(_spell_batches, shared=trees), "word binary, c long, spelled double"),
        "lm-spelled",
    )
    frequent = words.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    scorer = Scorer(
        None, dict(zip(frequent["word"].to_pylist(), range(len(frequent)))),
        np.zeros(0), np.zeros(0), tokens, kinds, texts,
    )
    counts = frequent["c"].to_numpy().astype(np.float64)
    scorer.shares = scorer.share(counts, frequent["spelled"].to_numpy())
    scorer.bases = scorer.base(counts)
    scorer.heads = grow_heads(training, _head_shares(words, tree, scorer), tokens)
    shared = spark.sparkContext.broadcast(scorer)
    scored = materialized(
        docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
        .mapInArrow(
            partial(_score_batches, shared=shared),
            "doc_id long, held_out boolean, n_tokens long, known long, sure double,"
            " part double, rare array<struct<word:binary,n:long>>",
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "lm-scored",
    )
    count, n = F.coalesce("c", F.lit(0)), F.col("n")
    norm = tokens + ALPHA * (kinds + 1)
    spare = max(DISCOUNT * sums["v"], 1e-9)

    @F.arrow_udf("double")
    def spelled_new(new: pa.Array) -> pa.Array:
        out = np.zeros(len(new))
        at = np.flatnonzero(new.is_valid().to_numpy(zero_copy_only=False))
        out[at] = trees.value.log_words(new.take(pa.array(at)).to_pylist())
        return pa.array(out)

    # a word that training texts lack is spelled here
    spelled = F.coalesce("spelled", spelled_new(F.when(F.col("c").isNull(), F.col("word"))))
    share = (
        F.greatest(count - DISCOUNT, F.lit(0.0)) + spare * F.pow(F.lit(10.0), spelled)
    ) / max(tokens, 1) + 1e-300
    rare = (
        scored.select("row", F.explode("rare").alias("w")).select("row", "w.*")
        .join(words, "word", "left")
        .groupBy("row").agg(
            F.sum(n * F.log10((count + ALPHA) / norm)).alias("more"),
            F.sum(n * F.log10(share)).alias("rest"),
            F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("also"),
        )
    )
    zero = F.lit(0.0)
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sure") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("part") + F.coalesce("rest", zero)).alias("score"),
    )


def _head_shares(words: DataFrame, tree: SuffixTree, scorer: Scorer) -> dict[int, float]:
    """Share of each head among all tokens; at most 65,536 heads."""
    first = F.conv(F.hex(F.substring(F.concat("word", F.lit(b" ")), 1, 2)), 16, 10).cast("int")
    rows = words.groupBy(first.alias("head")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")
    ).toArrow()
    head = rows["head"].to_numpy().astype(np.int64)
    spelled = 10.0 ** tree.log_heads(head)
    spare = DISCOUNT * (scorer.kinds - (scorer.texts > 0))
    share = (rows["c"].to_numpy() - DISCOUNT * rows["v"].to_numpy() + spare * spelled) / max(scorer.tokens, 1)
    out = dict(zip(head.tolist(), share.tolist()))
    if scorer.texts:
        out[END_HEAD] = scorer.texts / scorer.tokens
    return out
