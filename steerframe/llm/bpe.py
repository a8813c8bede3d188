"""Byte-pair encoding and decoding as bounded-lookahead streaming machines.

Encoding reads a word symbol by symbol. A merge further right can only change what lies left
of it through a chain of overlapping merges, each later in the merge list than the one before;
the longest such chain bounds how far an unread symbol reaches back. Tokens that end further
back than that are stable and leave at once, so a word of any length needs a buffer of fixed
size. Decoding turns ids into bytes and bytes into text with a machine that keeps only the
open character.

Words between blanks are encoded one by one, as the vocabulary's splitter drops white space;
frequent ones are remembered. Defined results: null and empty texts have no tokens and decode
to an empty text; the strings of special tokens in a text become their ids, as the public
library does by default; bytes that are no text decode to U+FFFD.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import bytes_of, slices

#: words, and parts of words, whose ids a Python worker remembers
REMEMBERED = 400_000
#: symbols that are read beyond the lookahead before tokens are emitted
READ = 256
#: ids that the decoder turns into bytes at a time
DECODED = 4096
#: last code point of Latin, Greek and Cyrillic, in which no version of Unicode in use differs
SETTLED = "\u052f"
#: parts of up to so many symbols are merged by plain scans
SHORT = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, then from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], sizes: dict[str, int]) -> int:
    """How many symbols beyond its end make a token boundary certain.

    ``reach`` holds, for each token that a chain of merges can end in, how far from the unread
    symbol its left end can lie. Merges are taken in order, as a chain goes up the list.
    """
    reach: dict[str, int] = {}
    most = 1
    for left, right in merges:
        size, whole = sizes[left], left + right
        far = max(
            size + sizes[right], reach.get(left, 0), reach[right] + size if right in reach else 0
        )
        for token, value in ((left, far), (whole, far), (right, far - size)):
            if value > reach.get(token, 0):
                reach[token] = value
        most = max(most, far)
    return most


class MergeTable:
    """Vocabulary, merges and text rules of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        symbols = [*self.letters, *(c + self.suffix for c in self.letters)]
        sizes = dict.fromkeys(symbols, 1)
        for left, right in merges:
            sizes[left + right] = sizes[left] + sizes[right]
        self.lookahead = sufficient_lookahead(merges, sizes)
        self.sizes = sizes
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile(
            "(" + "|".join(regex.escape(t) for t in self.special) + ")"
        )
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.words = regex.compile(pattern)
        # which code points are letters and what their lower case is depends on the version of
        # Unicode: beyond the scripts that have settled the public library's own rules hold
        rules = Tokenizer.from_file(path)
        self.normalizer = rules.normalizer
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, number in [*self.ids.items(), *self.special.items()]:
            self.tokens[number] = token.encode()
        # without a decoder tokens are shown as they are, with a blank between them
        self.gap = b" "
        if (spec.get("decoder") or {}).get("type") == "ByteLevel":
            value = {letter: bytes([b]) for b, letter in enumerate(self.letters)}
            special = set(self.special.values())
            self.tokens = [
                t if i in special else b"".join(value.get(c, c.encode()) for c in t.decode())
                for i, t in enumerate(self.tokens)
            ]
            self.gap = b""

    def parts(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves, composed and in lower case; a
        sigma is lowered without regard to its place."""
        if text.isascii():
            return self.words.findall(text.lower())
        if max(text) <= SETTLED:
            composed = unicodedata.normalize("NFC", text)
            return self.words.findall(composed.replace("Σ", "σ").lower())
        return [part for part, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges of a list of symbols: least rank first, then leftmost."""
        return self._scan(symbols) if len(symbols) <= SHORT else self._queue(symbols)

    def _scan(self, symbols: list[str]) -> list[str]:
        parts, rank_of, never = list(symbols), self.ranks.get, len(self.ranks)
        ranks = [rank_of(pair, never) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), never)
        return parts

    def _queue(self, symbols: list[str]) -> list[str]:
        parts: list[str | None] = list(symbols)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        rank_of = self.ranks.get
        queue = [
            (rank, i, parts[i], parts[i + 1])
            for i in range(len(parts) - 1)
            if (rank := rank_of((parts[i], parts[i + 1]))) is not None
        ]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts):
                    rank = rank_of((parts[a], parts[b]))
                    if rank is not None:
                        heapq.heappush(queue, (rank, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]


class Transducer:
    """Reads the bytes of one word and emits its tokens once they are stable."""

    def __init__(self, table: MergeTable) -> None:
        self.table = table
        self.buffer: list[str] = []

    def read(self, data: bytes) -> list[str]:
        """Tokens that no further byte can change."""
        letters, out = self.table.letters, []
        for start in range(0, len(data), READ):
            self.buffer.extend(letters[b] for b in data[start : start + READ])
            # the last symbol is uncertain too: it may be the last of the word
            certain = len(self.buffer) - 1 - self.table.lookahead
            if certain >= READ:
                out += self._emit(certain)
        return out

    def _emit(self, certain: int) -> list[str]:
        out, end = [], 0
        for token in self.table.merged(self.buffer[:-1]):
            end += self.table.sizes[token]
            if end > certain:
                end -= self.table.sizes[token]
                break
            out.append(token)
        del self.buffer[:end]
        return out

    def finish(self) -> list[str]:
        if not self.buffer:
            return []
        self.buffer[-1] += self.table.suffix
        out = self.table.merged(self.buffer)
        self.buffer = []
        return out


class Encoder:
    """Encodes texts word by word and remembers frequent words."""

    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part_ids(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            data, table = part.encode(), self.table
            if len(data) <= table.lookahead:  # ends before any token is certain
                symbols = [table.letters[b] for b in data]
                symbols[-1] += table.suffix
                tokens = table.merged(symbols)
            else:
                machine = Transducer(table)
                tokens = machine.read(data) + machine.finish()
            ids = self.table.ids
            known = np.array([ids[t] for t in tokens if t in ids], np.uint32).tobytes()
            if len(part) <= SHORT:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def word_ids(self, word: bytes) -> bytes:
        table, out = self.table, []
        text = word.decode("utf-8", "replace")
        whole = not any(t in text for t in table.special)
        for piece in [text] if whole else table.split_special.split(text):
            if piece in table.special:
                out.append(table.special[piece].to_bytes(4, "little"))
            elif piece:
                out.extend(map(self.part_ids, table.parts(piece)))
        return b"".join(out)

    def text_ids(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        words = raw.split()
        found = list(map(self.words.get, words))
        if None in found:
            fresh: dict[bytes, bytes] = {}
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = fresh.get(word)
                    if ids is None:
                        ids = fresh[word] = self.word_ids(word)
                    found[i] = ids
            if len(self.words) + len(fresh) > REMEMBERED:
                self.words.clear()
            if len(fresh) <= REMEMBERED:
                self.words.update((w, i) for w, i in fresh.items() if len(w) <= SHORT)
        return b"".join(found)


class TextMachine:
    """Turns bytes into text as they come; keeps only the open character."""

    def __init__(self) -> None:
        self._decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def read(self, data: bytes) -> str:
        return self._decoder.decode(data)

    def finish(self) -> str:
        return self._decoder.decode(b"", True)


def decoded(ids: np.ndarray, table: MergeTable) -> str:
    """The text of a list of ids; unknown ids are left out."""
    machine, out, tokens, known = TextMachine(), [], table.tokens, len(table.tokens)
    for start in range(0, len(ids), DECODED):
        some = ids[start : start + DECODED]
        if some.size and (some.min() < 0 or some.max() >= known):
            some = some[(some >= 0) & (some < known)]
        joined = table.gap.join([tokens[i] for i in some.tolist()])
        out.append(machine.read(table.gap + joined if start and joined else joined))
    return "".join(out) + machine.finish()


# what a Python worker keeps between tasks, by vocabulary path
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode_batches(batches, path):
    encoder = _encoder(path)
    for batch in slices(batches):
        rows = [encoder.text_ids(raw) for raw in bytes_of(batch.column("text"))]
        ends = np.cumsum([0] + [len(r) // 4 for r in rows])
        values = pa.array(np.frombuffer(b"".join(rows), np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
            ["doc_id", "ids"],
        )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(
        partial(_encode_batches, path=path), "doc_id long, ids array<int>"
    )


def _decode_batches(batches, path):
    table = _encoder(path).table
    for batch in slices(batches):
        column = batch.column("ids")
        texts = []
        for row in column:
            values = row.values
            texts.append(decoded(values.drop_null().to_numpy(), table) if values is not None else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), column, pa.array(texts, pa.string())],
            ["doc_id", "ids", "decoded"],
        )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row with an ``ids`` array; no shuffle."""
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decode_batches, path=path), "doc_id long, ids array<int>, decoded string"
    )


def digests(texts: DataFrame) -> DataFrame:
    """Counts and digests of decoded rows."""
    return texts.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
