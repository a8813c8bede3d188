"""Reply streams: cumulative text per key, as a batch job and as a streaming job.

Chunks of a key are numbered 0, 1, 2, ... A length limit, ``max_chunks``, may be given;
chunks past it are dropped before the shuffle. A null text counts as empty.

Texts may be strings or bytes. Chunks of bytes may be cut anywhere, inside characters too: a
reply is emitted where its bytes are whole characters, so it never shows a replacement
character; after bytes that no continuation makes valid nothing more is emitted. In strings a
decoder has marked incomplete pieces already; such a piece is not emitted by itself but is part
of the next emission.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from steerframe.operators.skew import attach
from steerframe.schemas import require

# Fixed value: the character a decoder shows for bytes that are not complete yet.
INCOMPLETE = "\ufffd"

CHUNK_COLUMNS = ["key", "seq", "ts", "text"]

# Chunks of a block of the batch job, and the blocks that a longer reply is cut into at most:
# its blocks are wider instead, as each has a copy of all text before it.
BLOCK = 1024
REPLY_BLOCKS = 128

# Bytes of replies that one task makes of a block, and the tasks a block is cut into at most,
# as each has a copy of the text of the block and before it.
SLICE_BYTES = 2**33
BLOCK_SLICES = 8


def _is_bytes(chunks: DataFrame) -> bool:
    return isinstance(chunks.schema["text"].dataType, T.BinaryType)


def within_cap(chunks: DataFrame, max_chunks: int | None = None, stop_at=None) -> DataFrame:
    """Chunks that may belong to a reply: under the cap, if any, and before a global stop."""
    require(chunks, CHUNK_COLUMNS, "accumulate")
    empty = F.lit("").cast(chunks.schema["text"].dataType)
    kept = chunks.select(
        "key",
        "seq",
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce("text", empty).alias("text"),
    ).filter(F.col("seq") >= 0)
    if max_chunks is not None:
        kept = kept.filter(F.col("seq") < max_chunks)
    return kept if stop_at is None else kept.filter(F.col("ts") < F.lit(stop_at))


def _whole(reply: Column) -> Column:
    """Whether bytes are whole characters, none of them a replacement character."""
    return F.is_valid_utf8(reply) & ~reply.contains(INCOMPLETE)


def block_width(end: Column, block: int) -> Column:
    """The multiple of ``block`` that cuts a reply of ``end`` chunks into few enough blocks."""
    return F.lit(block) * F.greatest(F.lit(1), F.ceil(end / F.lit(block * REPLY_BLOCKS)))


def block_slices(place: Column, width: Column, end: Column, size: Column) -> Column:
    """How many tasks make the replies of a block, if a reply of ``end`` chunks has ``size`` bytes."""
    made = F.least(F.lit(1.0), (place + 1) * width / end) * size * width
    return F.least(F.lit(BLOCK_SLICES), F.greatest(F.lit(1), F.ceil(made / F.lit(SLICE_BYTES)))).cast("int")


def accumulate_batch(
    chunks: DataFrame,
    stop_marker: str,
    max_chunks: int | None = None,
    hold_incomplete: bool = True,
    stop_at=None,
    block: int = BLOCK,
    length: str | None = None,
) -> DataFrame:
    """The reply of each key as it stood at every emitted chunk.

    A reply ends before its stop marker. Of chunks with the same number the earliest
    counts, and nothing after a missing number is emitted. Without ``hold_incomplete``
    strings are emitted with their incomplete pieces. ``length`` names a column for the
    characters of each reply, which are summed over its chunks, as to count them in its text
    takes longer than to make it; only behind a chunk that is not valid by itself are they counted.

    A key's chunks are cut into blocks of ``block`` numbers, or of a multiple of it where a
    reply would have more than ``REPLY_BLOCKS``. A block's chunks become one string, the
    strings of the blocks before it its prefix, and a reply is that prefix and a piece of the
    block's string, up to the offset of its chunk. So a task holds a block, or a prefix that
    some reply needs anyway, but never all chunks of a key; and what is shuffled is at most
    some ``REPLY_BLOCKS`` times the chunks, or ``REPLY_BLOCKS * BLOCK_SLICES`` times where
    replies are very long, however long a reply is.

    The replies themselves are far more than what is shuffled for them, so they are made by a task
    for each shuffle partition of the session (adaptive execution would leave about one for each
    core, of very different work), and a block with more than ``SLICE_BYTES`` of them by several.
    """
    as_bytes = _is_bytes(chunks)
    rows = (
        within_cap(chunks, max_chunks, stop_at)
        .groupBy("key", "seq").agg(F.min(F.struct("ts", "text")).alias("_first"))
        .select(
            "key", "seq", F.floor(F.col("seq") / F.lit(block)).cast("long").alias("_block"),
            F.col("_first.text").cast("binary").alias("_text"),
        )
    )
    inside = Window.partitionBy("key", "_block").orderBy("seq")
    rows = rows.withColumn(
        # no number is missing in the block up to here
        "_joined", F.col("seq") == F.col("_block") * block + F.row_number().over(inside) - 1
    ).filter("_joined")
    is_stop = F.col("_text") == F.lit(stop_marker).cast("binary")
    blocks = rows.groupBy("key", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(is_stop, F.col("seq"))).alias("_stop"),
        F.sum(F.length("_text")).alias("_bytes"),
    )
    # one short row for a block of chunks
    full = F.col("_n") == block
    place = F.row_number().over(Window.partitionBy("key").orderBy("_block")) - 1
    ends = (
        blocks.withColumn("_place", place)
        .groupBy("key")
        .agg(
            F.min(
                F.least(F.col("_stop"), F.when(~full, F.col("_block") * block + F.col("_n")))
            ).alias("_end"),
            F.count_if(F.col("_place") == F.col("_block")).alias("_blocks"),
            F.sum("_bytes").alias("_bytes"),
        )
        .select(
            "key", F.least("_end", F.col("_blocks") * block).alias("_end"), "_bytes"
        )
    )
    ends = ends.withColumn("_width", block_width(F.col("_end"), block))
    as_text = F.col("_text").cast("string")
    live = (
        attach(rows.drop("_joined"), ends, ["key"], "inner")
        .filter(F.col("seq") < F.col("_end"))
        .withColumn("_block", F.floor(F.col("seq") / F.col("_width")).cast("long"))
        .withColumn("_slices", block_slices(*(F.col(c) for c in ("_block", "_width", "_end", "_bytes"))))
        # not a number where a chunk may end inside a character, and so in every sum with it
        .withColumn(
            "_chars", F.when(F.is_valid_utf8(as_text), F.length(as_text)).otherwise(F.lit(math.nan))
        )
    )
    offsets = live.select(
        "key", "seq", "_block", "_text",
        F.floor(F.col("seq") % F.col("_width") * F.col("_slices") / F.col("_width")).cast("int").alias("_slice"),
        F.sum(F.length("_text")).over(inside).alias("_offset"),
        F.sum("_chars").over(inside).alias("_chars"),
    )
    if hold_incomplete and not as_bytes:
        offsets = offsets.filter(~as_text.contains(INCOMPLETE))
    strings = live.groupBy("key", "_block").agg(
        F.expr("listagg(_text) WITHIN GROUP (ORDER BY seq)").alias("_string"),
        F.sum("_chars").alias("_string_chars"), F.max("_slices").alias("_slices"),
        F.max("_end").alias("_end"), F.max("_width").alias("_width"),
    )
    last = F.floor((F.col("_end") - 1) / F.col("_width")).cast("long")
    prefixes = (
        strings.filter(F.col("_block") < last)
        .select(
            "key", F.col("_block").alias("_from"), "_string", "_string_chars",
            F.explode(F.sequence(F.col("_block") + 1, last)).alias("_block"),
        )
        .groupBy("key", "_block")
        .agg(
            F.expr("listagg(_string) WITHIN GROUP (ORDER BY _from)").alias("_prefix"),
            F.sum("_string_chars").alias("_prefix_chars"),
        )
        # a row's strings, other than its bytes, are read where they are
        .withColumn("_prefix", F.col("_prefix").cast("string"))
    )
    slices = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    per_slice = attach(strings, prefixes, ["key", "_block"]).select(
        "key", "_block", slices, "_string", "_prefix", "_prefix_chars"
    )
    # by a name that is never null, so that the join takes the rows as they are dealt here
    unit = F.struct("key", "_block", "_slice").alias("_unit")
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = offsets.select(unit, "key", "seq", "_offset", "_chars").repartition(tasks, "_unit")
    per_slice = per_slice.select(unit, "_string", "_prefix", "_prefix_chars")
    piece = F.substring("_string", F.lit(1), F.col("_offset").cast("int"))
    reply = F.concat(F.coalesce("_prefix", F.lit("")), piece.cast("string"))
    replies = dealt.join(per_slice, "_unit", "left").select(
        "key", "seq", reply.alias("reply"),
        (F.coalesce("_prefix_chars", F.lit(0.0)) + F.col("_chars")).alias("_chars"),
    )
    if as_bytes:
        replies = replies.filter(_whole(F.col("reply")))
    if length is None:
        return replies.select("key", "seq", "reply")
    counted = F.nanvl("_chars", F.length("reply").cast("double")).cast("long")
    return replies.select("key", "seq", "reply", counted.alias(length))


OUTPUT_SCHEMA = "key long, seq long, reply string"
STATE_SCHEMA = (
    "latest long, texts array<binary>, times array<long>,"
    " waiting_seq array<long>, waiting_text array<binary>, waiting_time array<long>"
)


def _emissions(
    texts: list[bytes], start: int, stop_marker: bytes, as_bytes: bool, hold_incomplete: bool
) -> Iterator[tuple[int, str]]:
    """(number, reply) of each chunk from ``start`` on at which a reply is emitted."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    parts: list[str] = []
    for seq, text in enumerate(texts):
        if text == stop_marker:
            return
        try:
            piece = decoder.decode(text)
        except UnicodeDecodeError:
            return
        if as_bytes and INCOMPLETE in piece:
            return
        parts.append(piece)
        pending = bool(decoder.getstate()[0])
        held = pending or (hold_incomplete and not as_bytes and INCOMPLETE in piece)
        if seq >= start and not held:
            parts = ["".join(parts)]
            yield seq, parts[0]


def _advance(stop_marker: str, as_bytes: bool, hold_incomplete: bool, keep_ms: int):
    marker = stop_marker.encode()

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest, texts, times, waiting = 0, [], [], {}
        if state.exists:
            latest, texts, times, *late = state.get
            texts, times = [bytes(t) for t in texts], list(times)
            waiting = {seq: (ts, bytes(text)) for seq, text, ts in zip(*late)}
        before, first = list(texts), len(texts)
        for batch in batches:
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            for seq, ts, text in zip(batch["seq"], batch["ts"], batch["text"]):
                seq, ts = int(seq), ts.value
                text = bytes(text) if as_bytes else text.encode()
                # of chunks with the same number the earliest counts, whenever it arrives
                if seq < len(texts):
                    if (ts, text) < (times[seq], texts[seq]):
                        times[seq], texts[seq] = ts, text
                        first = min(first, seq)
                elif seq not in waiting or (ts, text) < waiting[seq]:
                    waiting[seq] = (ts, text)
        while len(texts) in waiting:
            ts, text = waiting.pop(len(texts))
            times.append(ts)
            texts.append(text)
        rules = (marker, as_bytes, hold_incomplete)
        out = dict(_emissions(texts, first, *rules))
        if first < len(before):
            # what was emitted and does not hold any more is taken back
            out |= {seq: None for seq, _ in _emissions(before, first, *rules) if seq not in out}
        state.update((
            latest, texts, times,
            list(waiting), [text for _, text in waiting.values()], [ts for ts, _ in waiting.values()],
        ))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(
            {
                "key": pd.Series([key[0]] * len(out), dtype="int64"),
                "seq": pd.Series(list(out), dtype="int64"),
                "reply": pd.Series(list(out.values()), dtype="object"),
            }
        )

    return advance


def accumulate_stream(
    chunks: DataFrame,
    stop_marker: str,
    max_chunks: int | None = None,
    hold_incomplete: bool = True,
    stop_at=None,
    late: str = "10 minutes",
    keep_ms: int = 3_600_000,
) -> DataFrame:
    """The same for a stream, emitted chunk by chunk.

    Chunks may arrive out of order: one that is ahead waits in the key's state. If a chunk
    arrives whose number had been taken by a later copy, the replies from there on come
    again, with null where nothing is emitted any more; so the last row of each (key, seq)
    holds, as ``streaming.keyed`` keeps it. A key's state goes when the watermark is
    ``keep_ms`` past its last chunk. Chunks later than ``late`` are dropped, which the
    query's progress counts as ``numRowsDroppedByWatermark``.
    """
    capped = within_cap(chunks, max_chunks, stop_at).withWatermark("ts", late)
    return capped.groupBy("key").applyInPandasWithState(
        _advance(stop_marker, _is_bytes(chunks), hold_incomplete, keep_ms),
        OUTPUT_SCHEMA,
        STATE_SCHEMA,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _rates(grouped, prior: str | None) -> DataFrame:
    seconds = (
        F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    ) / F.lit(1_000_000)
    aggregates = [
        seconds.alias("seconds"),
        F.count(F.lit(1)).alias("items"),
        F.try_divide(F.count(F.lit(1)).cast("double"), seconds).alias("items_per_second"),
    ]
    if prior:
        aggregates.append(F.max(prior).alias("prior_size"))
    return grouped.agg(*aggregates)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def throughput(events: DataFrame, key: list[str], prior: str | None = None) -> DataFrame:
    """Seconds, new items, items per second and prior size of each run."""
    require(events, [*key, "ts", *([prior] if prior else [])], "throughput")
    return _rates(_timed(events).groupBy(*key), prior)


def throughput_stream(
    events: DataFrame, key: list[str], width: str, late: str, prior: str | None = None
) -> DataFrame:
    """The same per tumbling window of a stream.

    Run in update mode, a window is reported at each change, those still open at the end
    included; in append mode once the watermark has closed it.
    """
    require(events, [*key, "ts"], "throughput_stream")
    windowed = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), *key)
    return _rates(windowed, prior)
