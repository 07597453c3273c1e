"""Passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph here is the ``WINDOW`` words from each sentence start on (after
``.``, ``!``, ``?`` or a line end), and from every ``WINDOW``-th word after it
in a longer sentence, so a passage is found wherever it was pasted, in the
middle of a line too. A passage is found from its first sentence start on. Its set is its runs of five words.

1. Two minima to a band, five bands: paragraphs that share 14 of 18 runs (just
   above the threshold) meet with probability 0.99, equal ones always.
2. Paragraphs with equal words form a class. Colliding classes are paired with
   leaders of their bucket and verified by exact Jaccard similarity.
3. Classes of buckets that hold several components by then are joined exactly:
   similar sets must share one of their rarest runs, so classes meet at those
   runs alone, and only links come out. A run that many classes share counts
   for a class that has nothing rarer to show.
4. Components of classes that occur in two documents or more are the removals:
   the document with the least id keeps its passage, the others lose theirs.
   Overlapping paragraphs of one document become one span.

Texts are cut into words by array operations over a batch's bytes, which costs
less than keeping the sketches of all of them, so they are read four times (keys
by document, keys by content, sets, places) and never shuffled. Null texts count
as empty. Texts of fewer than ``WINDOW`` words have no paragraph. A text of any
length is cut whole, in arrays that grow with the longest text alone. A passage repeated inside one document only is left alone. Rows that repeat an id
count as one document. Rows without id are left out, as no report could name
them. An empty table has no spans. Columns but id and text are not looked at, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import documents, matching, mixed, settled
from ledgerlight.llm.components import components

WORDS, WINDOW = 5, 20
WIDTH = WINDOW - WORDS + 1
PERCENT = 75
BANDS, ROWS = 5, 2
#: Bytes of text that are cut at a time, unless one text is longer.
SLICE = 1 << 19
#: Classes that share a run are compared in blocks of so many.
BLOCK = 256
#: Pairs of classes that are compared at a time.
PAIRS = 4096

_SEEDS = mixed(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64))
_FACTORS = mixed(_SEEDS) | np.uint64(1)
_PLACES = mixed(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def _is(chars: bytes) -> np.ndarray:
    """Which of the 256 bytes are among ``chars``."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BLANK, _STOP, _CLOSER = _is(b" \t\n\x0b\x0c\r"), _is(b".!?"), _is(b"\"')]")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Codes of a byte at the first places of a word; further ones are computed.
_BYTES = mixed(np.arange(32 * 256, dtype=np.uint64))


class Paragraphs(NamedTuple):
    """Paragraphs of several texts: their text's number, place in words, place in code points,
    content code, and runs of five words (one row each)."""

    text: np.ndarray
    at: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    content: np.ndarray
    runs: np.ndarray


def _word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit codes of words, A-Z lower-cased, a bounded number of bytes at a time."""
    codes = np.zeros(len(starts), np.uint64)
    lengths = stops - starts
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + SLICE, "right")))
        own = lengths[at:to]
        first = np.cumsum(own) - own
        place = np.arange(own.sum()) - np.repeat(first, own)
        index = place * 256 + _LOWER[data[np.repeat(starts[at:to], own) + place]]
        values = _BYTES[np.minimum(index, len(_BYTES) - 1)]
        late = index >= len(_BYTES)
        if late.any():
            values[late] = mixed(index[late].astype(np.uint64))
        codes[at:to] = mixed(np.add.reduceat(values, first))
        at = to
    return codes


def _sentence_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Words that end in a full stop or the like, with closing quotes and brackets behind it or not."""
    closer = _CLOSER[data]
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] == 0x9D) | (data[2:] == 0x99)))
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xBB))
    for k in range(3):
        closer[three + k] = True
    for k in range(2):
        closer[two + k] = True
    last = np.maximum.accumulate(np.where(closer, -1, np.arange(len(data), dtype=np.int32)))[stops - 1]
    return (last >= starts) & _STOP[data[last]]


def paragraphs(texts: pa.StringArray) -> Paragraphs:
    """The paragraphs of texts, cut all at once."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    none = np.zeros(0, np.int64)
    nothing = Paragraphs(none, none, none, none, none.view(np.uint64), np.zeros((0, WIDTH), np.uint64))
    if not len(data):
        return nothing
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[True], ~inside[:-1]]) | cut[:-1]
    behind = np.concatenate([~inside[1:], [True]]) | cut[1:]
    starts, stops = np.flatnonzero(inside & before), np.flatnonzero(inside & behind) + 1
    if len(starts) < WINDOW:
        return nothing
    text = np.searchsorted(offsets, starts, "right") - 1
    new_text = np.concatenate([[True], text[1:] != text[:-1]])
    lines = np.cumsum(data == 10, dtype=np.int32)
    # A line end between two words ends a sentence too.
    opens = new_text.copy()
    opens[1:] |= _sentence_ends(data, starts, stops)[:-1] | (lines[starts[1:]] > lines[stops[:-1] - 1])
    first = np.flatnonzero(opens)
    # A sentence is cut into as many windows as it takes to cover it.
    steps = -(-np.diff(np.append(first, len(starts))) // WINDOW)
    step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    first = np.repeat(first, steps) + WINDOW * step
    first = first[first <= len(starts) - WINDOW]
    first = first[text[first] == text[first + WINDOW - 1]]
    if not len(first):
        return nothing
    codes = _word_codes(data, starts, stops)
    runs = np.zeros(len(codes) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        runs += mixed(codes[k : k + len(runs)] ^ _PLACES[k]) * _PLACES[k]
    runs = mixed(runs)
    content = mixed((sliding_window_view(codes, WINDOW)[first] * _PLACES).sum(axis=1, dtype=np.uint64))
    points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
    own = text[first]
    opening = np.flatnonzero(new_text)
    head = opening[np.searchsorted(opening, first, "right") - 1]
    base = np.where(offsets[own] > 0, points[np.maximum(offsets[own], 1) - 1], 0)
    return Paragraphs(
        own,
        first - head,
        (points[starts[first]] - 1 - base).astype(np.int64),
        (points[stops[first + WINDOW - 1] - 1] - base).astype(np.int64),
        content,
        sliding_window_view(runs, WIDTH)[first],
    )


def band_keys(runs: np.ndarray) -> np.ndarray:
    """One key for each paragraph (row) and band (column)."""
    keys = np.zeros((len(runs), BANDS), np.uint64)
    for band in range(BANDS):
        for k in range(band * ROWS, (band + 1) * ROWS):
            keys[:, band] = mixed(keys[:, band] + ((runs ^ _SEEDS[k]) * _FACTORS[k]).min(axis=1))
        keys[:, band] = mixed(keys[:, band] ^ np.uint64(band))
    return keys


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Paragraphs]]:
    """Id of each paragraph's document, and paragraphs, for slices of (doc_id, text) of some bytes each."""
    for batch in batches:
        texts = batch.column(1)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids = batch.column(0).to_numpy()
        at = 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            found = paragraphs(texts.slice(at, to - at))
            yield ids[at:to][found.text], found
            at = to


def _banded(other: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, ``other``): each paragraph once per band, with its document or its content."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _cut(batches):
            beside = ids if other == "doc_id" else found.content
            keys = band_keys(found.runs).T.ravel()
            yield pa.record_batch([_longs(keys), _longs(np.tile(beside, BANDS))], ["key", other])

    return rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (content, runs): each paragraph's set."""
    for _, found in _cut(batches):
        content, one = np.unique(found.content, return_index=True)
        flat = found.runs[one].ravel()
        sets = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDTH, np.int32)), _longs(flat))
        yield pa.record_batch([_longs(content), sets], ["content", "runs"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (content, doc_id, at, start, stop): every paragraph with its place."""
    for ids, found in _cut(batches):
        yield pa.record_batch(
            [_longs(found.content), _longs(ids), _longs(found.at), _longs(found.start), _longs(found.stop)],
            ["content", "doc_id", "at", "start", "stop"],
        )


def _ends(pairs: DataFrame) -> DataFrame:
    return settled(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct())


def _sets(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """content and distinct runs of the given classes."""
    found = matching(rows.mapInArrow(_runs, "content long, runs array<long>"), contents, "content")
    return settled(found.groupBy("content").agg(F.array_distinct(F.first("runs")).alias("runs")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets are as similar as asked."""
    first = sets.select(F.col("content").alias("a"), F.col("runs").alias("sa"))
    second = sets.select(F.col("content").alias("b"), F.col("runs").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return settled(
        pairs.join(first, "a")
        .join(second, "b")
        .filter(common * 100 >= (F.size("sa") + F.size("sb") - common) * PERCENT)
        .select("a", "b")
    )


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, row by row; places not taken differ on both sides."""
    same = (left[:, :, None] == right[:, None, :]).reshape(len(left), WIDTH * WIDTH)
    # Eight flags of one byte are added at a time; no count is above WIDTH.
    eights = np.ascontiguousarray(same).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return (eights * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _group_links(table: pa.Table) -> pa.RecordBatch:
    """Links across components in whole groups (run, low, high): two blocks of classes that share a run, or one.

    Pairs of small groups are compared all at once. In larger ones a component that a link
    has joined isn't compared any more. A link is given as the labels of its components.
    """
    keys = [table.column(c).to_numpy() for c in ("run", "low", "high")]
    opens = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    first = np.flatnonzero(opens)
    group = np.cumsum(opens) - 1
    label, block = table.column("label").to_numpy(), table.column("block").to_numpy()
    runs = table.column("runs").combine_chunks()
    size = np.diff(runs.offsets.to_numpy())
    held = np.arange(WIDTH) < size[:, None]
    # Numbers of runs instead of the runs leave room for marks of places not taken.
    sets = np.full((len(table), WIDTH), -1, np.int32)
    sets[held] = np.unique(runs.flatten().to_numpy(), return_inverse=True)[1]
    others = np.where(held, sets, np.int32(-2))
    is_left, is_right = block == keys[1], block == keys[2]
    # Of two blocks the left rows meet all right ones, of one block those behind them.
    place, ends = np.arange(len(table)), np.append(first[1:], len(table))
    rights = np.cumsum(is_right)
    all_right = rights[ends - 1] - np.where(first > 0, rights[first - 1], 0)
    alone = keys[1] == keys[2]
    meets = np.where(is_left, np.where(alone, ends[group] - 1 - place, all_right[group]), 0)
    right = np.flatnonzero(is_right)
    begin = np.where(alone, place + 1, 0)
    begin = np.where(alone, begin, np.searchsorted(right, first)[group])
    pairs = np.add.reduceat(meets, first)
    small = pairs <= PAIRS
    out = []

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        common = _common(sets[i], others[j]).astype(np.int64)
        return 100 * common >= PERCENT * (size[i] + size[j] - common)

    # Small groups, as many at a time as make up some thousand pairs.
    rows = np.flatnonzero(small[group] & (meets > 0))
    total = np.cumsum(meets[rows])
    at = 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        own = meets[rows[at:to]]
        i = np.repeat(rows[at:to], own)
        step = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        j = begin[i] + step
        j = np.where(alone[i], j, right[np.minimum(j, len(right) - 1)])
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        met = linked(i, j)
        out.append((label[i[met]], label[j[met]]))
        at = to
    for g in np.flatnonzero(~small):
        low, high = first[g], ends[g]
        now = label[low:high].copy()
        behind = low + np.flatnonzero(is_right[low:high])
        for i in low + np.flatnonzero(is_left[low:high]):
            j = behind[behind > i] if alone[i] else behind
            j = j[now[j - low] != now[i - low]]
            if not len(j):
                continue
            j = j[linked(np.full(len(j), i), j)]
            met, one = np.unique(now[j - low], return_index=True)
            out.append((np.full(len(one), label[i]), label[j[one]]))
            now[np.isin(now, met)] = now[i - low]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *(x[k] for x in out)]) for k in range(2))
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pa.record_batch([_longs(both[:, 0]), _longs(both[:, 1])], ["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_group_links`` of rows in order of their groups; one cut off by a batch's end waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("run", "low", "high")]
        last = np.all([k == k[-1] for k in keys], axis=0)
        whole = batch.num_rows - int(last.sum())
        if waiting and any(k[0] != waiting[0].column(c)[-1].as_py() for k, c in zip(keys, ("run", "low", "high"))):
            yield _group_links(pa.Table.from_batches(waiting))
            waiting = []
        if whole:
            yield _group_links(pa.Table.from_batches([*waiting, batch.slice(0, whole)]))
            waiting = []
        waiting.append(batch.slice(whole))
    if waiting:
        yield _group_links(pa.Table.from_batches(waiting))


def _through(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links left between the components of buckets that hold several, as their labels.

    ``members`` has key and content. Of a set of s runs, t = ceil(0.75 s) at
    least are shared with any similar one, so the two meet at one of their
    s - t + 1 rarest runs. Runs of one class alone are the rarest and meet nobody.
    """
    labelled = settled(
        members.join(found.withColumnRenamed("node", "content"), "content", "left").withColumn(
            "label", F.coalesce("label", "content")
        )
    )
    open_ = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key")
    left = settled(labelled.join(open_, "key", "left_semi").select("content", "label").distinct().join(sets, "content"))
    spread = left.select("content", F.size("runs").alias("size"), F.explode("runs").alias("run"))
    shared = settled(spread.groupBy("run").agg(F.count("*").alias("times")).filter("times > 1"))
    rare = (
        matching(spread, shared, "run")
        .groupBy("content")
        .agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("times", "run"))).alias("held"))
        .withColumn("most", F.expr(f"size(held) - CAST(ceil({PERCENT} * size / 100.0D) AS INT) + 1"))
        .filter("most > 0")
        .select("content", F.explode(F.expr("slice(held, 1, most)")).alias("one"))
        .select("content", F.col("one.run").alias("run"))
    )
    meeting = settled(rare.join(left.select("content", "label"), "content"))
    several = settled(
        meeting.groupBy("run")
        .agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"))
        .filter("x != y")
        .select("run", F.expr(f"CAST(ceil(size / {BLOCK}.0D) AS INT)").alias("blocks"))
    )
    dealt = (
        meeting.join(several, "run")
        .join(left.select("content", "runs"), "content")
        .withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "run",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "label",
            "runs",
            "block",
        )
    )
    # Groups are small and many, so a batch of them goes to Python at once.
    groups = ["run", "low", "high"]
    met = dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_block_links, "a long, b long")
    return settled(met.distinct())


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, label) after links between labels, which are least nodes, have joined some."""
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("least"))
    moved = found.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    # Classes that were alone until now are their own label.
    alone = joined.select(F.col("label").alias("node"), F.col("least").alias("label")).join(found, "node", "left_anti")
    return settled(moved.unionByName(alone))


def links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes that collide across documents (content), and components of similar ones (node, label).

    ``rows`` has doc_id and text.
    """
    collided = settled(
        rows.mapInArrow(_banded("doc_id"), "key long, doc_id long")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first != last")
        .select("key")
    )
    members = settled(
        matching(rows.mapInArrow(_banded("content"), "key long, content long"), collided, "key").distinct()
    )
    buckets = settled(members.groupBy("key").agg(F.min("content").alias("low"), F.max("content").alias("high")))
    # Only buckets that hold different contents need pairs; equal contents are a class.
    several = settled(members.join(buckets.filter("low != high"), "key"))
    pairs = settled(
        several.select("content", F.explode(F.array("low", "high")).alias("leader"))
        .filter("content != leader")
        .select(F.greatest("content", "leader").alias("a"), F.least("content", "leader").alias("b"))
        .distinct()
    )
    sets = _sets(rows, _ends(pairs))
    linked = _verified(pairs, sets)
    found = components(linked)
    more = _through(several.select("key", "content"), sets, found)
    if not more.isEmpty():
        found = _joined(found, more)
    alike = buckets.filter("low = high").select(F.col("low").alias("content"))
    chosen = alike.unionByName(found.select(F.col("node").alias("content"))).unionByName(several.select("content"))
    return settled(chosen.distinct()), found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, start, stop (code points, stop excluded), n_words, first_doc_id, removed.

    ``first_doc_id`` is the document that keeps the passage; its own span is
    listed with ``removed`` false.
    """
    rows = documents(docs, id_col, text_col).filter("doc_id is not null")
    chosen, found = links(rows)
    places = settled(
        matching(
            rows.mapInArrow(_placed, "content long, doc_id long, at long, start long, stop long"), chosen, "content"
        )
    )
    labels = found.withColumnRenamed("node", "content")
    owned = settled(places.join(labels, "content", "left").withColumn("label", F.coalesce("label", "content")))
    # Written before the join by label, so that a common passage's rows can be split.
    groups = settled(
        owned.groupBy("label")
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
        .filter("first_doc_id != last")
        .drop("last")
    )
    # Paragraphs of a document in order; a gap starts a new span.
    members = owned.join(groups, "label").select("doc_id", "first_doc_id", "at", "start", "stop").distinct()
    order = Window.partitionBy("doc_id", "first_doc_id").orderBy("at")
    opened = members.withColumn(
        "new", (F.col("at") > F.lag("at").over(order) + WINDOW).cast("int")
    ).withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(order))
    return (
        opened.groupBy("doc_id", "first_doc_id", "span")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            (F.max("at") - F.min("at") + WINDOW).alias("n_words"),
        )
        .select(
            "doc_id", "start", "stop", "n_words", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("removed")
        )
    )
