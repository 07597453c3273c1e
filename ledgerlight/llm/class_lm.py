"""Brown class-based bigram model of a corpus, with exchange clustering.

A text's probability is the product over its tokens of the next class given
the last and the word given its class, mixed with the plain word frequency.

- Words are counted over the whole training part. The most frequent ones, a
  fixed number, are known to every task by a number; the rest stays in a table that
  the texts' rare words are joined with, so no vocabulary is broadcast whole.
- Texts are read twice: to count words, and to write them as numbers, with the
  rare words of each beside them. All later passes read the numbers.
- Exchange: neighbouring pairs of known words are counted over all training text and
  dealt out by word. In turns, a part of the words moves, each by itself, to the class that
  fits best the classes beside it; the driver sees moves and a classes x classes table.
  It ends when no word moves or the turns are over; the likeliest classes are kept.
- Each rare word is then put into the class that fits best the known words
  beside it in all training text, as Brown clustering does with words that come after
  the commonest. Rare words without a known neighbour share the class of unseen words,
  the one that holds most of the rarest words.

Null and empty texts have the end token alone. Tokens that no training text
has share the reserved mass. Without training text every score is 0. Repeated
rows are scored alike and each keeps its row; a missing id counts as training
text unless the hash of the empty text says otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import documents, remainder, settled, wide, words_of
from ledgerlight.session import settle

#: Words every task knows, and classes; class 0 holds the end alone.
KNOWN, CLASSES = 200_000, 32
LONGEST = 64
TURNS = 8
MIX = 0.8
END = b""
FLUSH = 400_000
#: Tokens that a task sorts at a time, tokens for each part of the table of neighbours, blocks of a part joined at a time.
SLICE, PAIRS, PIECES = 1_000_000, 500_000, 64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        counts[END] += batch.num_rows
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    yield out()
    counts.clear()
    pa.default_memory_pool().release_unused()


@dataclass
class Vocabulary:
    """The frequent words by number, from 1 (0 is the end), their counts, and the totals of all training text."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int


# ---- texts as numbers ------------------------------------------------------------------------

CODED = "row long, doc_id long, train boolean, codes binary, rare array<binary>, logs double"


def _coded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, text, train) as numbers of known words, -1, -2, .. for a text's own rare words."""
    numbers, row = vocabulary.numbers, TaskContext.get().partitionId() << 33
    logs = np.log10(vocabulary.counts + 0.1)
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.float64()]
    names = [part.split()[0] for part in CODED.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, out = batch.slice(at, 512), []
            for doc_id, text, train in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                words = words_of(text.as_py())
                codes = np.fromiter(map(numbers.get, words, repeat(0)), np.int32, len(words))
                new, rare = np.flatnonzero(codes == 0), {}
                total = float(logs[codes].sum()) - len(new) * float(logs[0]) + float(logs[0])
                if len(new):
                    codes[new] = [-1 - rare.setdefault(words[p], len(rare)) for p in new.tolist()]
                out.append((row, doc_id, train, codes.tobytes(), list(rare), total))
                row += 1
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out), types)], names)
    pa.default_memory_pool().release_unused()


def _slices(codes: pa.Array) -> Iterator[np.ndarray]:
    """Texts end to end, an end before and after each, some millions of tokens at a time."""
    held, size = [], 0
    for text in codes:
        found = np.frombuffer(text.as_py(), np.int32)
        held += [np.zeros(1, np.int32), found]
        size += len(found) + 1
        if size > SLICE:
            yield np.concatenate([*held, np.zeros(1, np.int32)])
            held, size = [], 0
    if held:
        yield np.concatenate([*held, np.zeros(1, np.int32)])


# ---- exchange of the known words ---------------------------------------------------------------


NEAR = "part int, piece int, pairs binary"


def _pressed(ends: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs sorted by their ends in few bytes: differences, equal places of all numbers together."""
    turned = [np.diff(ends, prepend=0).astype("<i4"), np.diff(other, prepend=0).astype("<i4"), n.astype("<i8")]
    planes = b"".join(a.view(np.uint8).reshape(len(n), -1).T.tobytes() for a in turned)
    return np.int64(len(n)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _spelled(found: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, other words and counts of pairs that ``_pressed`` put together."""
    size = int(np.frombuffer(found, np.int64, 1)[0])
    planes = np.frombuffer(pa.decompress(memoryview(found)[8:], 16 * size, "zstd"), np.uint8).reshape(16, size)
    parts = (np.ascontiguousarray(planes[a:b].T).view(t).ravel() for a, b, t in ((0, 4, "<i4"), (4, 8, "<i4"), (8, 16, "<i8")))
    ends, other, n = parts
    return ends.cumsum(dtype=np.int32), other.cumsum(dtype=np.int32), n


def _paired(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring known words, both ways: word and side (0: the other is on its left), other word, count."""
    piece = TaskContext.get().partitionId()
    for batch in batches:
        for codes in _slices(batch.column(0)):
            codes = codes.astype(np.int64)
            both = (codes[:-1] >= 0) & (codes[1:] >= 0)
            pair, n = np.unique(codes[:-1][both] << 32 | codes[1:][both], return_counts=True)
            left, right = (pair >> 32).astype(np.int32), pair.astype(np.int32)
            back = np.argsort(right, kind="stable")
            ends = np.concatenate([left * 2 + 1, right[back] * 2])
            other, n = np.concatenate([right, left[back]]), np.concatenate([n, n[back]])
            part = (ends >> 1) % parts
            order = np.argsort(part.astype(np.uint16), kind="stable")
            ends, other, n, sizes = ends[order], other[order], n[order], np.bincount(part)
            stop, here = np.cumsum(sizes), np.flatnonzero(sizes)
            blocks = [_pressed(*(a[stop[k] - sizes[k] : stop[k]] for a in (ends, other, n))) for k in here]
            yield pa.record_batch(
                [pa.array(here, pa.int32()), pa.array([piece] * len(here), pa.int32()), pa.array(blocks, pa.binary())], ["part", "piece", "pairs"]
            )
    pa.default_memory_pool().release_unused()


def _together(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a table of ``NEAR``, each once, sorted."""
    ends, other, n = (np.concatenate(c) for c in zip(*map(_spelled, table.column("pairs").to_pylist())))
    key = ends.astype(np.int64) << 32 | other
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return (key[first] >> 32).astype(np.int32), key[first].astype(np.int32), np.add.reduceat(n[order], first)


def _merged(table: pa.Table) -> pa.Table:
    """The pairs of a group of pieces in one row."""
    return table.slice(0, 1).select(["part", "piece"]).append_column("pairs", pa.array([_pressed(*_together(table))], pa.binary()))


def neighbours(coded: DataFrame, tokens: int) -> DataFrame:
    """One row per part of the known words, with all pairs these are in. The end counts as a word, a rare word doesn't.

    A word is in at most two pairs for each known word, so a part is bounded.
    Tasks send blocks of pairs; no more than ``PIECES`` blocks of a part are joined at a time.
    """
    parts = min(max(wide(coded.sparkSession), tokens // PAIRS), 1 << 15)
    found = coded.filter("train").select("codes").mapInArrow(partial(_paired, parts=parts), NEAR)
    pieces = wide(coded.sparkSession) + tokens // SLICE
    while pieces > PIECES:
        pieces = -(-pieces // PIECES)
        dealt = found.withColumn("piece", F.pmod(F.xxhash64("piece", "pairs"), F.lit(pieces)).cast("int"))
        found = dealt.groupBy("part", "piece").applyInArrow(_merged, NEAR)
    return settled(found.groupBy("part").applyInArrow(_merged, NEAR).select("pairs"))


def _profiles(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words, and how often each class is on the left (0) and right (1) of each."""
    for batch in batches:
        for pairs in batch.column(0):
            ends, other, n = _spelled(pairs.as_py())
            word = ends >> 1
            words = word[np.flatnonzero(np.diff(word, prepend=-1))]
            at = np.cumsum(np.diff(word, prepend=word[0]) > 0)
            place = (at * 2 + (ends & 1)) * CLASSES + classes[other]
            yield words, np.bincount(place, n, len(words) * 2 * CLASSES).reshape(-1, 2, CLASSES)


def _class_pairs(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((CLASSES, CLASSES))
    for words, beside in _profiles(batches, classes):
        np.add.at(sums, classes[words], beside[:, 1])
    yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def _added(df: DataFrame, work) -> np.ndarray:
    """Sum of the classes x classes tables that the tasks of ``work`` make."""
    out = np.zeros((CLASSES, CLASSES))
    for r in df.mapInArrow(work, "sums binary").toLocalIterator():
        out += np.frombuffer(r["sums"]).reshape(CLASSES, CLASSES)
    return out


def _gains(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the next class given the last, and log share of the next classes."""
    table = table + 0.5
    return np.log(table / table.sum(axis=1, keepdims=True)), np.log(table.sum(axis=1) / table.sum())


def _fit(left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How well each class fits words with these counts of classes beside them; the end's own class never does."""
    gain, weight = _gains(table)
    fit = left @ (gain - weight[None, :]) + right @ gain.T
    fit[:, 0] = -np.inf
    return fit


def _moves(batches: Iterator[pa.RecordBatch], classes: np.ndarray, table: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
    """Words of the turn's part that fit another class better than their own, and that class."""
    for words, beside in _profiles(batches, classes):
        fit = _fit(beside[:, 0], beside[:, 1], table)
        best, here = fit.argmax(axis=1), np.arange(len(words))
        part = (words.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(3)
        moved = (part == turn % 3) & (words > 0) & (fit[here, best] > fit[here, classes[words]] + 1e-9)
        yield pa.record_batch(
            [pa.array([words[moved].tobytes()], pa.binary()), pa.array([best[moved].astype(np.uint8).tobytes()], pa.binary())],
            ["words", "classes"],
        )


def likelihood(table: np.ndarray) -> float:
    """What the classes add to the log likelihood of the pairs they were counted from."""
    whole, last, following = (np.maximum(x, 1e-300) for x in (table, table.sum(axis=1), table.sum(axis=0)))
    return float((table * (np.log(whole) - np.log(last)[:, None] - np.log(following))).sum())


def exchange(near: DataFrame, size: int, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each known word (0 is the end, in class 0) and the counts of class pairs.

    A third of the words, by hash, may move in a turn: words that move at once
    judge each other by their old classes.
    """
    classes = np.zeros(size, np.uint8)
    classes[1:] = 1 + np.arange(size - 1) % (CLASSES - 1)
    table = _added(near, partial(_class_pairs, classes=classes))
    best, still = (likelihood(table), classes, table), 0
    for turn in range(turns):
        moves = near.mapInArrow(partial(_moves, classes=classes, table=table, turn=turn), "words binary, classes binary").toPandas()
        words = np.frombuffer(b"".join(moves["words"]), np.int32)
        still = 0 if len(words) else still + 1
        if still == 3:
            break
        if len(words):
            classes = classes.copy()
            classes[words] = np.frombuffer(b"".join(moves["classes"]), np.uint8)
            table = _added(near, partial(_class_pairs, classes=classes))
            best = max(best, (likelihood(table), classes, table), key=lambda x: x[0])
    return best[1], best[2]


# ---- classes of the rare words -------------------------------------------------------------------

#: Class of a neighbour that has none yet.
OPEN = CLASSES


def _contexts(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each occurrence of a rare word with the classes on both sides, as one number."""
    for batch in batches:
        words, beside = [], []
        for text, rare in zip(batch.column(0), batch.column(1).to_pylist()):
            codes = np.frombuffer(text.as_py(), np.int32)
            own = np.full(len(codes) + 2, 0, np.int32)
            own[1:-1] = np.where(codes < 0, OPEN, classes[np.maximum(codes, 0)])
            at = np.flatnonzero(codes < 0)
            words.extend(map(rare.__getitem__, (-1 - codes[at]).tolist()))
            beside.append(own[at] * (CLASSES + 1) + own[at + 2])
        yield pa.record_batch(
            [pa.array(words, pa.binary()), pa.array(np.concatenate(beside) if beside else [], pa.int32())], ["word", "beside"]
        )


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and best class of each rare word; no class where none of its neighbours has one."""
    gain, weight = _gains(table)
    fit = np.zeros((CLASSES + 1, CLASSES + 1, CLASSES))
    fit[:CLASSES] += (gain - weight[None, :])[:, None, :]
    fit[:, :CLASSES] += gain.T
    fit[..., 0] = -np.inf
    fit = fit.reshape(-1, CLASSES)
    for batch in batches:
        for k in range(0, batch.num_rows, 2_000):
            part = batch.slice(k, 2_000)
            lists = part.column(1)
            beside = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            at, n = (beside.field(c).to_numpy(zero_copy_only=False) for c in range(2))
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total = np.add.reduceat(fit[at] * n[:, None], start)
            known = np.add.reduceat((at != len(fit) - 1).astype(int), start) > 0
            yield pa.record_batch(
                [part.column(0), pa.array(np.add.reduceat(n, start)), pa.array(total.argmax(axis=1).astype(np.int32), mask=~known)],
                ["word", "n", "class"],
            )


def rare_words(coded: DataFrame, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """word, n and class (null: no neighbour tells) of the training words that tasks don't know."""
    seen = coded.filter("train and size(rare) > 0").select("codes", "rare")
    found = seen.mapInArrow(partial(_contexts, classes=classes), "word binary, beside int").repartition("word")
    summed = found.groupBy("word", "beside").agg(F.count("*").alias("n"))
    # At most one entry per pair of classes.
    lists = summed.groupBy("word").agg(F.collect_list(F.struct("beside", "n")).alias("beside"))
    return settled(lists.mapInArrow(partial(_placed, table=table), "word binary, n long, class int"))


def _compact(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Codes as a byte a token, and the places in the text's list of its rare tokens."""
    for batch in batches:
        own, at = [], []
        for text in batch.column(3):
            codes = np.frombuffer(text.as_py(), np.int32)
            own.append(np.where(codes < 0, OPEN, classes[np.maximum(codes, 0)]).astype(np.uint8).tobytes())
            at.append((-1 - codes[codes < 0]).astype(np.int32).tobytes())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.binary()), pa.array(at, pa.binary()), batch.column(5)],
            ["row", "doc_id", "train", "classes", "at", "logs"],
        )


def _filled(batches: Iterator[pa.RecordBatch], unseen: int, ended: bool) -> Iterator[pa.RecordBatch]:
    """Class of every token, the end before and behind; tokens, those known, and the sum of their logs."""
    for batch in batches:
        own, size, known, logs = [], [], [], []
        columns = (batch.column(c) for c in ("classes", "at", "rare"))
        for codes, at, rare, log in zip(*columns, batch.column("logs").to_pylist()):
            found = np.frombuffer(codes.as_py(), np.uint8).copy()
            here = np.frombuffer(at.as_py(), np.int32)
            missing = 0
            if len(here):
                given = rare.values
                order = given.field(0).to_numpy()
                kind, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                kind[order] = given.field(1).fill_null(unseen).to_numpy()
                n[order] = given.field(2).fill_null(0).to_numpy()
                found[found == OPEN] = kind[here]
                missing = int((n[here] == 0).sum())
                log += float(np.log10(n[here] + 0.1).sum())
            own.append(b"\0" + found.tobytes() + b"\0")
            size.append(len(found) + 1)
            known.append(len(found) - missing + ended)
            logs.append(log)
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("train"), pa.array(own, pa.binary()), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64())],
            ["doc_id", "train", "classes", "n_tokens", "n_known", "logs"],
        )


def classified(coded: DataFrame, classes: np.ndarray, rare: DataFrame, unseen: int, ended: bool) -> DataFrame:
    """The texts as classes, those of their rare words joined in."""
    compact = coded.mapInArrow(
        partial(_compact, classes=classes), "row long, doc_id long, train boolean, classes binary, at binary, logs double"
    )
    asked = coded.filter("size(rare) > 0").select("row", F.posexplode("rare").alias("place", "word"))
    given = (
        asked.join(rare, "word", "left")
        .groupBy("row")
        .agg(F.collect_list(F.struct("place", F.col("class"), F.col("n"))).alias("rare"))
    )
    joined = compact.join(given, "row", "left")
    schema = "doc_id long, train boolean, classes binary, n_tokens long, n_known long, logs double"
    return settled(joined.mapInArrow(partial(_filled, unseen=unseen, ended=ended), schema))


# ---- the model --------------------------------------------------------------------------------------


def commonest(counts: DataFrame, most: int) -> list:
    """Rows (word, n) above the least count that leaves at most ``most`` of them.

    The cut comes from the counts of counts, so no task sends more than its own
    share of these rows; words that tie at the cut are left out together.
    """
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per distinct count.
    sizes = settle(counts.groupBy("n").agg(F.count("*").alias("words")))
    cut = sizes.withColumn("upto", F.sum("words").over(above)).filter(F.col("upto") > most).agg(F.max("n")).first()[0]
    return counts.filter(F.col("n") > (cut or 0)).select("word", "n").collect()


def vocabulary_of(training: DataFrame) -> Vocabulary:
    """The known words and the totals, from a frame with a ``text`` column."""
    words = training.select("text").mapInArrow(_counted, "word binary, n long")
    counts = settled(words.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    known = sorted(commonest(counts.filter(F.length("word").between(1, LONGEST)), KNOWN), key=lambda r: (-r["n"], r["word"]))
    ends = counts.filter(F.length("word") == 0).collect()
    return Vocabulary(
        {bytes(r["word"]): 1 + k for k, r in enumerate(known)},
        np.array([ends[0]["n"] if ends else 0, *[r["n"] for r in known]], np.int64),
        tokens or 0,
        distinct,
    )


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(CLASSES * CLASSES)
    for batch in batches:
        for text in batch.column(0):
            own = np.frombuffer(text.as_py(), np.uint8).astype(np.int64)
            sums += np.bincount(own[:-1] * CLASSES + own[1:], minlength=CLASSES * CLASSES)
    yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def _steps(batches: Iterator[pa.RecordBatch], steps: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(1):
            own = np.frombuffer(text.as_py(), np.uint8)
            found.append(float(steps[own[:-1], own[1:]].sum()))
        columns = [batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")]
        yield pa.record_batch([*columns, pa.array(found, pa.float64())], ["doc_id", "n_tokens", "n_known", "logs", "steps"])


def score(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row (doc_id, text, train)."""
    vocabulary = vocabulary_of(rows.filter("train"))
    coded = settled(rows.select("doc_id", "text", "train").mapInArrow(partial(_coded, vocabulary=vocabulary), CODED))
    classes, table = exchange(neighbours(coded, vocabulary.tokens), len(vocabulary.counts))
    rare = rare_words(coded, classes, table)

    # Tokens and distinct words of each class; class and words seen once of the rare ones.
    own = np.zeros((CLASSES, 2))
    np.add.at(own, classes, np.stack([vocabulary.counts, vocabulary.counts > 0], axis=1))
    held = rare.groupBy("class").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).collect()
    unseen = max(((once, words, -k) for k, _, words, once in held if k is not None), default=(0, 0, -1))[2] * -1
    for k, n, words, _ in held:
        own[unseen if k is None else k] += n, words

    texts = classified(coded, classes, rare, unseen, bool(vocabulary.counts[0]))
    whole = _added(texts.filter("train").select("classes"), _transitions)
    moved = (whole + 0.5) / (whole.sum(axis=1, keepdims=True) + 0.5 * CLASSES)
    within = own[:, 0] + 0.1 * (own[:, 1] + 1)
    plain = vocabulary.tokens + 0.1 * (vocabulary.distinct + 1)
    # log10 of what follows (count + 0.1) in a word's probability, by last and next class.
    steps = np.log10(MIX * moved / within[None, :] + (1 - MIX) / plain)
    if not vocabulary.tokens:
        steps = np.full((CLASSES, CLASSES), 1.0)  # with log10(0.1) for the word: 0
    scored = texts.select("doc_id", "classes", "n_tokens", "n_known", "logs").mapInArrow(
        partial(_steps, steps=steps), "doc_id long, n_tokens long, n_known long, logs double, steps double"
    )
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(plain))).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"),
    )


def perplexity_scores(docs: DataFrame, parts: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model of those whose id's crc32 modulo ``parts`` isn't ``held``."""
    rows = documents(docs, id_col, text_col)
    return score(rows.withColumn("train", remainder("doc_id", parts) != held)).withColumn("held_out", remainder("doc_id", parts) == held)
