"""Language of a text by cross-parsing it against a sample of each language.

For every language a suffix automaton accepts all substrings of a bounded
sample of its labelled texts. A text is cut greedily into phrases, each the
longest match that the automaton follows from its start; a text is close to a
language that needs few phrases. Counts are normalised by the size of the
sample: a phrase costs log2 of the sample's length, the price of pointing into
it. The cheapest language wins.

Texts are lower-cased; whatever is no letter (or mark on one) separates words
by one blank. The UTF-8 bytes of that are matched, so the automata have at
most 256 kinds of steps in any script. Long texts are parsed in blocks of
``BLOCK`` bytes, all of them; a phrase ends where its block ends.

The sample is bounded: ``rows`` labelled texts a language, drawn by a hash, of
each a stretch of ``span`` characters at a place drawn by the hash, and
``most_rows`` over all languages together. Every row is predicted.

Null, empty and letterless texts get ``und`` and score 0. Languages whose
labelled texts have no letter are not learned; with no labelled row at all
every text is ``und``. Ties go to the language with more labelled rows, then
to the lesser name. Rows that repeat are drawn once and predicted as often as
they are there; a missing id counts as the empty text in the fold. An empty
table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import remainder
from ledgerlight.session import settle

BLOCK = 1024
#: Bytes of text parsed side by side in a task.
BATCH = 4_000_000
UNKNOWN = "und"


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 2 letter, 1 mark on a letter, 0 any other."""
    kind = {"L": 2, "M": 1}
    points = range(sys.maxunicode + 1)
    return np.fromiter((kind.get(unicodedata.category(chr(p))[0], 0) for p in points), np.uint8, len(points))


def words_as_bytes(text: str | None) -> bytes | None:
    """Lower-cased words with one blank after each and one before the first; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    if not (kinds == 2).any():
        return None
    inside = kinds > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    cleaned = np.where(inside, points, 32)[kept].astype("<u4").tobytes()
    words = cleaned.decode("utf-32-le", "surrogatepass")
    return f" {words.strip(' ')} ".encode("utf-8", "surrogatepass")


# ---- the automata ------------------------------------------------------------------------


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Steps of the states of the least automaton that accepts every substring; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in data:
        new = len(steps)
        steps.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        state = last
        while state >= 0 and byte not in steps[state]:
            steps[state][byte] = new
            state = link[state]
        if state >= 0:
            target = steps[state][byte]
            if longest[target] != longest[state] + 1:
                # The target ends in different places from here on: split it.
                split = len(steps)
                steps.append(dict(steps[target]))
                link.append(link[target])
                longest.append(longest[state] + 1)
                link[target] = link[new] = split
                while state >= 0 and steps[state].get(byte) == target:
                    steps[state][byte] = split
                    state = link[state]
            else:
                link[new] = target
        last = new
    return steps


@dataclass(frozen=True)
class Automaton:
    """Steps of one language's automaton as three arrays, and what a phrase costs."""

    name: str
    cost: float
    states: int
    source: np.ndarray
    byte: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, name: str, data: bytes) -> Automaton:
        steps = suffix_automaton(data)
        flat = [(s, b, t) for s, out in enumerate(steps) for b, t in out.items()]
        source, byte, target = (np.array(x, np.int32) for x in zip(*flat))
        return cls(name, math.log2(len(data) + 1), len(steps), source, byte, target)

    def table(self, kind: np.ndarray, kinds: int) -> np.ndarray:
        """Where each (state, kind of byte) leads, times ``kinds``.

        Row 0 is a dead end, row 1 the start. Where there is no step, the entry
        is the complement of where the byte leads from the start: a new phrase.
        """
        found = np.zeros((self.states + 1, kinds), np.int32)
        found[self.source + 1, kind[self.byte]] = (self.target + 1) * kinds
        first = found[1].copy()
        found = np.where(found == 0, ~first, found)
        return found.reshape(-1)


@dataclass(frozen=True)
class Languages:
    """The learned languages, those with most labelled rows first, and a name of this model."""

    automata: tuple[Automaton, ...]
    token: str

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.automata]


def learn(samples: dict[str, bytes], order: list[str]) -> Languages:
    return Languages(tuple(Automaton.of(name, samples[name]) for name in order), uuid.uuid4().hex)


class Parser:
    """The automata laid out for many texts at once."""

    def __init__(self, model: Languages) -> None:
        used = np.unique(np.concatenate([a.byte for a in model.automata]))
        # Kind 0: bytes that no sample has.
        self.kind = np.zeros(256, np.int32)
        self.kind[used] = np.arange(1, len(used) + 1)
        self.kinds = len(used) + 1
        self.tables = [a.table(self.kind, self.kinds) for a in model.automata]
        self.costs = np.array([a.cost for a in model.automata])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = self.kind[np.frombuffer(b"".join(texts), np.uint8)]
        blocks = -(-sizes // BLOCK)
        text_of = np.repeat(np.arange(len(texts)), blocks)
        inside = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + inside * BLOCK
        length = np.minimum(np.repeat(sizes, blocks) - inside * BLOCK, BLOCK)
        # The longest blocks come first, so those still running are a prefix.
        order = np.argsort(-length, kind="stable")
        start, length, text_of = start[order], length[order], text_of[order]
        running = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        counts = np.zeros((len(self.tables), len(start)), np.int32)
        states = [np.zeros(len(start), np.int32) for _ in self.tables]
        for at in range(int(length[0]) if len(length) else 0):
            alive = running[at]
            kind = data[start[:alive] + at]
            for count, state, table in zip(counts, states, self.tables):
                step = table[state[:alive] + kind]
                missed = step >> 31
                count[:alive] -= missed
                state[:alive] = step ^ missed
        return np.stack([np.bincount(text_of, c, len(texts)) for c in counts], axis=1)

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the cheapest language of each text, and how clear it is (0.5 to 1)."""
        price = self.phrases(texts) * self.costs
        best = price.argmin(axis=1)
        least = price.min(axis=1)
        if price.shape[1] == 1:
            return best, np.ones(len(texts))
        second = np.partition(price, 1, axis=1)[:, 1]
        return best, second / (least + second)


# ---- in Spark ----------------------------------------------------------------------------


def sample(
    labelled: DataFrame,
    rows: int = 200,
    span: int = 300,
    most_rows: int = 1200,
) -> tuple[dict[str, bytes], list[str]]:
    """Sampled words of each language of ``labelled`` (doc_id, text, lang) and the languages by rows.

    At most ``most_rows`` stretches of ``span`` characters reach the driver,
    and one number per language.
    """
    known = labelled.filter("lang is not null and text is not null")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counted:
        return {}, []
    each = max(1, min(rows, most_rows // len(counted)))
    # Rows are drawn by chance first, four times as many as wanted, so the rest is small.
    chances = settle(
        known.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * each / r["n"])) for r in counted], "lang string, chance double")
    )
    draw = F.xxhash64("doc_id", "text")
    chosen = (
        known.withColumn("draw", draw)
        .join(F.broadcast(chances), "lang")
        .filter(F.pmod("draw", F.lit(1 << 30)) < F.col("chance") * (1 << 30))
    )
    length = F.length("text")
    place = (F.pmod(F.shiftright("draw", 30), F.greatest(length - span, F.lit(0)) + 1) + 1).cast("int")
    # Equal rows are drawn together; one of them is enough.
    stretches = chosen.select("lang", "draw", F.col("text").substr(place, F.lit(span)).alias("stretch")).groupBy("lang", "draw").agg(
        F.min("stretch").alias("stretch")
    )
    ranked = stretches.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    found: dict[str, list[bytes]] = {}
    for row in ranked.filter(F.col("rank") <= each).orderBy("lang", "rank").collect():
        words = words_as_bytes(row["stretch"])
        if words:
            found.setdefault(row["lang"], []).append(words)
    # No text has a zero byte after cleaning, so no phrase runs from one stretch into the next.
    samples = {lang: b"\x00".join(parts) for lang, parts in found.items()}
    return samples, [r["lang"] for r in counted if r["lang"] in samples]


#: The layout of the model in use, kept between the tasks of a worker.
_parsers: dict[str, Parser] = {}


def _parser_of(model: Languages) -> Parser:
    if model.token not in _parsers:
        _parsers.clear()
        _parsers[model.token] = Parser(model)
    return _parsers[model.token]


def _judged(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    languages: Languages = model.value
    parser = _parser_of(languages) if languages.automata else None
    names = np.array([*languages.names, UNKNOWN], object)
    for batch in batches:
        texts = batch.column("text")
        best = np.full(len(texts), len(names) - 1)
        score = np.zeros(len(texts))
        waiting: list[bytes] = []
        rows: list[int] = []
        held = 0

        def flush() -> None:
            if waiting:
                best[rows], score[rows] = parser.judge(waiting)
                waiting.clear()
                rows.clear()

        for k in range(len(texts)):
            words = words_as_bytes(texts[k].as_py()) if parser else None
            if words:
                waiting.append(words)
                rows.append(k)
                held += len(words)
                if held > BATCH:
                    flush()
                    held = 0
        flush()
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_judged, model=shared), "doc_id long, lang_pred string, score double")


def identify(
    docs: DataFrame,
    parts: int = 4,
    held: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **bounds: int,
) -> DataFrame:
    """Languages of all documents, learned from those whose id's crc32 modulo ``parts`` isn't ``held``."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    samples, order = sample(rows.filter(remainder("doc_id", parts) != held), **bounds)
    out = predict(rows, learn(samples, order))
    return out.withColumn("held_out", remainder("doc_id", parts) == held)
