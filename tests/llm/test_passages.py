"""Repeated passages against plain loops: how texts are cut, and which paragraphs are linked."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from ledgerlight.llm import passages
from ledgerlight.llm.common import documents
from ledgerlight.sources.tables import table

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = re.compile(r"[.!?][\"')\]\u201d\u2019\u00bb]*\\Z".replace("\\\\", "\\"))


def plain(text):
    """(place, start, stop, words) of every paragraph of a text."""
    found = list(BLANKS.finditer(text))
    words = [m.group().encode().lower() for m in found]
    opens = [
        k
        for k in range(len(found))
        if k == 0 or ENDS.search(found[k - 1].group()) or "\n" in text[found[k - 1].end() : found[k].start()]
    ]
    out = []
    for start, stop in zip(opens, [*opens[1:], len(found)]):
        for at in range(start, stop, passages.WINDOW):
            if at + passages.WINDOW <= len(found):
                last = found[at + passages.WINDOW - 1]
                out.append((at, found[at].start(), last.end(), tuple(words[at : at + passages.WINDOW])))
    return out


def shingled(words):
    return {words[k : k + 5] for k in range(len(words) - 4)}


def test_paragraphs_equal_a_plain_loop():
    rng = random.Random(3)
    pieces = ["Word", "w\u00f6rd", "\u65e5\u672c", "end.", "so!\"", "he?\u201d", "it.\u2019\u00bb)", "\u2019", "\u00bb", ".", "x" * 90, "\U0001f600a", "A1"]
    gaps = [" ", "  ", "\n", "\t", " \r\n ", "\x0b", "\x0c"]
    texts = ["", " ", "one two"]
    for n in (19, 20, 21, 300, 4000):
        texts += ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(n)), " ".join(rng.choices(pieces[:3], k=n)), ""]
    texts.append("y" * 700_000 + " " + " ".join(["z" * 300_000] * 3 + ["q"] * 30))
    for array in (pa.array(texts), pa.array(["left out", *texts, "too"]).slice(1, len(texts))):
        got = passages.paragraphs(array)
        rows = list(zip(got.text.tolist(), got.at.tolist(), got.start.tolist(), got.stop.tolist()))
        wanted = [(k, *p) for k, text in enumerate(texts) for p in plain(text)]
        assert rows == [w[:4] for w in wanted]
        codes, runs = {}, {}
        for content, row, w in zip(got.content.tolist(), got.runs.tolist(), wanted):
            assert codes.setdefault(w[4], content) == content
            for k, run in enumerate(row):
                assert runs.setdefault(w[4][k : k + 5], run) == run
        assert len(set(codes.values())) == len(codes) and len(set(runs.values())) == len(runs)
    assert len(passages.paragraphs(pa.array([], pa.string())).text) == 0


def pairs_of(sets):
    """All pairs of similar sets, found over the runs they share."""
    by_run = defaultdict(list)
    for k, runs in enumerate(sets):
        for run in runs:
            by_run[run].append(k)
    shared = defaultdict(int)
    for ks in by_run.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] += 1
    return [p for p, n in shared.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def test_links_reach_what_all_pairs_reach(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held = defaultdict(set)
    for r in documents(docs).collect():
        for *_, words in plain(r.text):
            held[words].add(r.doc_id)
    contents = list(held)
    wanted = [
        (contents[a], contents[b])
        for a, b in pairs_of([shingled(w) for w in contents])
        if len(held[contents[a]] | held[contents[b]]) > 1
    ]
    code = {w: int(passages.paragraphs(pa.array([b" ".join(w).decode()])).content[:1].view(np.int64)[0]) for w in contents}
    _, found = passages.links(documents(docs))
    label = {r.node: r.label for r in found.collect()}
    met = sum(label.get(code[a], 0) == label.get(code[b], 1) for a, b in wanted)
    assert len(wanted) > 20 and met >= 0.98 * len(wanted)


def test_large_buckets_lose_no_link(spark):
    # One template with many endings: hundreds of classes share runs, few are similar.
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    template = words[:14]
    lines = [" ".join([*template, *rng.sample(words[14:], 6)]) + "." for _ in range(700)]
    # The last word but one or two changed: 0.78 and more alike.
    near = [" ".join([*line.split()[:-1], "other."]) for line in lines[:40]]
    docs = [(k, line) for k, line in enumerate([*lines, *near])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    _, found = passages.links(documents(frame))
    code = [int(passages.paragraphs(pa.array([t])).content.view(np.int64)[0]) for _, t in docs]
    label = {r.node: r.label for r in found.collect()}
    joined = pairs_of([shingled(tuple(t.encode().lower().split())) for _, t in docs])
    assert len(joined) >= 40
    assert all(label[code[a]] == label[code[b]] for a, b in joined)
    tied = defaultdict(set)
    for k, c in enumerate(code):
        tied[label.get(c, c)].add(k)
    reach = {frozenset(x) for x in tied.values() if len(x) > 1}
    assert reach <= {frozenset(p) for p in joined} | {frozenset(x) for x in reach if len(x) > 2}
    got = {(r.doc_id, r.first_doc_id) for r in passages.repeated_passages(frame).collect() if r.removed}
    assert {(700 + k, k) for k in range(40)} <= got


def test_blocks_of_a_run_that_all_share(spark):
    # Every class has the same runs but one, in any order of blocks: all end in one component.
    base = [f"v{k}" for k in range(20)]
    texts = [" ".join([*base[:19], f"u{k}."]) for k in range(passages.BLOCK * 2 + 5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.repeated_passages(frame).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(k, 0) for k in range(len(texts))}


def roots(links):
    """The least of each component that links make."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: top(x) for x in up}


def test_groups_in_one_batch_link_what_a_plain_loop_links():
    # Small and large groups of one block or two, sets of several sizes, runs as odd as the marks of empty places.
    rng, rows, wanted = random.Random(4), [], set()
    for run in range(60):
        high, base = rng.randrange(2), [rng.randrange(-(2**62), 2**62) for _ in range(passages.WIDTH)]
        group = []
        for _ in range(rng.choice([1, 2, 4, 30, 120])):
            own = [x if rng.random() < 0.93 else rng.choice([-1, -2, rng.randrange(9)]) for x in base]
            group.append((rng.randrange(500), list(dict.fromkeys(own))[: rng.choice([16, 16, 12, 3])], rng.randrange(high + 1)))
        rows += [(run, 0, high, *r) for r in group]
        for one, a, low in group:
            for two, b, block in group:
                both = len(set(a) & set(b))
                if one != two and (low, block) == (0, high) and 100 * both >= 75 * (len(a) + len(b) - both):
                    wanted.add((max(one, two), min(one, two)))
    layout = {"run": pa.int64(), "low": pa.int32(), "high": pa.int32(), "label": pa.int64(), "runs": pa.list_(pa.int64()), "block": pa.int32()}
    table = pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(layout.items())})
    for most in (1, 7, 100, len(rows)):
        got = set()
        for batch in passages._block_links(iter(table.to_batches(max_chunksize=most))):
            got |= set(zip(*(x.to_pylist() for x in batch.columns)))
        assert got <= wanted and roots(got) == roots(wanted)


def test_links_between_labels_join_components(spark):
    found = spark.createDataFrame([(1, 1), (5, 1), (3, 3), (9, 3), (4, 4), (6, 4)], "node long, label long")
    more = spark.createDataFrame([(3, 1), (8, 7), (7, 3)], "a long, b long")
    got = {(r.node, r.label) for r in passages._joined(found, more).collect()}
    assert got == {(1, 1), (5, 1), (3, 1), (9, 1), (7, 1), (8, 1), (4, 4), (6, 4)}
