"""The training-text operators against plain loops, round trips and odd input."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerlight.llm import (
    class_lm,
    components,
    exact_dedup,
    fingerprints,
    mixing,
    near_dedup,
    packing,
    passages,
    quality,
    queries,
    records,
    url_rules,
)
from ledgerlight.session import shared_folder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, label int, node string, length long, key string, copy int"
RANDOM = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(400)]


def sentence(n, rng=RANDOM):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = sentence(30000)
NEAR = sentence(200)
TEXTS = [
    (1, "The same words are here twice, all of them."),
    (2, "The same words are here twice, all of them."),
    (2, "The same words are here twice, all of them."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG + " end"),
    (8, "Two words"),
    (9, "two WORDS"),
    (10, "naïve ÉTÉ 日本語 🙂🙂 x"),
    (None, "no id at all"),
    (None, None),
    (11, NEAR),
    (12, NEAR + " and more"),
    (13, sentence(150)),
]


def rows_of(texts):
    return [(d, t, s, None, 7, "n", 3, "k", 9) for (d, t), s in zip(texts, ["a", "b", None, "a"] * len(texts))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(upper, upper.lower())))


def least_first(row):
    return tuple((x is not None, str(x)) for x in row)


# ---- op1 ---------------------------------------------------------------------------------


def test_passages_planted(spark):
    rng = random.Random(9)
    planted = "Here it starts. " + sentence(60, rng) + ". " + sentence(25, rng) + "."
    texts = {k: sentence(80, rng) + ". " + sentence(40, rng) + "." for k in range(12)}
    for k in (3, 5, 8):
        texts[k] = texts[k] + " " + planted + " " + sentence(30, rng) + "."
    twice = sentence(40, rng) + "."
    texts[10] = f"{twice} {sentence(20, rng)}. {twice}"
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.first_doc_id, r.removed) for r in found} == {(3, 3, False), (5, 3, True), (8, 3, True)}
    for r in found:
        assert texts[r.doc_id][r.start : r.stop] in planted and r.n_words >= 50


def test_passages_odd(odd, none):
    found = {r.doc_id for r in passages.repeated_passages(odd).collect()}
    assert found == {6, 7, 11, 12}
    assert passages.repeated_passages(none).count() == 0


# ---- op2 ---------------------------------------------------------------------------------


def test_mixing_is_inverse_poisson(odd):
    rates = {r["__source"]: r["rate"] for r in mixing.rates(odd).collect()}
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.mix(odd).collect())
    rows = Counter((d, s, t) for d, t, s, *_ in rows_of(TEXTS))
    for (d, s, t), times in rows.items():
        rate, digest = rates[s], hashlib.md5(f"17|{'' if d is None else d}".encode()).hexdigest()
        u, n, total = int(digest[:13], 16) / 16**13, 0, math.exp(-rates[s])
        while total <= u:
            n += 1
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        assert got[(d, s, t)] == n * times
    assert set(got) <= set(rows)


def test_mixing_weights_and_clashes(odd, none):
    assert {r.source for r in mixing.mix(odd, {"a": 1.0}).collect()} <= {"a"}
    mixed = mixing.mix(odd)
    # A column of that name is kept as it is; the new one has a name of its own.
    assert mixed.columns == [*odd.columns, "copy_1", "position"]
    assert {r["copy"] for r in mixed.collect()} == {9}
    helpers = odd.selectExpr("*", "doc_id AS position", "1 AS n", "2 AS u", "'x' AS __n", "3 AS row", "4 AS of", "5 AS place", "6 AS number")
    again = mixing.mix(helpers)
    assert again.columns == [*helpers.columns, "copy_1", "position_1"]
    assert all(r["position"] == r["doc_id"] and (r["n"], r["u"], r["__n"], r["place"]) == (1, 2, "x", 5) for r in again.collect())
    assert Counter((r.doc_id, r.text, r.copy_1) for r in again.collect()) == Counter((r.doc_id, r.text, r.copy_1) for r in mixed.collect())
    assert mixing.mix(none).count() == 0


# ---- op3 ---------------------------------------------------------------------------------


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host, path = m[1].translate(str.maketrans(upper, upper.lower())), m[2]
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in queries.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "x://", "http://Example.ORG/es/1", "http://a.example.org/en/12?x", "http://org/", "s://org"]
    urls += ["http://badexample.org/es/", "http://shop.com/de/#f", "http://shop.com/fr/", "http://.com/de/x", "http://é.com/de/"]
    urls += ["a://b://c.com/de/", "http://shop.com/de/\n", "http://shop.com/DE/"] + ["http://example.org/en/1"] * 300
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(None, None, "c")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert found == {k: judged(u) for k, u in enumerate(urls)} | {None: judged(None)}
    assert url_rules.judge(pages, rules.limit(0)).filter("rule is null and verdict = 'allow'").count() == pages.count()
    assert url_rules.judge(pages.limit(0), rules).count() == 0


# ---- op4 ---------------------------------------------------------------------------------


def test_fingerprints(odd, none):
    got = fingerprints.compare_with_next(odd).collect()
    order = sorted(((d, t or "") for d, t in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for k, (d, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=least_first) == sorted(want, key=least_first)
    by_text = {}
    for d, n, _ in want:
        by_text.setdefault(d, n)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id}
    assert prints[1] == prints[2] and prints[3] == prints[4] and len(set(prints.values())) == len(prints) - 2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare_with_next(none).count() == 0


def test_prefix_spans():
    a, b = "abcabcabd🙂x", "zabcabd🙂y"
    x, y = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for i in range(len(a)):
        for k in range(len(b)):
            n = 0
            while i + n < len(a) and k + n < len(b) and a[i + n] == b[k + n]:
                n += 1
            assert fingerprints.common_extension(x, i, y, k) == n


# ---- op5 and op9 -------------------------------------------------------------------------


def encoded(name):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer(name))
    return lambda text, end: coder.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["odd", "real"])
def test_records_round_trip(spark, which, request):
    docs = request.getfixturevalue(which)
    encode = encoded("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/r-{uuid.uuid4()}"
    shards = records.write_records(docs, folder, queries.tokenizer("byte_bpe_50k.json"), 2)
    got = sorted(records.read_records(spark, folder, shards, with_ids=True).collect(), key=lambda r: r.start)
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    start = 0
    assert len(got) == len(source)
    for r, (d, text) in zip(got, source):
        ids = encode(text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (d, start, len(ids), crc(ids), ids)
        start += len(ids)


def test_records_damage_and_none(spark, none, tmp_path):
    path = queries.tokenizer("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/r-{uuid.uuid4()}"
    shards = records.write_records(none, folder, path, 2)
    assert records.read_records(spark, folder, shards).count() == 0
    whole = records.frame(b"abcdef")
    file = tmp_path / "part-00000.rec"
    file.write_bytes(whole[:14] + b"X" + whole[15:])
    with pytest.raises(ValueError):
        records.read_record(str(tmp_path), 0, 0)
    file.write_bytes(whole)
    assert records.read_record(str(tmp_path), 0, 0).tobytes() == b"abcdef"


@pytest.mark.parametrize("which", ["odd", "real"])
def test_packing(which, request):
    docs = request.getfixturevalue(which)
    encode = encoded("word_bpe_49k.json")
    got = packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    want = []
    for r in docs.collect():
        ids = encode(r.text, 0)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((r.doc_id, piece, at, len(own), crc(own)))
    have = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    assert sorted(have, key=least_first) == sorted(want, key=least_first)
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    # As many sequences as best fit over the single pieces needs.
    rooms = []
    for length in sorted((x[3] for x in want), reverse=True):
        fits = [x for x in rooms if x >= length]
        room = min(fits) if fits else 2048
        if fits:
            rooms.remove(room)
        rooms.append(room - length)
    assert len(rows) <= len(rooms)


def test_packing_none(none):
    assert packing.pack_documents(none, queries.tokenizer("word_bpe_49k.json")).count() == 0


# ---- op6 ---------------------------------------------------------------------------------


@pytest.mark.parametrize("prefix", [4, 256])
def test_exact_groups(odd, none, prefix):
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(t or "", []).append(d)
    got = exact_dedup.exact_groups(odd, prefix_chars=prefix, digest_all=True).collect()
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = [(d, best[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids]
    have = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(have, key=least_first) == sorted(want, key=least_first)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(odd, prefix_chars=prefix)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((best[t], t) for t in groups)
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_copies(none).count() == 0


# ---- op7 ---------------------------------------------------------------------------------


def near_brute(texts):
    """component of each row by its place, from all pairs."""
    sets = []
    for _, t in texts:
        w = words_of(t)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[k][0] for k in range(len(texts)) if label[k] == label[i] and texts[k][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return out


def chained(n, rng):
    """Texts of which each is a few words off the one before: links only in a chain."""
    words = [rng.choice(VOCABULARY) for _ in range(120)]
    texts = []
    for k in range(n):
        texts.append((1000 + k, " ".join(words)))
        at = rng.randrange(len(words) - 3)
        words[at : at + 2] = [f"new{k}", f"more{k}"]
    return texts


def test_near_groups(spark):
    texts = TEXTS + chained(40, random.Random(3)) + [(2000 + k, sentence(60)) for k in range(20)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    got = near_dedup.near_groups(docs).collect()
    have = [(r.doc_id, r.n_shingles, r.component_id) for r in got]
    assert sorted(have, key=least_first) == sorted(near_brute(texts), key=least_first)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {3, 4, 5, 1, 6, 8, 11, 13, 1000} <= ids and not ids & {2, 7, 9, 12, 1001}


def test_near_none(none):
    assert near_dedup.near_groups(none).count() == near_dedup.drop_near_copies(none).count() == 0


def test_plausible_keeps_links():
    rng = np.random.default_rng(1)
    for shared in (760, 800, 950):
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        left = np.concatenate([both, rng.integers(0, 1 << 63, (1000 - shared) // 2, dtype=np.uint64)])
        right = np.concatenate([both, rng.integers(0, 1 << 63, (1000 - shared) // 2, dtype=np.uint64)])
        a, b = near_dedup.registers(left)[None], near_dedup.registers(right)[None]
        assert near_dedup.plausible(a, b, np.array([len(left)]), np.array([len(right)])).all()
    other = near_dedup.registers(rng.integers(0, 1 << 63, 900, dtype=np.uint64))[None]
    assert not near_dedup.plausible(a, other, np.array([900]), np.array([900])).any()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 7), (200, 201), (201, 202), (5, 5)] + [(300, k) for k in range(301, 340)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(61), 100]} | {k: 200 for k in (200, 201, 202)} | {k: 300 for k in range(300, 340)}


# ---- op8 ---------------------------------------------------------------------------------


def test_quality_beats_the_majority(spark):
    scored = queries.quality_query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    ones = sum(r.quality for r in rows) / len(rows)
    assert right > max(ones, 1 - ones)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (7, 5)], "doc_id long, quality int")
    model, measured = queries.fit_quality(odd, labels)
    scores = measured.select(quality.score(model, measured.statistics).alias("s")).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r.s <= 1 for r in scores)
    model, _ = queries.fit_quality(none, labels.limit(0))
    assert model.constant == 0.5


# ---- op10 --------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "real"])
def test_class_lm_base(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0

    counts = Counter()
    for d, words in rows:
        if not held(d):
            counts.update(words + [""])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, words in rows:
        tokens = words + [""]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        want.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 4)))
    got = class_lm.perplexity_scores(docs).collect()
    have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]

    def close(a, b):
        return a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-3)

    have, want = (sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])) for x in (have, want))
    assert len(have) == len(want) and all(map(close, have, want))
    assert all(r.score <= 0 for r in got)
    if which == "real":
        unseen = [r for r in got if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_class_lm_none(none):
    assert class_lm.perplexity_scores(none).count() == 0


# ---- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark, real):
    docs, sets = real, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, SF))
        sets.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == real.columns
        if name == "exact_dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts)) == before.select("text").distinct().count()
        if name == "near_dedup":
            brute = near_brute([(r.doc_id, r.text) for r in before.collect()])
            assert sets[-1] == {d for d, _, c in brute if d == c}
    assert all(later <= earlier for earlier, later in zip(sets, sets[1:])) and sets[-1]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_commonest_words_are_cut_by_count(spark):
    counts = spark.createDataFrame([(bytes([k]), n) for k, n in enumerate([9, 7, 7, 5, 5, 5, 1])], "word binary, n long").repartition(3)
    for most, kept in ((0, []), (1, [9]), (2, [9]), (3, [9, 7, 7]), (5, [9, 7, 7]), (6, [9, 7, 7, 5, 5, 5]), (7, [9, 7, 7, 5, 5, 5, 1])):
        assert sorted((r["n"] for r in class_lm.commonest(counts, most)), reverse=True) == kept
    assert class_lm.commonest(counts.limit(0), 5) == []


def test_rare_words_are_clustered_one_by_one(spark, monkeypatch):
    """Words of one ending and length that tell by their neighbours alone what they are."""
    rng = np.random.default_rng(4)
    kinds = [[f"{a}{k:03d}xyz" for k in range(40)] for a in "pq"]
    heads = [[[f"{a}{k}" for k in range(3)] for a in side] for side in ("mu", "nv")]
    share = np.repeat([9, 1], [10, 30]) / 120
    texts = [
        " ".join(" ".join([*map(rng.choice, heads[h]), rng.choice(kinds[h], p=share)]) for h in rng.integers(0, 2, 40)) for _ in range(60)
    ]
    rows = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(3)
    # With all words known, and with the commonest alone.
    for known in (class_lm.KNOWN, 32):
        monkeypatch.setattr(class_lm, "KNOWN", known)
        vocabulary = class_lm.vocabulary_of(rows)
        coded = class_lm.settle(rows.mapInArrow(class_lm.partial(class_lm._coded, vocabulary=vocabulary), class_lm.CODED))
        near = class_lm.neighbours(coded, vocabulary.tokens)
        classes, table = class_lm.exchange(near, len(vocabulary.counts), 30)
        start, _ = class_lm.exchange(near, len(vocabulary.counts), 0)
        assert class_lm.likelihood(table) >= class_lm.likelihood(class_lm._added(near, class_lm.partial(class_lm._class_pairs, classes=start)))
        found = {w.decode(): int(classes[k]) for w, k in vocabulary.numbers.items()}
        rare = class_lm.rare_words(coded, classes, table).collect()
        assert {r["word"].decode(): r["n"] for r in rare} == {w: n for w, n in Counter(" ".join(texts).split()).items() if w not in found}
        found |= {r["word"].decode(): r["class"] for r in rare}
        sides = [{found[w] for w in kind} for kind in kinds]
        assert not sides[0] & sides[1], known
