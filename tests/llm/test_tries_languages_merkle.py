"""Prefix trie, language identification and Merkle manifest against plain loops and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import languages, merkle, prefix_trie
from ledgerlight.llm.common import remainder, ship

SF = "/root/testdata/sf0.01"
TALK = "conv_id long, turn long, role string, text string, part int, key string, low int, n long, depth long, parent long"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, row long, tree long, path string, n long, id int"


# ---- conversations -----------------------------------------------------------------------


def plain_trie(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        told[conv].append(((turn is not None, turn or 0), code, role, text))
    for turns in told.values():
        turns.sort()
    whole = {}
    for conv in told:
        if conv is not None:
            h = zlib.crc32(str(conv).encode()) % 4
            whole[conv] = tuple((r, x) for *_, r, x in told.get(conv - conv % 20, [])[:h] + told[conv][h:])
    members, kids = defaultdict(list), defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        inside = members[node]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(inside) - 1) * words + sum(saved[k] for k in kids[node])
        ends = ",".join(map(str, sorted(c for c in inside if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(inside), len(node), parent, len(inside), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=lambda r: r[:2])


def shown_trie(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=lambda r: r[:2])


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, 5) for r in rows], TALK)


def chatter(seed, n=300):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        kind = rng.random()
        if kind < 0.35:
            turns = ["hot words", "same", "again"]
        elif kind < 0.4:
            turns = ["hot words", "same"]
        elif kind < 0.45:
            turns = ["long  one"] * 60 + [rng.choice("ab")]
        else:
            turns = [rng.choice(["a b", "b", "hot words", ""]) for _ in range(rng.randint(0, 7))]
        for turn, text in enumerate(turns):
            number = turn if rng.random() < 0.95 else None
            rows.append((conv, number, rng.choice(["user", "user", None]), text if rng.random() < 0.97 else None))
    rows += [(None, 1, "user", "lost"), (7, 0, "user", "a b"), (7, 0, "user", "a b"), (8, 0, "ué", "日本 x " * 9000)]
    return rows


@pytest.mark.parametrize("parts", [1, 5, 37])
def test_trie_is_that_of_a_loop(spark, parts):
    # 37 tasks are merged in two rounds; the hot conversation lies in a dozen of them.
    ship(spark)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = chatter(parts)
        assert shown_trie(talk(spark, rows)) == plain_trie(rows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_trie_of_real_conversations(spark):
    ship(spark)
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert shown_trie(df) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_ids_of_a_large_group_are_digested_in_blocks(spark):
    ship(spark)
    # No turn is taken over from 0 alone where all say the same.
    rows = [(c, t, "user", x) for c in range(3 * prefix_trie.IDS) for t, x in enumerate(["hi", "you"])]
    assert shown_trie(talk(spark, rows)) == plain_trie(rows)


def test_trie_of_little(spark):
    ship(spark)
    assert shown_trie(talk(spark, [])) == []
    assert shown_trie(talk(spark, [(None, 0, "user", "x")])) == []
    for rows in ([(5, 0, None, None)], [(3, 0, "user", "only one")], [(1, 2, "a", "b c"), (40, 2, "a", "b c")]):
        assert shown_trie(talk(spark, rows)) == plain_trie(rows)


def test_merges_of_any_cut_agree():
    # The same sequences, cut into tasks at random places and merged pair by pair.
    rng = random.Random(11)
    for _ in range(200):
        whole = sorted(tuple(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 14)))
        cuts = sorted(rng.sample(range(1, len(whole)), min(len(whole) - 1, rng.randint(0, 4))))

        def lcp(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        def node(s, at):
            return prefix_trie.Node(len(s), 1, at, list(range(len(s) + 1)), ends=None)

        def edge(a, b):
            depth = lcp(a, b)
            return prefix_trie.Edge(depth, ("/" + "".join(a[:depth])).encode())

        def counted(forest):
            names = {r["key"]: r["conv_id"] for r in forest.rows if r["kind"] == "name"}
            return sorted(
                (r["conv_id"], r["low"], r["high"], r["n"], r["kids"], r["leaves"], r["below"], names[r["parent_key"]] if r["parent_key"] is not None else r["parent"])
                for r in forest.rows
                if r["kind"] == "node"
            )

        plain = prefix_trie.Forest()
        plain.close(plain.merge([node(s, k) for k, s in enumerate(whole)], [edge(a, b) for a, b in zip(whole, whole[1:])], -1, -1))
        split, nodes, edges = prefix_trie.Forest(), [], []
        for low, high in zip([0, *cuts], [*cuts, len(whole)]):
            left = lcp(whole[low - 1], whole[low]) if low else -1
            right = lcp(whole[high - 1], whole[high]) if high < len(whole) else -1
            part = split.merge(
                [node(whole[k], k) for k in range(low, high)], [edge(whole[k], whole[k + 1]) for k in range(low, high - 1)], left, right
            )
            # One component, and at most one sum per open depth and side.
            assert len(part.nodes) <= 3 + max(left, 0) + max(right, 0)
            edges += [edge(whole[low - 1], whole[low])] if low else []
            nodes += part.nodes
            edges += part.edges
        split.close(split.merge(nodes, edges, -1, -1))
        assert counted(split) == counted(plain)


# ---- languages ---------------------------------------------------------------------------


def plain_phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + size] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def test_automaton_accepts_all_substrings_and_no_other():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abc") for _ in range(60))
    steps = languages.suffix_automaton(data)
    assert len(steps) < 2 * len(data)
    for _ in range(3000):
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9)))
        state = 0
        for byte in word:
            state = steps[state].get(byte) if state is not None else None
        assert (state is not None) == (word in data)


def test_phrases_are_the_longest_matches():
    rng = random.Random(9)
    samples = {k: bytes(rng.choice(k.encode()) for _ in range(400)) for k in ("abcd ", "abxy ", "cdxy ")}
    parser = languages.Parser(languages.learn(samples, list(samples)))
    texts = [bytes(rng.choice(b"abcdxyz \xc3") for _ in range(n)) for n in (1, 2, 17, 300, languages.BLOCK, 3 * languages.BLOCK + 5)]
    found = parser.phrases(texts)
    for text, counts in zip(texts, found):
        blocks = [text[k : k + languages.BLOCK] for k in range(0, len(text), languages.BLOCK)]
        assert list(counts) == [sum(plain_phrases(b, s) for b in blocks) for s in samples.values()]


def test_words_as_bytes():
    assert languages.words_as_bytes("Don't — STOP 42!") == b" don t stop "
    assert languages.words_as_bytes("Été\n日本語") == " été 日本語 ".encode()
    for empty in (None, "", " 12 ., \n", "²½"):
        assert languages.words_as_bytes(empty) is None


def test_predictions_follow_the_cheapest_parse(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    samples, order = languages.sample(docs.filter(remainder("doc_id", 4) != 2), rows=20)
    assert order[0] == "en" and set(order) == {"de", "en", "es", "fr"}
    model = languages.learn(samples, order)
    some = docs.filter("length(text) < 700").orderBy("doc_id").limit(40)
    found = {r[0]: r[1:] for r in languages.predict(some, model).collect()}
    for doc_id, text, _ in some.collect():
        words = languages.words_as_bytes(text)
        prices = []
        for lang in order:
            blocks = [words[k : k + languages.BLOCK] for k in range(0, len(words), languages.BLOCK)]
            prices.append(sum(plain_phrases(b, samples[lang]) for b in blocks) * math.log2(len(samples[lang]) + 1))
        least, second = sorted(prices)[:2]
        assert found[doc_id][0] == order[prices.index(least)]
        assert found[doc_id][1] == pytest.approx(second / (least + second))


def test_held_out_accuracy(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = languages.identify(docs)
    assert out.count() == docs.count()
    right = out.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    # A text's label is no input: without those of the held-out rows nothing changes.
    blind = docs.withColumn("lang", F.when(remainder("doc_id", 4) != 2, F.col("lang"))).withColumn("source", F.lit("x"))
    assert sorted(map(tuple, languages.identify(blind).collect())) == sorted(map(tuple, out.collect()))


ODD = [
    (1, "a", "en", 3, "The words of the text are here and there"),
    (1, "a", "en", 3, "The words of the text are here and there"),
    (2, None, "fr", None, "Les mots du texte sont là et ailleurs"),
    (3, "b", None, 5, "the words are here"),
    (4, "b", "en", 0, ""),
    (5, "b", "fr", 4, None),
    (6, "b", "fr", 4, "12 34 .. !!"),
    (7, "c", "en", 9, "the words of the text " * 20000),
    (None, "c", "en", 9, "No id, but WORDS of the text"),
    (None, None, None, None, None),
    (8, "c", "zz", 9, "123"),
    (9, "c", "ja", 9, "日本語の文章と言葉"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, "p", 3, 4) for r in rows], DOCS)


def test_languages_of_odd_rows(spark):
    ship(spark)
    out = languages.identify(odd(spark), held=9)
    found = out.collect()
    assert len(found) == len(ODD) and not any(r["held_out"] for r in found)
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["lang_pred"])
        assert 0 <= r["score"] <= 1
    assert by_id[1] == by_id[3] == by_id[7] == {"en"} and by_id[2] == {"fr"} and by_id[9] == {"ja"}
    assert by_id[4] == by_id[5] == by_id[6] == by_id[8] == {"und"} and by_id[None] == {"en", "und"}


def test_languages_of_nothing(spark):
    ship(spark)
    assert languages.identify(odd(spark, [])).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in languages.identify(unlabelled).collect()} == {"und"}


# ---- manifest ----------------------------------------------------------------------------


def plain_manifest(rows, fan=8):
    def digest(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(values):
        return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
        return out

    def path(tree, at):
        steps = []
        for level in tree[:-1]:
            start = at // fan * fan
            steps.append((level[start:at], level[at + 1 : start + fan]))
            at //= fan
        return steps

    groups = defaultdict(list)
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        low = text
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 0 and text is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups[lang].append(((doc_id is not None, doc_id or 0), leaf(row), leaf((*row[:4], low)), doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names]) if names else []
    out = []
    for at, g in enumerate(names):
        for k, (_, own, other, doc_id) in enumerate(sorted(groups[g])):
            steps = path(trees[g], k) + path(top, at)
            folded = other
            for left, right in steps:
                folded = digest([*left, folded, *right])
            proof = digest([x for left, right in steps for x in (*left, *right)])
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def shown_manifest(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.tampered(df).select(columns).collect()), key=str)


def test_manifest_is_that_of_a_loop(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = shown_manifest(df)
    assert found == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in found) < len(rows)


def test_manifest_of_odd_rows(spark):
    many = [(k, "s", f"l{k % 70}", k, f"Text {k}") for k in range(700)] + [(5, "s", "l5", 5, "Text 5")] * 90
    for rows in (ODD, many, ODD[:1], [(None, None, None, None, None)] * 9):
        assert shown_manifest(odd(spark, rows)) == plain_manifest(rows)
    assert shown_manifest(odd(spark, [])) == []


@pytest.mark.parametrize("fan, stride", [(2, 1), (2, 3), (8, 1), (3, 2)])
def test_stored_levels_do_not_change_the_tree(spark, fan, stride):
    rows = [(k, "s", "en" if k % 3 else "de", k, f"t{k}") for k in range(150)]
    docs = odd(spark, rows)
    made = merkle.manifest(docs, fan=fan, stride=stride)
    roots = {r[0] for r in made.select("root").distinct().collect()}
    assert roots == {plain_manifest(rows, fan)[0][3]}
    assert made.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(None if k % 5 == 0 else k % 7,) for k in range(500)], "v int").repartition(6)
    found = sorted((r["row"], -1 if r["v"] is None else r["v"]) for r in merkle.numbered(df, ["v"]).collect())
    assert [r for r, _ in found] == list(range(500))
    assert [v for _, v in found] == sorted(v for _, v in found)
