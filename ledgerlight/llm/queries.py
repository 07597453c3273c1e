"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import (
    class_lm,
    exact_dedup,
    fingerprints,
    languages,
    merkle,
    mixing,
    near_dedup,
    packing,
    passages,
    prefix_trie,
    quality,
    records,
    url_rules,
)
from ledgerlight.llm.common import documents, remainder, ship
from ledgerlight.session import settle, shared_folder

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Share of its own characters that tempers a source's weight, and the seed of the draw.
TEMPER, SEED = 0.7, 17


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, temper=TEMPER, seed=SEED).select("doc_id", "source", "lang", "text", "copy", "position")


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    shards = records.write_records(docs, folder, tokenizer("byte_bpe_50k.json"), end_id=2)
    return records.read_records(spark, folder, shards)


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[quality.Discriminant, DataFrame]:
    """Model of the labelled rows that aren't held out, and the statistics of all documents."""
    rows = documents(docs)
    measured = settle(rows.select("doc_id", quality.document_statistics("text").alias("statistics")))
    learned = measured.filter(remainder("doc_id", 3) != 1)
    return quality.fit(quality.with_labels(learned, labels)), measured


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, measured = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = measured.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), quality.score(model, F.col("statistics")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=0)


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.perplexity_scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


def crc_sql(value: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, len({value}) + 1), lambda i: ascii(substr({value}, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


MIXING_SQL = f"""
WITH mass AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source
), weighted AS (
  SELECT source, chars, pow(chars, {TEMPER}) AS weight FROM mass
), rates AS (
  SELECT source, CASE WHEN chars = 0 THEN 1.0
    ELSE weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(chars) FROM weighted) / chars END AS rate
  FROM weighted
), steps AS (
  SELECT source, list_transform(range(0, CAST(rate + 12 * sqrt(rate) + 40 AS BIGINT)),
    lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1))))) AS steps
  FROM rates
), drawn AS (
  SELECT doc_id, d.source, lang, text, len(list_filter(steps, lambda c: c <=
    CAST('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) / 4503599627370496.0)) AS n
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
), copies AS (
  SELECT doc_id, source, lang, text, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM drawn
)
SELECT doc_id, source, lang, text, copy,
  md5('{SEED + 1}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS position
FROM copies
"""

_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
URL_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {_VALUES}), parsed AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(h || p, (length(h || p), length(h))) AS rule,
  coalesce(arg_max(v, (length(h || p), length(h))), 'allow') AS verdict
FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY r, page_id
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

NEAR_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w != '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN named USING (doc_id)
"""

_LEAF = """sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-'),
      coalesce(strlen({text}) || ':' || {text}, '-')))"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format(text="text")} AS leaf,
    {_LEAF.format(text=_LOWERED)} AS lowered
  FROM documents
), checked AS (
  SELECT *, {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 AS touched FROM given
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM checked
), levels(lvl, lang, pos, n, digest) AS (
  SELECT 0, lang, pos, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM levels WHERE n > 1
  GROUP BY lvl, lang, pos // 8, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1
), uppers(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM uppers WHERE n > 1
  GROUP BY lvl, pos // 8, n
), beside AS (
  SELECT p.r, x.lvl, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < p.pos // (1 << (3 * x.lvl))), '') AS l,
    coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > p.pos // (1 << (3 * x.lvl))), '') AS g
  FROM placed p JOIN levels x ON x.lang IS NOT DISTINCT FROM p.lang AND x.n > 1 AND x.pos // 8 = p.pos // (8 << (3 * x.lvl))
  GROUP BY p.r, x.lvl
  UNION ALL
  SELECT p.r, 1000 + x.lvl, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < s.pos // (1 << (3 * x.lvl))), ''),
    coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > s.pos // (1 << (3 * x.lvl))), '')
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN uppers x ON x.n > 1 AND x.pos // 8 = s.pos // (8 << (3 * x.lvl))
  GROUP BY p.r, x.lvl
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step FROM beside
), folded(r, step, digest) AS (
  SELECT r, 0, CASE WHEN touched THEN lowered ELSE leaf END FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.l || f.digest || s.g) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step + 1
), ends AS (
  SELECT r, arg_max(digest, step) AS folded_root FROM folded GROUP BY r
), proofs AS (
  SELECT r, sha256(string_agg(l || g, '' ORDER BY step)) AS proof FROM steps GROUP BY r
)
SELECT doc_id, leaf, subroot, digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = digest AS verified
FROM placed JOIN ends USING (r) LEFT JOIN proofs USING (r) JOIN subroots s ON s.lang IS NOT DISTINCT FROM placed.lang
  JOIN uppers u ON u.n = 1
"""

TRIE_SQL = rf"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), coded AS (
  SELECT conv_id, turn, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS code,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w != '')) AS words
  FROM told
), original AS (
  SELECT conv_id, list({{'code': code, 'words': words}} ORDER BY turn NULLS FIRST, code, words) AS turns FROM coded GROUP BY conv_id
), drawn AS (
  SELECT *, ({crc_sql("conv_id::VARCHAR")} % 4)::INTEGER AS h FROM original
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(b.turns, [])[1:d.h], d.turns[d.h + 1:]) AS turns
  FROM drawn d LEFT JOIN original b ON b.conv_id = d.conv_id - d.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(turns) AS size, turns, CAST(unnest(range(0, len(turns) + 1)) AS BIGINT) AS depth FROM rebuilt
), members AS (
  SELECT conv_id, size, depth, coalesce(array_to_string(list_transform(turns[1:depth], lambda t: t.code), ''), '') AS path,
    CASE WHEN depth = 0 THEN 0 ELSE turns[depth].words END AS words
  FROM prefixes
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), kids AS (
  SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), above AS (
  SELECT substr(path, 1, 32 * unnest(range(0, depth + 1))) AS path, n_children = 0 AS is_leaf, (n_convs - 1) * words AS saved FROM counted
), sums AS (
  SELECT path, count(*) FILTER (is_leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (path)
  LEFT JOIN nodes p ON c.depth > 0 AND p.path = substr(c.path, 1, 32 * (c.depth - 1))
"""


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_repeated_passages": passages_query,
        "op2_source_mixing": mixing_query,
        "op3_url_rules": url_query,
        "op4_fingerprints": fingerprint_query,
        "op5_token_records": records_query,
        "op6_exact_dedup": exact_query,
        "op7_near_dedup": near_query,
        "op8_quality": quality_query,
        "op9_best_fit_packing": packing_query,
        "op10_class_lm": lm_query,
        "op11_prefix_trie": trie_query,
        "op12_language": language_query,
        "op13_merkle": merkle_query,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": MIXING_SQL,
        "op3_url_rules": URL_SQL,
        "op6_exact_dedup": EXACT_SQL,
        "op7_near_dedup": NEAR_SQL,
        "op11_prefix_trie": TRIE_SQL,
        "op13_merkle": MERKLE_SQL,
    }
