"""The operators of this folder over the standard tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, conversation_trie, mixing, packing, phrases, quality_rules, quality_trees, sanitise, secret_scan, simhash, token_counts, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in optimal length buckets and token-budget batches."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base rules and the network's additions."""
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


@_query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_trees.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories and score of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    folder = token_files.fresh_folder(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return token_files.digest_tokens(spark, folder).withColumnRenamed("key", "doc_id")


@_query()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that give it away."""
    found = sanitise.find_personal(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(sanitise.span_text(F.col("base")), 256).alias("base_sha256"),
                        sanitise.span_text(F.col("spans")).alias("spans"))


@_query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed at the tempered source weights, in blocks."""
    return mixing.mix_blocks(_table(spark, sf_dir, "documents"))


@_query("""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return content_sort.content_sort(_table(spark, sf_dir, "documents"), keep="largest")


@_query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity hash and near-duplicate group of every document."""
    return simhash.with_hex(simhash.simhash_groups(_table(spark, sf_dir, "documents")))


@_query()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
texts AS (SELECT lang, list_filter(string_split_regex(p, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
found AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS c
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, range(1, 5) AS t(k)) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM found WHERE k = 1 GROUP BY lang),
many AS (SELECT lang, k, phrase, c, string_split(phrase, ' ') AS w FROM found WHERE k > 1 AND c >= 30),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + d - 1), ' ') AS phrase, max(c) AS most
  FROM many, range(2, 4) AS a(d), range(1, 4) AS b(i) WHERE d < k AND i + d - 1 <= k GROUP BY ALL),
stay AS (SELECT m.* FROM many m LEFT JOIN inside s USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * m.c),
cuts AS (
  SELECT s.lang, s.phrase, s.c AS a, cut, x.c AS l, y.c AS r, CAST(2000000::HUGEINT * s.c // (x.c + y.c) AS BIGINT) AS score
  FROM stay s, range(1, 4) AS t(cut), found x, found y
  WHERE cut < s.k AND x.lang = s.lang AND x.phrase = array_to_string(s.w[:cut], ' ') AND y.lang = s.lang AND y.phrase = array_to_string(s.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000""")
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


@_query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("""WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h FROM ids),
own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (SELECT o.c, list_concat(coalesce(b.t[:h], []), o.t[h + 1:]) AS t FROM own o JOIN crc USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 100),
entries AS (
  SELECT c, d, len(t) AS size, min(c) OVER same AS node, length(t[d].text) AS chars, count(*) OVER same AS n
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt) WINDOW same AS (PARTITION BY d, t[:d])),
nodes AS (SELECT node AS conv_id, d AS depth, max(n) AS n_convs, coalesce((max(n) - 1) * max(chars), 0) AS saved,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d) AS ends FROM entries GROUP BY node, d),
up AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN entries p ON p.c = n.conv_id AND p.d = n.depth - 1),
held AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY ALL),
tops AS (SELECT u.saved, h.n_children IS NULL AS leaf, e.node AS conv_id, e.d AS depth
  FROM up u LEFT JOIN held h USING (conv_id, depth) JOIN entries e ON e.c = u.conv_id AND e.d <= u.depth),
sums AS (SELECT conv_id, depth, CAST(sum(leaf::INT) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM tops GROUP BY ALL)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM up LEFT JOIN held USING (conv_id, depth) JOIN sums USING (conv_id, depth)""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))
