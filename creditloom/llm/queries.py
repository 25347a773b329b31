"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.tables import table

from . import langid, licenses, pii, quality, toxicity
from .common import crc_mod, fresh_folder, written
from .decontaminate import contaminated
from .jaccard import JaccardJoin
from .merkle import every_fifth, manifest
from .negatives import mine
from .packing import pack_documents
from .separators import count_tokens, write_token_files
from .slots import shard_documents
from .vptree import nearest

END_OF_TEXT = 65535  # beyond the vocabulary: its own end id is also what a literal <|endoftext|> in a text gives
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


def word_tokenizer() -> str:
    """Place of the public word tokenizer's file, which lies at the same path on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return JaccardJoin(table(spark, folder, "documents"), width=3, num=90, den=100).result()


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), word_tokenizer())


@query
def op9_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    placed, maps = shard_documents(table(spark, folder, "documents"), shards=24)
    stored = fresh_folder(spark, "slot-map")
    for at in maps:
        at.save(spark, stored)
    return placed.withColumns({"map_version": F.lit(maps[-2].version), "next_version": F.lit(maps[-1].version)})


@query
def op10_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@query
def op8_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    net = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(net, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.label").alias("lang_pred"), F.col("found.score").alias("score"))


@query
def op5_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_vantage_point_trees(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


SQL["op2_vantage_point_trees"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.e AS x,
    list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op4_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = fresh_folder(spark, "tokens")
    made = write_token_files(table(spark, folder, "documents"), word_tokenizer(), files, end=END_OF_TEXT)
    return count_tokens(made, end=END_OF_TEXT)


@query
def op7_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", toxicity.assess(model, F.col("text")).alias("found")).select("doc_id", "found.*")


@query
def op1_licence_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licenses.scan(docs, licenses.fit(docs))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"), every_fifth(F.col("doc_id")))


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


def _climb(name: str, base: str) -> str:
    """All nodes of a forest: runs of sixteen are hashed until one node remains."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, digest FROM {base}
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY tree, level, pos // 16, n)"""


def _sides(name: str, nodes: str) -> str:
    return f"""{name} AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos)"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
      lambda x, _: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))))"""
SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n,
    sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS digest,
    sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_field(_LOWER)}) AS lowered,
    xor({_CRC}, 4294967295) % 5 = 0 AS altered
  FROM documents),
{_climb("nodes", "leaves")},
subroots AS (
  SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
{_climb("tops", "subroots")},
{_sides("sides", "nodes")},
{_sides("top_sides", "tops")},
steps AS (
  SELECT tree, doc_id, row_number() OVER (PARTITION BY tree, doc_id ORDER BY step) AS step, before, after FROM (
    SELECT l.tree, l.doc_id, s.level AS step, before, after FROM leaves l JOIN sides s ON s.tree = l.tree AND s.pos = l.pos >> (4 * s.level)
    UNION ALL
    SELECT l.tree, l.doc_id, 100 + s.level, before, after FROM leaves l JOIN subroots r ON r.name = l.tree
    JOIN top_sides s ON s.pos = r.pos >> (4 * s.level))),
proofs AS (SELECT tree, doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256, max(step) AS last FROM steps GROUP BY tree, doc_id),
folded AS (
  SELECT tree, doc_id, 0 AS step, CASE WHEN altered THEN lowered ELSE digest END AS node FROM leaves
  UNION ALL
  SELECT f.tree, f.doc_id, f.step + 1, sha256(s.before || f.node || s.after)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.doc_id = f.doc_id AND s.step = f.step + 1)
SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  f.node AS folded_root, f.node = t.digest AS verified
FROM leaves l JOIN subroots r ON r.name = l.tree CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
LEFT JOIN proofs p ON p.tree = l.tree AND p.doc_id = l.doc_id
JOIN folded f ON f.tree = l.tree AND f.doc_id = l.doc_id AND f.step = coalesce(p.last, 0)
"""


@query
def op13_angular_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL["op13_angular_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query
def op12_quadratic_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    found = written(docs.select("doc_id", held_out, quality.statistics(F.col("text")).alias("x")), "statistics")
    model = quality.fit(found.where(~F.col("held_out")), table(spark, folder, "labels"))
    rated = found.select("doc_id", "held_out", quality.rated(model, F.col("x")).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= quality.ACCEPTED).cast("int"))
