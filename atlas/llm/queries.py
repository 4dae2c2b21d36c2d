"""Queries of the pipeline operators over the given tables, with checking SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.llm import (decontaminate, jaccard, language_model, lines, merkle, neighbours, packing, quality, ranking, substrings,
                       toxicity, urls, wavelet)
from atlas.llm.common import fold, lower_ascii, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

URL_RULES: list[urls.Rule] = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            CHECKS[build.__name__] = sql
        return build
    return register


@query()
def op1_hilbert_neighbours(spark, folder):
    """Nearest 20 of every twentieth vector."""
    return neighbours.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query()
def op2_bloom_scores(spark, folder):
    """Model and unigram scores of all documents."""
    scored = language_model.score(table(spark, folder, "documents"), fold("doc_id") != 1)
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op3_fragment_join(spark, folder):
    """Components of documents whose sets of three-word shingles are similar by 0.9."""
    return jaccard.join(table(spark, folder, "documents"))


@query()
def op4_simhash_leaks(spark, folder):
    """Benchmark items found in documents."""
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


@query()
def op5_pack_windows(spark, folder):
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


@query()
def op6_quality_ranking(spark, folder):
    """Quality of all documents by pairwise ranking."""
    scored = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


OP7 = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM docs WHERE len(l) >= 3)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n
  FROM windows WHERE trim(replace(w, chr(10), ' ')) <> ''),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM ranked WHERE n > 1),
covered AS (SELECT doc_id, list(i) AS c FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(coalesce(len(c), 0) AS INTEGER) AS n_removed,
       md5(CASE WHEN c IS NULL THEN text
           ELSE array_to_string([x FOR x, i IN l IF NOT list_contains(c, i)], chr(10)) END) AS text_md5
FROM docs LEFT JOIN covered USING (doc_id)
"""


@query(OP7)
def op7_line_windows(spark, folder):
    """Documents without the later occurrences of three-line windows."""
    done = lines.cleaned(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def op8_wavelet_tokens(spark, folder):
    """Token ids of all documents, written as wavelet matrices and read back."""
    docs = table(spark, folder, "documents")
    place = wavelet.new_folder(docs)
    files = wavelet.write_tokens(docs, place, TOKENIZER)
    return wavelet.read_tokens(files, place).drop("ids")


@query()
def op9_url_models(spark, folder):
    """Verdict on every page's URL."""
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


@query()
def op10_toxicity(spark, folder):
    """Toxicity of all documents by weak supervision."""
    scored = toxicity.toxic(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"),
                         F.col("is_toxic").cast("int").alias("predicted"))


OP11 = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
         [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS given FROM documents),
heads AS (
  SELECT doc_id, source, text, name,
         array_to_string([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN given], '') AS head FROM fields),
crcs AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM heads),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM crcs),
low(level, source, pos, n, h) AS (
  SELECT 0, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, count(*) OVER (PARTITION BY source), leaf FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY level, source, pos // 16, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS many FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, place, many, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
sides AS (
  SELECT 0 AS tree, level, source, pos, array_to_string(own[1:pos % 16], '') AS l, array_to_string(own[pos % 16 + 2:], '') AS r
  FROM (SELECT *, list(h) OVER (PARTITION BY level, source, pos // 16 ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS own FROM low WHERE n > 1)
  UNION ALL
  SELECT 1, level, NULL, pos, array_to_string(own[1:pos % 16], ''), array_to_string(own[pos % 16 + 2:], '')
  FROM (SELECT *, list(h) OVER (PARTITION BY level, pos // 16 ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS own FROM high WHERE n > 1)),
starts AS (
  SELECT doc_id, source, leaf, coalesce(tampered, leaf) AS seen,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
climb(doc_id, source, leaf, tree, level, pos, n, h, siblings) AS (
  SELECT doc_id, source, leaf, 0, 0, pos, n, seen, '' FROM starts
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, CASE WHEN c.n = 1 THEN 1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.n = 1 THEN s.place ELSE c.pos // 16 END, CASE WHEN c.n = 1 THEN s.many ELSE (c.n + 15) // 16 END,
         CASE WHEN c.n = 1 THEN c.h ELSE sha256(x.l || c.h || x.r) END,
         c.siblings || CASE WHEN c.n = 1 THEN '' ELSE x.l || x.r END
  FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source
  LEFT JOIN sides x ON c.n > 1 AND x.tree = c.tree AND x.level = c.level AND x.pos = c.pos
    AND (c.tree = 1 OR x.source IS NOT DISTINCT FROM c.source)
  WHERE NOT (c.tree = 1 AND c.n = 1))
SELECT c.doc_id, c.leaf, s.subroot, t.h AS root, sha256(c.siblings) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source CROSS JOIN (SELECT h FROM high WHERE n = 1) t
WHERE c.tree = 1 AND c.n = 1
"""


@query(OP11)
def op11_lag_manifest(spark, folder):
    """Hashes and proofs of all documents, checked against a copy in which some texts are lower-cased."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    seen = F.when(tampered, merkle.leaf(*fields, lower_ascii(F.col("text"))))
    done = merkle.manifest(docs, [*fields, F.col("text")], F.col("source"), F.col("doc_id"), seen=seen)
    return done.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
                       merkle.folded(F.coalesce("seen", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


OP12 = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
terms AS (SELECT doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM found),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, whole GROUP BY term, docs),
short AS (SELECT doc_id, 10 + (90 * n * docs) // len AS m FROM sizes, whole),
wanted AS (
  SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN short USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query(OP12)
def op12_interval_search(spark, folder):
    """The ten best documents for every benchmark item."""
    return ranking.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP13 = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS i FROM windows JOIN firsts USING (h) WHERE least < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query(OP13)
def op13_doubled_windows(spark, folder):
    """Documents without words of 50-word windows that an earlier document holds."""
    done = substrings.cleaned(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
