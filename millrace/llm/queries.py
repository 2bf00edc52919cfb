"""The operators of this folder as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import html, kneser, langid, lines, merkle, minhash, mixing, pieces, pii, search, secrets, toxicity, vectors
from millrace.workload.registry import table

QUERIES = {}
ORACLES = {}

PIECE_MODEL = "piece_bpe_32k.model"


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals),
-- sources by the level at which they reach their limit; the level holds from the first that stays below
ordered AS (
  SELECT *, row_number() OVER o AS place,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    2.0 * CAST(sum(source_size) OVER o - source_size AS DOUBLE) AS held,
    CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS DOUBLE) AS free
  FROM ranked WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT arg_min(1.5 * total - held, place) AS num, arg_min(free, place) AS free
  FROM ordered WHERE weight * (1.5 * total - held) / free <= 2.0 * source_size),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(weight * num / free, 2.0 * source_size)) AS target
  FROM ranked, level),
rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END ELSE 0 END
    * size AS taken
FROM rated
"""


@register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: counts of the base kinds, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [
        F.size(F.filter("spans", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in secrets.BASE_KINDS
    ]
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


@register
def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of each document, whether it is kept, and a digest of its text without frequent lines."""
    judged = lines.judge(table(spark, sf_dir, "documents")).drop("host")
    return judged.withColumn("clean_sha256", F.sha2("clean", 256)).drop("clean")


@register
def op6_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register
def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@register
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with pseudonyms in place of valid personal numbers and dates."""
    return pii.pseudonyms(table(spark, sf_dir, "documents"), secret="query key")


@register
def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return vectors.linked(table(spark, sf_dir, "embeddings"))


@register
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-duplicates of each document, and whether it is the one that stays."""
    return minhash.groups(table(spark, sf_dir, "documents")).drop("node")


@register
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document, the limits of its language, and whether it is kept."""
    return kneser.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("node")


@register
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned outside the held-out fold."""
    return langid.classify(table(spark, sf_dir, "documents"), PIECE_MODEL)


@register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and whether it still verifies after tampering."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.audit(table(spark, sf_dir, "documents"), tampered).drop("source", "path")


def _merkle_field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _merkle_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_merkle_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE marked AS (
  -- crc32 by its definition: each byte of the decimal id, then eight shifts; the last bit is inverted
  SELECT *, list_reduce(
      flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: list_concat([CAST(unicode(c) AS BIGINT)], [256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END,
      CAST(4294967295 AS BIGINT)) & 1 = 1 AS even
  FROM documents),
leaves AS (
  SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other FROM marked),
digests AS (SELECT doc_id, source, {_merkle_leaf("text")} AS leaf, {_merkle_leaf("other")} AS changed FROM leaves),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM digests),
low AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth, count(*) OVER () AS sources
  FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, nth AS pos, sources AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
paths AS (
  SELECT p.doc_id, p.source, p.pos AS place, u.lvl AS step,
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < p.pos // CAST(pow(3, u.lvl) AS BIGINT)), '') AS before,
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > p.pos // CAST(pow(3, u.lvl) AS BIGINT)), '') AS after
  FROM placed p JOIN low u ON p.source IS NOT DISTINCT FROM u.source AND u.n > 1
    AND u.pos // 3 = p.pos // CAST(pow(3, u.lvl + 1) AS BIGINT)
  GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.source, p.pos, 1000 + u.lvl,
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.nth // CAST(pow(3, u.lvl) AS BIGINT)), ''),
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.nth // CAST(pow(3, u.lvl) AS BIGINT)), '')
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
    JOIN high u ON u.n > 1 AND u.pos // 3 = s.nth // CAST(pow(3, u.lvl + 1) AS BIGINT)
  GROUP BY ALL),
whole AS (
  SELECT source, place, list(before ORDER BY step) AS befores, list(after ORDER BY step) AS afters,
    string_agg(before || after, '' ORDER BY step) AS siblings
  FROM paths GROUP BY source, place),
fold AS (
  SELECT p.source, p.pos, 1 AS step, p.changed AS h, befores, afters FROM placed p
    LEFT JOIN whole w ON w.place = p.pos AND w.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT source, pos, step + 1, sha256(befores[step] || h || afters[step]), befores, afters
  FROM fold WHERE step <= len(befores))
SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM high WHERE n = 1) AS root,
  sha256(coalesce(w.siblings, '')) AS proof_sha256, f.h AS folded_root,
  f.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  LEFT JOIN whole w ON w.place = p.pos AND w.source IS NOT DISTINCT FROM p.source
  JOIN fold f ON f.pos = p.pos AND f.source IS NOT DISTINCT FROM p.source AND f.step > coalesce(len(f.befores), 0)
"""


@register
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"""unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term"""

ORACLES["op13_ranked_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS node, doc_id, text FROM documents),
terms AS (SELECT node, {_TERMS} FROM docs),
found AS (SELECT node, term, count(*) AS tf FROM terms GROUP BY node, term),
lengths AS (SELECT node, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY node),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM found, whole GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, node,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (node), whole
  GROUP BY item_id, node)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN docs USING (node) WHERE score > 0
QUALIFY rank <= 10
"""
