"""One registered query for each operator of this subpackage."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import annular, bpe, chaining, itq, langid, minhash, mixing, quality, ranks, sharding, suffixes, turns, wordpiece
from tessera.sources.tables import table

BYTE_PAIRS = os.environ.get("TESSERA_BYTE_PAIRS", public_tokenizers.path("byte_bpe_50k.json"))
RANKS = os.environ.get("TESSERA_RANKS", public_tokenizers.path("byte_bpe_50k.tiktoken"))
PIECES = os.environ.get("TESSERA_PIECES", public_tokenizers.path("piece_bpe_32k.model"))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document; its least doc_id is kept."""
    found = minhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings; in
    ``text``, bytes of characters that a cut went through are replaced."""
    found = suffixes.without_repeats(_documents(spark, sf_dir, "doc_id", "text"), drop_text=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.expr("make_valid_utf8(CAST(kept AS STRING))").alias("text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign_shards(_documents(spark, sf_dir, "doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return wordpiece.with_piece_counts(_documents(spark, sf_dir, "doc_id", "text"), PIECES, drop_text=True)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share, each pair from both its sides: every document
    of a class has a row of its own, its hub one for each pair."""
    found = chaining.shared_passages(_documents(spark, sf_dir, "doc_id", "text"))
    own, other, rest = ("doc_id", "start", "end"), ("other_doc_id", "other_start", "other_end"), ("matched", "similarity", "class_id", "class_start")
    sides = [F.struct(*[F.col(c).alias(n) for c, n in zip(side, own + other, strict=True)], *rest) for side in (own + other, other + own)]
    return found.select(F.inline(F.array(*sides)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    known = quality.references(_documents(spark, sf_dir, "text", "lang"))
    return quality.with_quality(_documents(spark, sf_dir, "doc_id", "text"), known, drop_text=True)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "source")).drop("text_hash", "source")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.with_tokens(_documents(spark, sf_dir, "doc_id", "text"), BYTE_PAIRS, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), drop_text=True)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.with_language(docs.select("doc_id", "held_out", "text"), model, drop_text=True)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicates of every vector; the least vec_id of each group is kept."""
    found = itq.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error, and the error of its label's vectors."""
    found = annular.with_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and then repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return turns.repairs(turns.damaged(rows), gone="gone")


def op13_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by ranks."""
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return ranks.with_rank_tokens(_documents(spark, sf_dir, "doc_id", "text"), RANKS, public_tokenizers.PATTERN, outputs=outputs, drop_text=True)


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_suffixes, op3_sharding, op4_token_counts, op5_passages, op6_quality, op7_mixing, op8_bpe, op9_language, op10_embeddings, op11_codes, op12_turns, op13_ranks)
}

#: Shards: every depth of every hash is summed, and each document takes the
#: least depth that fits.  Good for tables that need at most 24 bits.
_SHARDS = f"""
WITH g AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, ''))))[1:15] AS BIGINT) AS hash
  FROM documents),
l AS (SELECT d, hash >> CAST(60 - d AS BIGINT) AS p, sum(n_bytes) AS b FROM g, range(0, 25) t(d) GROUP BY d, p),
f AS (SELECT g.doc_id, g.n_bytes, g.hash, min(l.d) AS d FROM g JOIN l ON l.p = g.hash >> CAST(60 - l.d AS BIGINT)
      WHERE l.b <= {sharding.LIMIT} GROUP BY g.doc_id, g.n_bytes, g.hash)
SELECT f.doc_id, CAST(f.n_bytes AS BIGINT) AS n_bytes, CAST(f.d AS INTEGER) AS depth, l.p AS prefix, CAST(0 AS BIGINT) AS page, CAST(l.b AS BIGINT) AS shard_bytes
FROM f JOIN l ON l.d = f.d AND l.p = f.hash >> CAST(60 - f.d AS BIGINT)
"""

_B, _R = mixing.BLOCK, mixing.REPEATS
_MIX = f"""
WITH z AS (
  SELECT doc_id, source, md5(text) AS th, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY doc_id, source, md5(text)) - 1 AS nth FROM documents),
zh AS (SELECT *, md5(concat_ws(':', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(th, ''), CAST(nth AS VARCHAR))) AS h FROM z),
d AS (SELECT doc_id, source, th, size, nth, CAST('0x' || h[1:12] AS BIGINT) AS at, CAST('0x' || h[13:24] AS BIGINT) AS ord FROM zh),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * ss AS cap FROM s0),
s2 AS (SELECT *, 1.5::DOUBLE * sum(ss) OVER () AS total, coalesce(sum(cap) OVER b, 0) AS cb, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS wl
       FROM s1 WINDOW b AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - cb) * w >= cap * wl AS capped FROM s2),
s4 AS (SELECT source, place, ss, CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM s3),
s5 AS (SELECT *, CAST(greatest(1, ceil(sum(ss) OVER () / {mixing.SHARD})) AS BIGINT) AS n FROM s4),
s AS (SELECT *, CAST(least(n, greatest(1, ceil(target / {_B * mixing.BLOCKS_A_SHARD}))) AS BIGINT) AS own FROM s5),
r AS (SELECT d.*, s.place, s.ss, s.target, ((d.at % s.own) * s.n) // s.own AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p0 AS (SELECT shard, place, CAST(sum(size) AS DOUBLE) AS part, min(target) AS target, min(ss) AS ss FROM r GROUP BY shard, place),
p1 AS (SELECT shard, place, part, CASE WHEN ss > 0 THEN round(target * part / ss, 6) ELSE 0 END AS want FROM p0),
p2 AS (SELECT *, round(sum(want) OVER (PARTITION BY shard), 4) AS al, count(*) OVER (PARTITION BY shard) AS n FROM p1),
p3 AS (SELECT *, round(al / {_B}) AS blocks, CASE WHEN al > 0 THEN want / al ELSE 0 END AS f FROM p2),
q0 AS (SELECT shard, place, want, blocks, unnest(range(0, CAST(floor(f * blocks) + ceil(f * n / 2) + 3 AS BIGINT))) AS k FROM p3 WHERE want > 0),
q1 AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY want / (2 * k + 1) DESC, place, k) AS rank FROM q0),
q AS (SELECT shard, place, count(*) AS quota FROM q1 WHERE rank <= blocks GROUP BY shard, place),
x AS (SELECT p3.shard, p3.place, CAST(part AS BIGINT) AS part, least(coalesce(quota, 0) * {_B}, {_R} * CAST(part AS BIGINT)) AS words FROM p3 LEFT JOIN q USING (shard, place)),
y AS (SELECT r.*, x.part, x.words, coalesce(sum(size) OVER (PARTITION BY r.shard, r.place ORDER BY ord, doc_id NULLS FIRST, size, th NULLS FIRST, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum
      FROM r JOIN x ON r.shard = x.shard AND r.place = x.place)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
       CAST((words // greatest(part, 1)) * size + least(greatest(words - (words // greatest(part, 1)) * part - cum, 0), size) AS BIGINT) AS taken
FROM y
"""



def _codes() -> str:
    """Codes: each round assigns all parts to entries, then takes their floored means."""
    cut = "[CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]".format(scale=annular.SCALE)
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, {cut} AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""p AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {annular.PARTS} + 1 : (part + 1) * len(v) // {annular.PARTS}] AS x
  FROM v, (SELECT unnest(range({annular.PARTS})) AS part))""",
        f"""b0 AS MATERIALIZED (
  SELECT part, e, x AS c FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM v) JOIN p USING (r) WHERE e < {annular.ENTRIES})""",
    ]
    assign = """a{k} AS MATERIALIZED (
  SELECT r, part, min({{'d': list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN range(1, len(x) + 1)]), 'e': e}}) AS m
  FROM p JOIN b{k} USING (part) GROUP BY r, part)"""
    move = """b{n} AS MATERIALIZED (
  SELECT part, e, coalesce(f, c) AS c FROM b{k} LEFT JOIN (
    SELECT part, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY j) AS f FROM (
      SELECT part, m.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS j)
      GROUP BY part, m.e, j) GROUP BY part, e) USING (part, e))"""
    for k in range(annular.ROUNDS):
        steps += [assign.format(k=k), move.format(k=k, n=k + 1)]
    last = annular.ROUNDS
    steps += [
        assign.format(k=last),
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{last})",
        f"f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY r)",
    ]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (r), h"""


#: Conversations: CRC32 by its table, the faults, then costs to go from the last turn
#: back, and the walk, one turn or insertion of all conversations in each step.
_TURNS = r"""
WITH RECURSIVE
t AS (SELECT [list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) FOR n IN range(0, 256)] AS f),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [CAST(ord(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')] AS b
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda a, x: xor(a >> 8, f[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM named, t),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS i, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv FROM damaged),
turns AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
              WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM placed),
counted AS MATERIALIZED (
  SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv),
go(conv, i, c) AS (
  SELECT conv, n, [0, 4, 2, 0]::BIGINT[] FROM counted
  UNION ALL
  SELECT conv, i, [least(m[1], u + 2), least(m[2], u + 2), u, least(m[4], m[3] + 2)] FROM (
    SELECT conv, i, m, least(m[3], m[4] + 2) AS u FROM (
      SELECT go.conv, go.i - 1 AS i,
             CASE WHEN fault IN (1, 2) THEN [c[1] + 3, c[2] + 3, c[3] + 3, c[4] + 3]
                  ELSE [least(c[1] + 3, c[3] + 2 + (fault // 3), CASE initial WHEN 's' THEN c[2] + fault // 3 WHEN 'u' THEN c[3] + fault // 3 END),
                        least(c[2] + 3, c[3] + 2 + (fault // 3), CASE initial WHEN 'u' THEN c[3] + fault // 3 END),
                        least(c[3] + 3, c[4] + 2 + (fault // 3), CASE initial WHEN 'a' THEN c[4] + fault // 3 END),
                        least(c[4] + 3, c[3] + 2 + (fault // 3), CASE initial WHEN 'u' THEN c[3] + fault // 3 END)] END AS m
      FROM go JOIN turns ON turns.conv = go.conv AND turns.i = go.i))),
costs AS MATERIALIZED (SELECT * FROM go),
walk(conv, i, g, audit, lines) AS (
  SELECT conv, CAST(0 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM counted
  UNION ALL
  SELECT conv, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN g WHEN 'K' THEN kept ELSE following END, audit || edit,
         CASE edit WHEN 'D' THEN lines ELSE list_append(lines, CASE edit WHEN 'K' THEN role ELSE given END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT w.*, kept, following, role, text, CASE following WHEN 2 THEN 'user' ELSE 'assistant' END AS given,
           CASE WHEN a.c[g + 1] + 3 = b.c[g + 1] THEN 'D' WHEN b.c[following + 1] + 2 = b.c[g + 1] THEN 'I' WHEN a.c[kept + 1] + fault // 3 = b.c[g + 1] THEN 'K' ELSE 'R' END AS edit
    FROM (SELECT w.*, [2, 2, 3, 2][g + 1] AS following, turns.role, turns.text, turns.fault,
                 CASE WHEN initial = 's' AND g = 0 THEN 1 WHEN initial = 'u' AND g <> 2 THEN 2 WHEN initial = 'a' AND g = 2 THEN 3 END AS kept
          FROM walk w LEFT JOIN turns ON turns.conv = w.conv AND turns.i = w.i + 1 WHERE turns.i IS NOT NULL OR g NOT IN (0, 3)) w
    JOIN costs b ON b.conv = w.conv AND b.i = w.i LEFT JOIN costs a ON a.conv = w.conv AND a.i = w.i + 1)),
found AS (
  SELECT counted.*, c[1] AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
  FROM counted JOIN walk ON walk.conv = counted.conv AND walk.i = n AND g IN (0, 3) JOIN costs ON costs.conv = counted.conv AND costs.i = 0)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL: dict[str, str] = {"op11_codes": _codes(), "op12_turns": _TURNS, "op3_sharding": _SHARDS, "op7_mixing": _MIX}
