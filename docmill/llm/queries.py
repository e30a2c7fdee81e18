"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docmill.llm import common, wavelet

    path = common.fresh_path(spark, "op1")
    wavelet.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import gam

    return gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import common, warc

    path = common.fresh_path(spark, "op4")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("url")


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import pivot_topk

    return pivot_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import weighted_minhash

    return weighted_minhash.classes(_table(spark, sf_dir, "documents"))


def op7_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("failed")


def op8_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docmill.llm import trie_counts

    return trie_counts.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_hof_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docmill.llm import hof_bpe

    return hof_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import interleave

    return interleave.shards(_table(spark, sf_dir, "documents"))


def op11_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docmill.llm import packing

    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op12_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import conversations

    rows = _table(spark, sf_dir, "conversations")
    return conversations.summary(conversations.damage(rows), rows)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import variants

    return variants.group(variants.words(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_gam_quality": op3_gam_quality,
    "op4_warc_chain": op4_warc_chain,
    "op5_pivot_topk": op5_pivot_topk,
    "op6_weighted_near_dedup": op6_weighted_near_dedup,
    "op7_certified_rules": op7_certified_rules,
    "op8_trie_counts": op8_trie_counts,
    "op9_hof_bpe": op9_hof_bpe,
    "op10_interleaved_shards": op10_interleaved_shards,
    "op11_grouping_packing": op11_grouping_packing,
    "op12_earley_repair": op12_earley_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

_OP5 = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM ok q JOIN ok c
  ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

_OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""



def _crc32(codes: str) -> str:
    """SQL for the crc32 of a list of bytes, bit by bit."""
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bit}), 4294967295)"


_OP12 = f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)")} % 20 AS w FROM conversations),
kept AS (SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN w = 1 THEN '' WHEN w = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN w = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE w <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM kept),
seen AS (SELECT *, left(role, 1) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k, left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS nx FROM num),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN k > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM seen),
dp AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS st, {{'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}} AS sy,
    {{'c': 5, 'a': 'I', 'r': ['assistant:']}} AS us, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS pa FROM f
  UNION ALL
  SELECT conv_id, i, list_sort([gst, iu, iia])[1], list_sort([gsy, iu, iia])[1], list_sort([gus, ia])[1], list_sort([gpa, iu])[1]
  FROM (SELECT conv_id, i, gst, gsy, gus, gpa,
      {{'c': gus.c + 5, 'a': 'I' || gus.a, 'r': list_prepend('user:', gus.r)}} AS iu, {{'c': gpa.c + 5, 'a': 'I' || gpa.a, 'r': list_prepend('assistant:', gpa.r)}} AS ia,
      {{'c': gpa.c + 10, 'a': 'II' || gpa.a, 'r': list_concat(['user:', 'assistant:'], gpa.r)}} AS iia
    FROM (SELECT conv_id, i, list_sort([{{'c': st.c + 2, 'a': 'D' || st.a, 'r': st.r}}, ku, ru, {{'c': CASE WHEN e = 's' THEN t + sy.c ELSE 1000000000 END, 'a': 'K' || sy.a, 'r': list_prepend(line, sy.r)}}])[1] AS gst,
        list_sort([{{'c': sy.c + 2, 'a': 'D' || sy.a, 'r': sy.r}}, ku, ru])[1] AS gsy,
        list_sort([{{'c': us.c + 2, 'a': 'D' || us.a, 'r': us.r}}, {{'c': CASE WHEN e = 'a' THEN t + pa.c ELSE 1000000000 END, 'a': 'K' || pa.a, 'r': list_prepend(line, pa.r)}},
          {{'c': CASE WHEN e <> 'a' THEN t + 1 + pa.c ELSE 1000000000 END, 'a': 'R' || pa.a, 'r': list_prepend('assistant:' || text, pa.r)}}])[1] AS gus,
        list_sort([{{'c': pa.c + 2, 'a': 'D' || pa.a, 'r': pa.r}}, ku, ru])[1] AS gpa
      FROM (SELECT dp.*  EXCLUDE (i), f.i, e, text, role || ':' || text AS line, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS t,
          {{'c': CASE WHEN e = 'u' THEN t + us.c ELSE 1000000000 END, 'a': 'K' || us.a, 'r': list_prepend(role || ':' || text, us.r)}} AS ku,
          {{'c': CASE WHEN e <> 'u' THEN t + 1 + us.c ELSE 1000000000 END, 'a': 'R' || us.a, 'r': list_prepend('user:' || text, us.r)}} AS ru
        FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i - 1)))),
best AS (SELECT conv_id, st.c AS cost, st.a AS audit, sha256(array_to_string(st.r, chr(10))) AS d FROM dp WHERE i = 1),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS dup, count(*) FILTER (fault = 3) AS cut,
  count(*) FILTER (i < n AND e || nx NOT IN ('su', 'ua', 'au')) AS bad FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated, coalesce(bad, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(d, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON o.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""

_POINTS = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))"
# one byte a code point, as the distance counts bytes
_SINGLE = "array_to_string(list_transform(string_split(word, ''), lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE chr(unicode(x) - 191) END), '')"
_OP13 = f"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM found GROUP BY ALL HAVING length(run) >= 6),
hashed AS (SELECT run, k, {_crc32(_POINTS.format("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM low),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM hashed),
w AS (SELECT word, sum(k)::BIGINT AS n, {_SINGLE} AS s FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
pairs AS (SELECT a.word, b.word AS other, b.n FROM w a JOIN w b ON left(a.word, 3) = left(b.word, 3) AND abs(length(a.s) - length(b.s)) <= 1 AND levenshtein(a.s, b.s) = 1
  UNION SELECT a.word, b.word AS other, b.n FROM w a JOIN w b ON right(a.word, 3) = right(b.word, 3) AND abs(length(a.s) - length(b.s)) <= 1 AND levenshtein(a.s, b.s) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS c FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(c, 0)::BIGINT AS n_near, CASE WHEN ranked.n >= 5 * w.n THEN other END AS form, CASE WHEN ranked.n >= 5 * w.n THEN ranked.n END AS form_n FROM w LEFT JOIN ranked ON w.word = ranked.word AND r = 1),
chain AS (SELECT word, word AS tip, 0 AS k FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON chain.tip = forms.word WHERE form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, max_by(tip, k) AS root FROM chain GROUP BY word) USING (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_warc_chain": _OP4,
    "op5_pivot_topk": _OP5,
    "op7_certified_rules": quality_rules.oracle(),
    "op12_earley_repair": _OP12,
    "op13_spelling_variants": _OP13,
}
