"""DuckDB statements of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from quillgraph.llm import divergence, hard_negatives, line_rules, mixing

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, text, hash(text) AS th, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS raw
  FROM documents
), lines AS (
  SELECT doc_id, source, text, unnest(raw) AS line, generate_subscripts(raw, 1) AS pos FROM d
), worded AS (
  SELECT doc_id, source, text, line, pos,
         array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS plain,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), places AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), windows AS (
  SELECT doc_id, pos, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS documents FROM d GROUP BY source
), carried AS (
  SELECT source, plain, count(DISTINCT doc_id) AS n FROM worded GROUP BY source, plain
), frequent AS (
  SELECT c.source, c.plain FROM carried c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n > {least} AND 100 * n > documents * {percent}
), gone AS (
  SELECT w.doc_id, count(*) AS n_lines_removed, sum(w.words) AS n_words_removed
  FROM worded w JOIN frequent f ON w.source IS NOT DISTINCT FROM f.source AND w.plain = f.plain GROUP BY w.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(n_words_removed, 0) >= n_words * {min_left}::DOUBLE AS kept,
       coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(n_words_removed, 0)::BIGINT AS n_words_removed
FROM base LEFT JOIN gone USING (doc_id)
"""

#: Quotients are all written out and the highest taken, source by source and shard by shard.
OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(text) AS th, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), levels(round, level) AS (
  SELECT 0, (SELECT 1.5 * sum(source_size) / sum(weight) FROM s)::DOUBLE
  UNION ALL
  SELECT round + 1, (SELECT ((SELECT 1.5 * sum(source_size) FROM s) - sum(2 * source_size) FILTER (WHERE 2 * source_size < level * weight)) / nullif(sum(weight) FILTER (WHERE 2 * source_size >= level * weight), 0) FROM s)::DOUBLE
  FROM levels WHERE round < 30 AND level IS NOT NULL AND (SELECT count(*) FROM s WHERE 2 * source_size < level * weight) > 0
), t AS (
  SELECT source, source_size, n_rows, least(2.0 * source_size, (SELECT max(level) FROM levels) * weight)::DOUBLE AS target FROM s
), b AS (
  SELECT *, round(1.5 * sum(source_size) OVER () / block)::BIGINT AS seats
  FROM (SELECT *, greatest(1, least(ceil(1.5 * sum(source_size) OVER () / {blocks}), {most_block}))::BIGINT AS block FROM t)
), q AS (
  SELECT source, k, target / (2 * k + 1) AS quotient, seats FROM (SELECT source, target, seats, unnest(range(0, (target / block)::BIGINT + 3)) AS k FROM b WHERE target > 0)
), won AS (
  SELECT source, count(*) AS quota FROM (SELECT source, seats, row_number() OVER (ORDER BY quotient DESC, source ASC NULLS LAST) AS place FROM q) WHERE place <= seats GROUP BY source
), e AS (
  SELECT b.source, source_size, target, block, least(coalesce(quota, 0) * block, 2 * source_size)::BIGINT AS source_words, ceil((source_size + n_rows) / {shard_words})::BIGINT AS n_shards
  FROM b LEFT JOIN won ON b.source IS NOT DISTINCT FROM won.source
), p AS (
  SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.block, e.source_words, md5(concat_ws('/', '11', d.doc_id::VARCHAR, d.th)) AS draw, e.n_shards
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), p2 AS (
  SELECT *, ('0x' || substr(draw, 1, 12))::BIGINT % n_shards AS shard, ceil(n_shards / {group_shards})::BIGINT AS n_groups FROM p
), h AS (
  SELECT source, shard, shard % any_value(n_groups) AS grp, sum(size)::BIGINT AS shard_size, any_value(block) AS block, any_value(source_words) AS source_words FROM p2 GROUP BY source, shard
), g AS (
  SELECT source, grp, sum(shard_size)::BIGINT AS size, any_value(block) AS block, any_value(source_words) AS words FROM h GROUP BY source, grp
), gw AS (
  SELECT source, grp, count(*) AS quota FROM (
    SELECT source, grp, words // block AS seats, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, grp) AS place
    FROM (SELECT source, grp, words, block, size / (2 * unnest(range(0, words // block)) + 1) AS quotient FROM g WHERE size > 0)) WHERE place <= seats GROUP BY source, grp
), go AS (
  SELECT g.source, g.grp, g.words, g.size, least(coalesce(quota, 0) * g.block, 2 * g.size) AS own FROM g LEFT JOIN gw ON g.source IS NOT DISTINCT FROM gw.source AND g.grp = gw.grp
), gd AS (
  SELECT source, grp, (own + greatest(0, least(2 * size - own, words - sum(own) OVER (PARTITION BY source)
         - coalesce(sum(2 * size - own) OVER (PARTITION BY source ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS words FROM go
), hs AS (
  SELECT h.source, h.grp, h.shard, h.shard_size, h.block, gd.words FROM h JOIN gd ON h.source IS NOT DISTINCT FROM gd.source AND h.grp = gd.grp
), hw AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT source, shard, words // block AS seats, row_number() OVER (PARTITION BY source, grp ORDER BY quotient DESC, shard) AS place
    FROM (SELECT source, grp, shard, words, block, shard_size / (2 * unnest(range(0, words // block)) + 1) AS quotient FROM hs WHERE shard_size > 0)) WHERE place <= seats GROUP BY source, shard
), ho AS (
  SELECT hs.*, least(coalesce(quota, 0) * hs.block, 2 * shard_size) AS own FROM hs LEFT JOIN hw ON hs.source IS NOT DISTINCT FROM hw.source AND hs.shard = hw.shard
), hd AS (
  SELECT source, shard, shard_size, (own + greatest(0, least(2 * shard_size - own, words - sum(own) OVER (PARTITION BY source, grp)
         - coalesce(sum(2 * shard_size - own) OVER (PARTITION BY source, grp ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS wanted FROM ho
), j AS (
  SELECT p2.*, hd.shard_size, hd.wanted, coalesce(sum(p2.size) OVER (PARTITION BY p2.source, p2.shard ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM p2 JOIN hd ON p2.source IS NOT DISTINCT FROM hd.source AND p2.shard = hd.shard
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((wanted // greatest(shard_size, 1)) * size + greatest(0, least(size, wanted % greatest(shard_size, 1) - begun)))::BIGINT AS taken, source
FROM j
"""


def op1(least: int = line_rules.LEAST_DOCUMENTS, percent: float = line_rules.SHARE_PERCENT, min_left: float = line_rules.MIN_LEFT) -> str:
    """Operator 1 at the given limits."""
    return OP1.format(least=least, percent=percent, min_left=min_left)


def op8(blocks: int = mixing.BLOCKS, shard_words: int = mixing.SHARD_WORDS, group_shards: int = mixing.GROUP_SHARDS) -> str:
    """Operator 8 with the given numbers of blocks, words a shard and shards a group."""
    return OP8.format(blocks=blocks, most_block=max(1, shard_words // mixing.SHARD_BLOCKS), shard_words=shard_words, group_shards=group_shards)


#: Every term of a language is written out for every group, with a count of 0 where it doesn't occur.
OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain
  FROM documents
), words AS (
  SELECT r, doc_id, lang, source, unnest(regexp_extract_all(plain, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {least}
), found AS (
  SELECT lang, source, term, count(*) AS n, min(doc_id) AS example_doc FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS size, coalesce(terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM found GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY lang) USING (lang)
), wholes AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM found GROUP BY lang, term)
), grid AS (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, example_doc, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (size + 2 * terms) AS p
  FROM sizes s JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value, NULL::BIGINT AS example_doc
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value, example_doc
  FROM grid JOIN wholes USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank, example_doc FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


def op13() -> str:
    return OP13.format(least=divergence.LEAST_DOCUMENTS, top=divergence.TOP)


#: Every anchor is scored against every row.
OP11 = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % {every} = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
  WHERE p.place <= {taken}
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {taken}
"""


def op11() -> str:
    return OP11.format(every=hard_negatives.ANCHOR_EVERY, taken=hard_negatives.TAKEN)
