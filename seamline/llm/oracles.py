"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from seamline.llm import quality_rules, sharding

WORD = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op5_source_mix"] = rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source)
), levels(step, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) * 1.5::DOUBLE
           - coalesce(sum(CASE WHEN weight * level > source_size * 2.0::DOUBLE THEN source_size * 2.0::DOUBLE END), 0))
           / sum(CASE WHEN weight * level <= source_size * 2.0::DOUBLE THEN weight END) FROM sources)
  FROM levels WHERE step < 100
), target AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), source_size * 2.0::DOUBLE) AS target
  FROM sources
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS rest
  FROM target
), hashes AS (
  SELECT source, h, sum(size) AS words FROM rows GROUP BY source, h
), running AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h)::DOUBLE AS through FROM hashes
), border AS (
  SELECT b.source, arg_min(CASE WHEN through - rest <= rest - (through - words) THEN h + 1 ELSE h END, h) AS below
  FROM budget b JOIN running r ON b.source IS NOT DISTINCT FROM r.source
  WHERE through >= rest AND rest > 0 GROUP BY b.source
)
SELECT doc_id, size, source_size, target,
       size * (passes + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END) AS taken
FROM rows r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
LEFT JOIN border d ON r.source IS NOT DISTINCT FROM d.source
"""

ORACLES["op7_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""

_names = ", ".join(f"({k}, '{name}')" for k, name in enumerate(sharding.SHARDS))
_n, _m = len(sharding.SHARDS), sharding.SLOTS
# One step is one turn of one shard; a turn skips the slots that are taken.
ORACLES["op9_sharding"] = f"""
WITH RECURSIVE shards(k, shard) AS (VALUES {_names}),
orders AS (
  SELECT k, shard, ('0x' || substr(md5(shard || '|offset'), 1, 15))::BIGINT % {_m} AS first,
         ('0x' || substr(md5(shard || '|skip'), 1, 15))::BIGINT % {_m - 1} + 1 AS skip
  FROM shards
), lists AS (SELECT list(first ORDER BY k) AS firsts, list(skip ORDER BY k) AS skips FROM orders
), turns(turn, owners, slot) AS (
  SELECT -1, list_transform(range({_m}), lambda i: -1), -1::BIGINT
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(owners[1:s], [(turn + 1) % {_n}]), owners[s + 2:]), s
  FROM (
    SELECT turn, owners, list_extract(list_filter(
             list_transform(range({_m}), lambda j: (firsts[(turn + 1) % {_n} + 1] + j * skips[(turn + 1) % {_n} + 1]) % {_m}),
             lambda p: owners[p + 1] = -1), 1) AS s
    FROM turns, lists WHERE turn < {_m - 1}
  )
), placed AS (SELECT slot, turn % {_n} AS k FROM turns WHERE turn >= 0)
SELECT doc_id, slot::INT AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {_m} AS slot FROM documents)
JOIN placed USING (slot) JOIN shards USING (k)
"""

_bits = " + ".join(
    f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, (_, rule) in enumerate(quality_rules.RULES)
)
ORACLES["op10_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
split AS (SELECT r, doc_id, x, regexp_extract_all(x, '{WORD}') AS w FROM t),
windows AS (
  SELECT r, i, w[i : i + 4] AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)
), twice AS (SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, win HAVING count(*) > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r
), measured AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)
), marked AS (SELECT *, ({_bits})::BIGINT AS failed_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & {quality_rules.mask("base")} <> 0 AS base_failed,
       failed_bits & {quality_rules.mask("v3")} = 0 AS kept, n_lines, failed_bits
FROM marked
"""
