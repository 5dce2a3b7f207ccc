"""One registered query per operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaframe.llm import chat, decontaminate, html, language, licenses, mixing, packing, quality, search, simhash, tokens, warc, whitening
from mediaframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


@query
def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.report(turns.unionByName(fixed))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_WORDS = r"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL["op2_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
pos AS (
  SELECT r, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS win,
    unnest(range(1, len(w) - m + 2)) AS i
  FROM d, m WHERE len(w) >= m),
hit AS (SELECT p.r, p.i, p.m, bw.item_id FROM pos p JOIN bw ON bw.m = p.m AND bw.win = p.win),
hw AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hit) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(len(it.ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(it.ids, ','), '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""

_BOILER_SQL = quality.BOILERPLATE.replace("'", "''")
_SEP_SQL = quality.SEPARATOR.replace("'", "''")
_STOP_SQL = quality.STOP.replace("'", "''")
_TOKENS = r"list_filter(regexp_split_to_array({t}, '[ \x09-\x0D]+'), lambda x: x <> '')"

SQL["op3_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_TOKENS.format(t="text")} AS w FROM d),
l AS (
  SELECT r, i, line, {_TOKENS.format(t="line")} AS lw
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
j AS (
  SELECT r, len(lw) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
    len(list_filter(lw, lambda x: regexp_full_match(x, '{_SEP_SQL}') AND contains('|/>»›•·–—→-*+:', x[1]))) AS seps,
    NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}') AS loud,
    len(list_filter(range(1, len(lw)), lambda k: lw[k] = lw[k + 1])) AS stutter,
    coalesce(list_sum(list_transform(regexp_extract_all(lower(line), '{_BOILER_SQL}'), lambda x: len(string_split(x, ' ')))), 0) * 3 >= len(lw) AS boiler,
    len(list_filter(lw, lambda x: regexp_matches(x, '{_STOP_SQL}'))) AS stops
  FROM l WHERE len(lw) > 0),
s AS (
  SELECT r, count(*) FILTER (dup) AS n_dup_lines,
    coalesce(sum(n) FILTER (sym * 2 > n OR (seps >= 3 AND seps * 5 >= n) OR (n >= 3 AND loud) OR (n >= 8 AND stutter * 3 >= n)
      OR (n <= 20 AND boiler) OR (n >= 12 AND stops = 0)), 0) AS lost
  FROM j GROUP BY r),
t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c
  FROM (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS win, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM t WHERE c > 1) GROUP BY r),
f AS (
  SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(s.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(s.lost, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN s USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= {quality.MAX_LOST} * n_words AS kept
FROM f
"""

_GOLDEN = f"{mixing.GOLDEN}::HUGEINT"
_B = mixing.BLOCK_WORDS
_MOST = mixing.MOST

SQL["op5_mixing"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len({_TOKENS.format(t="text")}), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
src AS (
  SELECT *, (ARRAY[5, 2, 1])[1 + no % 3]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS no FROM d GROUP BY source)),
-- sources in the order in which they reach their cap; the first that does not fill it sets the level for itself and the rest
lv AS (
  SELECT *, {_MOST} * source_size / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum({_MOST} * source_size) OVER (ORDER BY {_MOST} * source_size / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY {_MOST} * source_size / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM src),
level AS (SELECT coalesce(arg_min(unit, (ratio, no)) FILTER (unit <= ratio), max(ratio)) AS u FROM lv),
tg AS (SELECT source, no, source_size, least(w * u, {_MOST} * source_size)::DOUBLE AS target, ceil(source_size / {_B})::BIGINT AS blocks FROM lv, level),
total AS (SELECT sum(target) AS t, ceil(floor(sum(target)) / {_B})::BIGINT AS slots FROM tg),
bound AS (SELECT no, blocks, sum(target) OVER (ORDER BY no) / t * 18446744073709551616.0 AS hi, coalesce(sum(target) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / t * 18446744073709551616.0 AS lo FROM tg, total),
slot AS (SELECT i, (i::HUGEINT * {_GOLDEN}) % 18446744073709551616::HUGEINT AS p FROM (SELECT unnest(range(slots)) AS i FROM total)),
ranked AS (SELECT b.no, b.blocks, row_number() OVER (PARTITION BY b.no ORDER BY i) - 1 AS rank FROM slot s JOIN bound b ON s.p >= b.lo AND s.p < b.hi),
used AS (SELECT no, rank % blocks AS block, count(*) AS n FROM ranked WHERE rank // blocks < {_MOST} GROUP BY ALL),
placed AS (
  SELECT d.*, tg.no, tg.source_size, tg.target, coalesce(sum(size) OVER (PARTITION BY no ORDER BY key, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source),
piece AS (SELECT r, no, off, size, unnest(range(off // {_B}, (off + size - 1) // {_B} + 1)) AS block FROM placed WHERE size > 0),
tk AS (
  SELECT r, sum((least((p.block + 1) * {_B}, off + size) - greatest(p.block * {_B}, off)) * n)::BIGINT AS taken
  FROM piece p JOIN used u ON u.no = p.no AND u.block = p.block GROUP BY r)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN tk USING (r)
"""

_MARKS = "|".join(chat.CONTROLS)
_MARKUP = sum(map(len, chat.CONTROLS)) + 1

SQL["op7_chat"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_MARKUP} + length(role) + length(text) + len(regexp_extract_all(role, '\\\\|{_MARKS}')) + len(regexp_extract_all(text, '\\\\|{_MARKS}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

SQL["op6_warc"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS rep FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(page_id <> rep, rep IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN coalesce(page_id <> rep, rep IS NOT NULL) THEN rep END AS refers_to
FROM g
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', {licenses.template_bigrams(body)!r})" for i, (name, body) in enumerate(licenses.TEMPLATES))

SQL["op8_licenses"] = f"""
WITH tpl(rank, licence, b) AS (VALUES {_TEMPLATE_ROWS}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
u AS (SELECT r, unnest(list_distinct(string_split(text, chr(10)) || regexp_split_to_array(text, '\n[ \t]*\n') || [text])) AS unit FROM d WHERE text IS NOT NULL),
w AS (SELECT r, unit, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w),
s AS (SELECT r, unit, rank, licence, 2.0 * len(list_intersect(g.b, tpl.b)) / (len(g.b) + len(tpl.b)) AS dice FROM g JOIN tpl ON len(g.b) BETWEEN len(tpl.b) * 0.66 AND len(tpl.b) * 1.51),
best AS (SELECT r, unit, max_by(licence, (dice, -rank)) AS licence, max(dice) AS dice, max_by(-rank, (dice, -rank)) AS rk FROM s WHERE dice >= {licenses.DICE} GROUP BY r, unit),
a AS (SELECT r, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences, count(*) AS n, max_by(licence, (dice, rk)) AS best, max(dice) AS dice FROM best GROUP BY r)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n, 0)::BIGINT AS n_units, best AS best_licence, coalesce(dice, 0)::DOUBLE AS best_dice
FROM d LEFT JOIN a USING (r)
"""

_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op11_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(t="text")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format(t="text")} AS w FROM benchmark),
al AS (SELECT count(*)::HUGEINT AS big_n, sum(len(w))::HUGEINT AS big_l FROM d WHERE len(w) > 0),
qt AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM b),
dt AS (SELECT r, doc_id, t, n, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::HUGEINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM dt, al GROUP BY t),
s AS (
  SELECT q, item_id, r, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM dt JOIN df USING (t) JOIN qt USING (t), al GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank, doc_id, score FROM s WHERE score > 0)
WHERE rank <= {search.K}
"""
