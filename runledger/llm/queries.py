"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import chat_format, fingerprints, lm, media, mixing, ngram_join, page_text, pieces, quality, spelling, token_files, toxicity, turn_repair
from .common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_token_counts(spark, sf_dir):
    return token_files.token_counts(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark, sf_dir):
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark, sf_dir):
    return fingerprints.near_documents(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))


def op9_media_columns(spark, sf_dir):
    return media.media_digests(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.fit_quality(docs, labels))


def op12_conversation_repair(spark, sf_dir):
    rows = turn_repair.damage(table(spark, sf_dir, "conversations"))
    return turn_repair.digest(turn_repair.repair_conversations(rows, there="there"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_ngram_jaccard_join, op2_token_counts, op3_html_extraction, op4_lm_scoring, op5_sentencepiece, op6_document_fingerprints, op7_chat_format, op8_toxicity,
                                  op9_media_columns, op10_mixing, op11_quality_classifier, op12_conversation_repair, op13_spelling_variants)}


#: crc32 in SQL: the 256 remainders of the polynomial, eight shifts each, then one look-up for each byte.
_CRC = """t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS r)"""
_CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(r[xor(c & 255, b) + 1], c // 256)))"


def _more(state: str, cost: str, letter: str) -> str:
    """SQL: a state with one edit more."""
    return f"(printf('%09d', CAST(left({state}, 9) AS BIGINT) + {cost}) || substr({state}, 10) || '{letter}')"


def _least(*states: str) -> str:
    return f"least({', '.join(states)})" if len(states) > 1 else states[0]


_STAYS, _CUT = "fault IN ('', 't')", "CASE fault WHEN 't' THEN 1 ELSE 0 END"
_EDITS = {f"d{k}": _more(f"s{k}", "3", "D") for k in range(4)}
_EDITS |= {f"i{k}": _more(f"d{k}", "2", "I") for k in range(4)} | {f"ii{k}": _more(f"d{k}", "4", "II") for k in range(4)}
_EDITS |= {f"k{to}": f"CASE WHEN {_STAYS} AND i = '{role}' THEN {_least(*[_more(x, _CUT, 'K') for x in states])} END"
           for to, role, states in ((1, "s", ["s0"]), (2, "u", ["s0", "s1", "s3"]), (3, "a", ["s2"]))}
_EDITS |= {f"r{to}": f"CASE WHEN {_STAYS} THEN {_least(*[_more(x, '2 + ' + _CUT, 'R') for x in states])} END" for to, states in ((2, ["s0", "s1", "s3"]), (3, ["s2"]))}

_OP12 = rf"""
WITH RECURSIVE {_CRC},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
c AS (SELECT k.*, {_CRC_OF.format(bytes="list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))")} % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, range(2) twice(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
n AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM d
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM n),
f AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
-- a state is its cost in nine digits, then its audit, so the least string is the cheapest, ASCII-least one; null is out of reach
z AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM conversations
  UNION ALL SELECT conv_id, k, d0, d1, least(d2, @i0, @i1, @i3), least(d3, @i2, @ii0, @ii1) FROM (
    SELECT z.conv_id, f.k, @d0 AS d0, least(@d1, @k1) AS d1, least(@d2, @k2, @r2) AS d2, least(@d3, @k3, @r3) AS d3
    FROM z JOIN f ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = z.k + 1)),
a AS (SELECT conv_id, CAST(left(least(s0, s3), 9) AS BIGINT) AS cost, substr(least(s0, s3), 10) AS audit
  FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
l AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, sum(CASE WHEN substr(audit, j, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS k,
  sum(CASE WHEN substr(audit, j, 1) <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS p
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM a)),
m AS (SELECT l.*, f.role, f.text, max(CASE WHEN l.p = 1 AND l.edit = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.k = f.k AND l.edit <> 'I' WHERE l.edit <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
  || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM m GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
  count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""

_OP13 = rf"""
WITH RECURSIVE {_CRC},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, doc_id || ':' || run AS id, count(*) AS n
  FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM o) WHERE length(run) >= 7 GROUP BY doc_id, run),
u AS (SELECT *, list_transform(range(1, length(id) + 1), lambda i: CAST(unicode(substr(id, i, 1)) AS BIGINT)) AS points FROM c),
h AS (SELECT u.*, {_CRC_OF.format(bytes="flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END))")} AS h FROM u, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
x AS (SELECT word, n, left(word, k) AS l, substr(word, k + 2) AS r FROM (SELECT word, n, unnest(range(length(word))) AS k FROM w)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON x.l || x.r = w.word
  UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.l || x.r = w.word),
b AS (SELECT word, near, near_n, near_n >= 10 * n AS is_form, count(*) OVER (PARTITION BY word) AS n_near FROM p
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT word, near AS form FROM b WHERE is_form),
z AS (SELECT word, form AS root, 1 AS depth FROM f UNION ALL SELECT z.word, f.form, depth + 1 FROM z JOIN f ON z.root = f.word),
e AS (SELECT word, root FROM z QUALIFY row_number() OVER (PARTITION BY word ORDER BY depth DESC) = 1)
SELECT w.word, CASE WHEN is_form THEN near END AS form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN is_form THEN near_n END AS form_n
FROM w LEFT JOIN b USING (word) LEFT JOIN e USING (word)"""

ORACLE_SQL = {
    "op12_conversation_repair": re.sub(r"@(\w+)", lambda m: _EDITS[m[1]], _OP12),
    "op13_spelling_variants": _OP13,
    "op7_chat_format": r"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(k)),
n AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM n
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, before IS NULL OR before <> role AS head,
  length(text) + len(regexp_extract_all(text, '<\\*\|')) AS body,
  length(role) + len(regexp_extract_all(role, '<\\*\|')) AS name FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN head THEN 12 + name + 1 + 11 ELSE 11 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE head) AS n_messages
FROM e GROUP BY conv_id""",
}
