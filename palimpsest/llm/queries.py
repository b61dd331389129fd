"""One query for each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chosen_path import near_duplicates
from palimpsest.llm.compression_classifier import fit, held_out, score
from palimpsest.llm.conversations import damage, repair_conversations
from palimpsest.llm.fm_index import drop_repeated_words
from palimpsest.llm.language_id import fit as fit_languages
from palimpsest.llm.language_id import held_out as held_out_language
from palimpsest.llm.language_id import identify
from palimpsest.llm.lexical_search import rank_documents
from palimpsest.llm.licenses import scan_licenses
from palimpsest.llm.line_chunks import CHUNKINGS, LOOK, drop_repeated_chunks
from palimpsest.llm.line_rules import (
    _NAVIGATION_MARK, _NAVIGATION_SIGNS, _SENTENCE_END, _SHOUTED, BOILERPLATE, MAX_ENTRIES, MAX_FURNITURE, MAX_REPEATED,
    MIN_KEPT, MIN_WORDS, NAVIGATION_WORDS, SYMBOLS, _any_of, clean_lines,
)
from palimpsest.llm.mixing import mix
from palimpsest.llm.one_permutation import compare_neighbours
from palimpsest.llm.packing import pack
from palimpsest.llm.suffix_array import drop_repeated_bytes

TOKENIZER = "byte_bpe_50k.json"
PIECES = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(_documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(_documents(spark, sf_dir)).drop("cleaned")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir)).drop("spans")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_languages(docs.filter(~held_out_language()), public_tokenizers.path(PIECES))
    return identify(docs, model).select("doc_id", held_out_language().alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, gone, copies = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(turns, gone=gone, copies=copies)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)
),
later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows)
    WHERE k > 1
),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS c FROM each ANTI JOIN covered USING (doc_id, p)
    GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(c, 0))::BIGINT AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
w AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, ('0x' || substr(md5(line), 1, 8))::BIGINT % {2**CHUNKINGS} AS bits
    FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
spans AS (
    SELECT a.doc_id, a.i AS first, min(b.i) AS last
    FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p + 1 AND a.p + {LOOK} AND (a.bits & b.bits) <> 0
    GROUP BY a.doc_id, a.i
),
chunks AS (SELECT doc_id, first, last, array_to_string(ls[first + 1:last + 1], chr(10)) AS body FROM spans JOIN d USING (doc_id)),
later AS (
    SELECT doc_id, first, last
    FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM chunks) WHERE k > 1
),
lines AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN lines USING (doc_id, i) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS lines FROM lines GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS chunks FROM later GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines,
    coalesce(cut.chunks, 0)::BIGINT AS n_removed_chunks, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_ENTRIES = rf"^\W*{_any_of(NAVIGATION_WORDS)}(\W+{_any_of(NAVIGATION_WORDS)})*\W*$"
_SIGNS = " OR ".join(f"contains(line, {_quoted(c)})" for c in _NAVIGATION_SIGNS)

_OP8 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (
    SELECT *, n > 0 AND (
        (n <= {MAX_ENTRIES} AND regexp_matches(lower(line), {_quoted(_ENTRIES)}))
        OR (({_SIGNS}) AND len(regexp_extract_all(line, {_quoted(_NAVIGATION_MARK)})) * 3 >= n)
        OR (n <= {MAX_FURNITURE} AND regexp_matches(lower(line), {_quoted(_any_of(BOILERPLATE))}))
        OR NOT regexp_matches(line, {_quoted(_SENTENCE_END)})
        OR (n >= 3 AND len(regexp_extract_all(line, {_quoted(_SHOUTED)})) * 2 >= n)
    ) AS failed FROM n
),
lines AS (
    SELECT doc_id, sum(CASE WHEN failed THEN 0 ELSE n END) AS n_kept_words, sum(failed::INT) AS n_failed_lines,
        count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines
    FROM f GROUP BY doc_id
),
t AS (
    SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM t) WHERE k > 1),
repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id
),
counted AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, {_quoted(SYMBOLS)}))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_kept_words::BIGINT AS n_kept_words,
        n_failed_lines::BIGINT AS n_failed_lines
    FROM w JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed,
    NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED})
        AND n_kept_words * 100 >= n_words * {MIN_KEPT} AS kept
FROM counted
"""

_OP9 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN either l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

_OP12 = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
        ORDER BY i) AS steps
    FROM (SELECT unnest(range(256)) AS i)
),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
),
summed AS (
    SELECT keyed.*, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c // 256, steps[1 + xor(c, b) % 256])), 4294967295) % 20 AS damage
    FROM keyed, crc
),
conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (
    SELECT c, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM summed JOIN conv ON summed.conv_id IS NOT DISTINCT FROM conv.conv_id WHERE damage <> 0
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS again,
        regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last
    FROM ordered
),
turns AS (
    SELECT *, substr(role, 1, 1) AS initial,
        CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed
),
inserted(s, k, st, lines) AS (
    VALUES (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
        (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
        (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])
),
edits(st, edit, initial, role, after, price) AS (
    VALUES (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 2, 0), (1, 'K', 'u', NULL, 2, 0), (2, 'K', 'a', NULL, 3, 0),
        (3, 'K', 'u', NULL, 2, 0), (0, 'R', NULL, 'user', 2, 3), (1, 'R', NULL, 'user', 2, 3), (2, 'R', NULL, 'assistant', 3, 3),
        (3, 'R', NULL, 'user', 2, 3), (0, 'D', NULL, NULL, 0, 4), (1, 'D', NULL, NULL, 1, 4), (2, 'D', NULL, NULL, 2, 4),
        (3, 'D', NULL, NULL, 3, 4)
),
best AS (
    SELECT c, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS p FROM conv
    UNION ALL
    SELECT b.c, b.i + 1, e.after, min({
        'cost': b.p.cost + 3 * n.k + e.price + CASE WHEN t.fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END,
        'audit': b.p.audit || repeat('I', n.k) || edit,
        'lines': b.p.lines || n.lines || CASE WHEN edit = 'D' THEN [] ELSE [coalesce(e.role, t.role) || ':' || t.text] END})
    FROM best b JOIN turns t ON t.c = b.c AND t.i = b.i + 1 JOIN inserted n ON n.s = b.s
        JOIN edits e ON e.st = n.st AND (e.initial IS NULL OR e.initial = t.initial)
            AND (edit = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
    GROUP BY b.c, b.i, e.after
),
counted AS (
    SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM turns) GROUP BY c
),
ends AS (
    SELECT b.c, min({'cost': b.p.cost + 3 * n.k, 'audit': b.p.audit || repeat('I', n.k), 'lines': b.p.lines || n.lines}) AS p
    FROM best b LEFT JOIN counted USING (c) JOIN inserted n ON n.s = b.s AND n.st IN (0, 3)
    WHERE b.i = coalesce(counted.n, 0) GROUP BY b.c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, p.cost::BIGINT AS cost, p.audit AS audit,
    sha256(array_to_string(p.lines, chr(10))) AS repaired_sha256
FROM conv JOIN ends USING (c) LEFT JOIN counted USING (c)
"""

_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

_OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, size),
q AS (SELECT item_id, t, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM n, size),
s AS (
    SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_fingerprints, op3_suffix_array_dedup, op4_quality_classifier, op5_best_fit_packing,
        op6_mixing, op7_line_dedup, op8_quality_rules, op9_near_dedup, op10_license_scan, op11_language_id,
        op12_conversation_repair, op13_lexical_search,
    )
}
ORACLES = {
    "op1_substring_dedup": _OP1, "op7_line_dedup": _OP7, "op8_quality_rules": _OP8, "op9_near_dedup": _OP9,
    "op12_conversation_repair": _OP12, "op13_lexical_search": _OP13,
}
