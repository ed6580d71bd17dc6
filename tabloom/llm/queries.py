"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from tabloom.checks import Registry
from tabloom.llm import (
    decontaminate,
    exact_sort,
    line_dedup,
    mixing,
    phrase_automata,
    quality_pu,
    quality_rules,
    simhash_vptree,
    slots,
    spelling_grams,
    suffix_dedup,
    toxicity_mil,
    warc_chunks,
)
from tabloom.llm.common import table

registry = Registry()


@registry.query("op1_decontaminate", """WITH clean AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
 FROM documents), item AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
 FROM benchmark), starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM item WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, w[a:a + 9] AS win, len(w[a:a + 9]) AS n FROM starts), lens AS (SELECT DISTINCT n FROM win),
 spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS a FROM clean), hit AS (SELECT spot.doc_id, a, win.n, item_id FROM spot
 JOIN lens ON a + lens.n - 1 <= len(w) JOIN win ON win.n = lens.n AND win.win = w[a:a + lens.n - 1]), agg AS (SELECT doc_id,
 len(list_distinct(flatten(list(range(a, a + n))))) AS n_hit, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM
 hit GROUP BY doc_id) SELECT clean.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM clean LEFT JOIN agg USING (doc_id)""")
def op1_decontaminate(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@registry.query("op2_quality")
def op2_quality(spark, folder):
    return quality_pu.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registry.query("op3_toxicity")
def op3_toxicity(spark, folder):
    return toxicity_mil.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registry.query("op4_simhash")
def op4_simhash(spark, folder):
    return simhash_vptree.near_duplicates(table(spark, folder, "documents"))


@registry.query("op5_warc", """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
 sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE
 payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1) SELECT page_id, payload_bytes,
 payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS
 record_type, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p LEFT JOIN f
 USING (payload_digest)""")
def op5_warc(spark, folder):
    return warc_chunks.round_trip(table(spark, folder, "pages"))


@registry.query("op6_suffixes")
def op6_suffixes(spark, folder):
    return suffix_dedup.deduplicated(table(spark, folder, "documents"))


@registry.query("op7_mixing")
def op7_mixing(spark, folder):
    return mixing.report(table(spark, folder, "documents"))


@registry.query("op8_rules", r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
 list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 win AS (SELECT r, i, w[i:i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
 cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
 m AS (SELECT r, doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS
 word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) -
 len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN cov
 USING (r)), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
 OR 10 * n_symbols > n_words OR 10 * length(regexp_replace(t, '[^!?]', '', 'g')) > n_words
 OR 10 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 4 * length(t) OR 2 * word_chars < 5 * n_words
 OR word_chars > 12 * n_words OR 2 * n_dup_lines > len(lines) OR 10 * len(list_distinct(w)) < n_words) AS kept FROM b""")
def op8_rules(spark, folder):
    return quality_rules.report(table(spark, folder, "documents"))


@registry.query("op9_site_lines", rf"""WITH p AS (SELECT row_number() OVER () AS r, page_id,
 lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
 list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '{line_dedup.UNSEEN}', ' ', 'g'),
 '{line_dedup.BLOCK}'), lambda x: trim(regexp_replace(x, '{line_dedup.TAG_OR_BLANKS}', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
 FROM pages), seen AS (SELECT host, x, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS x FROM p) GROUP BY ALL),
 total AS (SELECT host, count(*) AS pages FROM p GROUP BY host), often AS (SELECT host, list(x) AS marks FROM seen JOIN total
 USING (host) WHERE pages >= {line_dedup.LEAST_PAGES} AND n > {line_dedup.RATIO} * pages GROUP BY host),
 k AS (SELECT p.*, list_filter(lines, lambda x: NOT list_contains(coalesce(marks, []), x)) AS kept FROM p LEFT JOIN often USING (host))
 SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
 sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k""")
def op9_site_lines(spark, folder):
    return line_dedup.report(table(spark, folder, "pages"))


@registry.query("op10_slots")
def op10_slots(spark, folder):
    return slots.shard_rows(table(spark, folder, "documents"))


@registry.query("op12_exact", r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
 FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d""")
def op12_exact(spark, folder):
    return exact_sort.report(table(spark, folder, "documents"))


@registry.query("op13_phrases", r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(
 coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 q AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS x FROM q, range(1, 4) t(k)
 WHERE len(w) >= k), f AS (SELECT lang, x, count(*) AS f FROM g GROUP BY lang, x),
 n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(x) = 1 GROUP BY lang),
 c AS (SELECT lang, x, f AS a FROM f WHERE len(x) > 1 AND f >= 10),
 k AS (SELECT lang, x, a, unnest(range(1, len(x))) AS k FROM c),
 s AS (SELECT k.lang, k.x, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM k
 JOIN f l ON l.lang = k.lang AND l.x = k.x[:k] JOIN f r ON r.lang = k.lang AND r.x = k.x[k + 1:]),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
 longer AS (SELECT lang, y, max(a) AS m FROM (SELECT lang, a, unnest([x[1:2], x[2:3]]) AS y FROM c WHERE len(x) = 3) GROUP BY lang, y),
 o AS (SELECT b.*, array_to_string(x, ' ') AS phrase FROM b LEFT JOIN longer ON longer.lang = b.lang AND y = x
 WHERE m IS NULL OR 100 * m < 50 * a)
 SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
 CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000""")
def op13_phrases(spark, folder):
    return phrase_automata.collocations(table(spark, folder, "documents"))


@registry.query("op11_spelling", r"""WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
 list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS run FROM documents),
 d AS (SELECT id, run, count(*) AS m, hex(encode(id || ':' || run)) AS x FROM o GROUP BY ALL),
 b AS (SELECT id, run, m, list_transform(range(1, length(x) // 2 + 1), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i - 1]) - 1)
 + instr('0123456789ABCDEF', x[2 * i]) - 1) AS bytes FROM d),
 h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, e: xor(c >> 8, t[CAST((xor(c, e) & 255) + 1 AS
 BIGINT)])), 4294967295) AS h FROM b, t),
 c AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, m FROM h),
 w AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
 v AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
 p AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
 AND length(a.word) = length(b.word) UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.cut = b.word UNION
 SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.cut = b.word),
 r AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near)
 AS place FROM p),
 f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN near END AS form,
 CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n FROM w LEFT JOIN r ON r.word = w.word AND place = 1),
 up(word, root, further) AS (SELECT word, coalesce(form, word), form IS NOT NULL FROM f UNION ALL
 SELECT up.word, coalesce(f.form, f.word), f.form IS NOT NULL FROM up JOIN f ON f.word = up.root WHERE further)
 SELECT f.word, form, root, n, n_near, form_n FROM f JOIN up ON up.word = f.word AND NOT further""")
def op11_spelling(spark, folder):
    return spelling_grams.variants(table(spark, folder, "documents"))
