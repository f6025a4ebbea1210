"""SQL with the same rows as the queries here that SQL can express on whole tables."""

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

OP2 = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (doc_id, g)) GROUP BY 1),
lines AS (SELECT doc_id, source, line, len(string_split(line, ' ')) AS n FROM (SELECT doc_id, source, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)))) AS line FROM d) WHERE line <> ''),
hosts AS (SELECT source, count(*) AS c FROM documents GROUP BY 1),
over AS (SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, c HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.1 * c),
gone AS (SELECT doc_id, sum(n)::BIGINT AS n FROM lines l JOIN over o ON l.line = o.line AND l.source IS NOT DISTINCT FROM o.source GROUP BY 1),
counts AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(again.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed FROM d LEFT JOIN again ON again.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept, n_removed FROM counts"""

OP8 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, to_id) AS (SELECT a, b FROM sides UNION SELECT id, b FROM reach JOIN sides ON to_id = a),
part AS (SELECT id, min(to_id) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN part ON id = d.doc_id"""

OP9 = rf"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM d GROUP BY 1),
capped AS (SELECT *, ((s - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap, 3 * source_size::DOUBLE / ((s - 1) % 3 + 1) AS bind, sum(source_size) OVER ()::BIGINT AS total FROM own),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY bind, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY bind, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM capped),
final AS (SELECT arg_min(level, bind) AS lv FROM levels WHERE bind >= level),
t AS (SELECT source, s, source_size, total, greatest(16, least(2048, total // 1048576)) AS b, coalesce(least(cap, weight * lv), cap) AS target FROM levels, final),
share AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY s), 0) AS lo, CASE WHEN lead(s) OVER (ORDER BY s) IS NULL THEN 2 ELSE hi END AS top FROM (SELECT *, sum(target) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) / total AS hi FROM t)),
slots AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(0, (SELECT max((total + b - 1) // b) FROM t))) AS i)),
ranked AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS r, (source_size + b - 1) // b AS blocks FROM slots JOIN share ON u >= lo AND u < top),
times AS (SELECT s, r % blocks AS block, count(*) AS n FROM ranked WHERE r // blocks < 3 GROUP BY 1, 2),
h AS (SELECT d.*, t.s, t.source_size, t.target, t.b, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS o FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY ('0x' || o[1:8])::BIGINT % 4096, o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h),
pieces AS (SELECT *, least(start + size, (block + 1) * b) - greatest(start, block * b) AS part FROM (SELECT *, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM placed WHERE size > 0)),
taken AS (SELECT doc_id, p.s, start, sum(part * coalesce(n, 0))::BIGINT AS taken FROM pieces p LEFT JOIN times ON times.s = p.s AND times.block = p.block GROUP BY 1, 2, 3)
SELECT placed.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken ON placed.doc_id = taken.doc_id AND placed.s = taken.s AND placed.start = taken.start AND size > 0"""

OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
reach(id, to_id) AS (SELECT a, b FROM links UNION SELECT id, b FROM reach JOIN links ON to_id = a),
part AS (SELECT id, min(to_id) AS m FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN part ON id = vec_id"""

SQL = {"op2_line_frequency": OP2, "op8_chosen_paths": OP8, "op9_source_mix": OP9, "op10_cap_filters": OP10}
