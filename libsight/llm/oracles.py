"""SQL for the queries that SQL can state; the others are tested against brute force."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array(coalesce({{}}, ''), '{GAP}'), lambda x: x <> '')"

OP2 = f"""WITH texts AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM
  (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35) x),
repeated AS (SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS removed, count(*) FILTER (p - before <> 1 OR before IS NULL) AS repeats
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, coalesce(repeats, 0) AS n_repeats,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)"""

# control strings do not overlap, so their starts can be counted by plain matching
OP4 = r"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
  length(text) + len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>'))
  + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 13 WHEN 'assistant' THEN 8 END AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
checked AS (SELECT *, CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
  WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
  AND (n < turns OR role IN ('user', 'assistant')) AS fine FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fine) AS valid
FROM checked GROUP BY conv_id"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8 = f"""WITH RECURSIVE texts AS (SELECT doc_id, {WORDS.format(_LOWER)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM
  (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM texts) x),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

# CRC-32 by its table of bytes, once for each distinct word
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP11 = f"""WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
said AS (SELECT doc_id, 0 AS target, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) AS w FROM documents
  UNION ALL SELECT NULL, 1, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) FROM benchmark),
words AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)),
    lambda k: CAST('0x' || substr(hex(w), 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM said), crc),
counts AS (SELECT bucket, CAST(count(*) FILTER (target = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (target = 1) AS DOUBLE) AS t
  FROM said JOIN words USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM counts),
weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM said JOIN words USING (w) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""

_ALPHA = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OP12 = f"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce({_LOWER}, ''), '{_ALPHA}') AS w FROM documents),
said AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, count(*) AS c FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c) AS total FROM counts GROUP BY ALL),
rates AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(t.total, 0) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (s.total + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM rates WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10"""

_DOT = "list_inner_product({}, {})"
OP13 = f"""WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE {_DOT.format('a.v', 'b.v')} / (sqrt({_DOT.format('a.v', 'a.v')}) * sqrt({_DOT.format('b.v', 'b.v')})) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) l USING (vec_id)"""

ORACLES = {"op2_substrings": OP2, "op4_chat": OP4, "op8_jaccard_join": OP8, "op11_resample": OP11,
           "op12_divergence": OP12, "op13_vectors": OP13}
