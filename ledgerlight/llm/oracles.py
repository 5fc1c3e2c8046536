"""The same results as DuckDB SQL, where SQL can express them.

Without SQL are op3 (a 64-bit hash that SQL lacks), op6, op8 (trained models) and op7 (merges of a tokenizer);
they are tested against brute force, round trips and held-out labels.
"""

from __future__ import annotations

from ledgerlight.llm.mixing import SCHEDULES, WEIGHTS

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# crc32 from its definition: the table of 256 entries by its polynomial, then one step a byte.
SHARDING = """
WITH steps AS (
  SELECT list(list_reduce([v, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crc
  FROM (SELECT CAST(range AS BIGINT) AS v FROM range(256))
), rows AS (
  SELECT doc_id, coalesce('1' || source, '2') AS stratum, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
    md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) AS INT) + 1]))) AS text_crc32
  FROM documents, steps
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM rows
), line AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2 * n), stratum, key, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // total AS INT) AS shard,
  CAST(place - ((place * 40 // total) * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM line
"""

NEAR_VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a, sound b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = a
"""

# all shortest windows of 50 words, forwards and backwards; a line goes if a window over it stood earlier
LINE_RUNS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, pos, len({WORDS.format('line')}) AS w
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs)
), summed AS (SELECT doc_id, pos, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines),
windows AS (
  SELECT doc_id, start, stop, array_to_string(lines[start + 1 : stop], chr(10)) AS content FROM (
    SELECT a.doc_id, a.pos AS start, min(b.pos) + 1 AS stop FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.w >= 50 GROUP BY ALL
    UNION
    SELECT b.doc_id, max(a.pos), b.pos + 1 FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.pos
  ) JOIN docs USING (doc_id)
), copies AS (
  SELECT doc_id, start, stop FROM (SELECT *, min((doc_id, start)) OVER (PARTITION BY content) AS first FROM windows) WHERE (doc_id, start) <> first
), gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN copies c ON l.doc_id = c.doc_id AND l.pos >= c.start AND l.pos < c.stop),
cut AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""


def time_of(share: str) -> str:
    """The inverse of the integrated schedules as SQL: the segment that the share falls into, solved for the time."""
    cases = []
    for index, knots in enumerate(SCHEDULES):
        segments = [(t0, w0, w1, t1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, begun, inner = sum(s[-1] for s in segments), 0.0, []
        starts = []
        left = whole
        for *_, area in reversed(segments):
            left -= area
            starts.append(left)
        for (t0, w0, w1, t1, _), begun in reversed(list(zip(segments, reversed(starts)))):
            rest, slope = f"({share} * {whole!r}::DOUBLE - {begun!r}::DOUBLE)", (w1 - w0) / (t1 - t0)
            time = f"{t0!r}::DOUBLE + (sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)) - {w0!r}::DOUBLE) / {slope!r}::DOUBLE" if slope else f"{t0!r}::DOUBLE + {rest} / {w0!r}::DOUBLE"
            inner.append(f"WHEN {rest} >= 0 OR {t0 == knots[0][0]} THEN {time}")
        cases.append(f"WHEN schedule = {index} THEN CASE {' '.join(inner)} END")
    return f"CASE {' '.join(cases)} END"


MIXING = f"""
WITH rows AS (
  SELECT doc_id, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, coalesce('1' || source, '2') AS stratum,
    md5('23|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), sizes AS (SELECT stratum, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY stratum),
weighed AS (SELECT *, (row_number() OVER (ORDER BY stratum) - 1) % {len(WEIGHTS)} AS schedule FROM sizes),
capped AS (SELECT *, {list(WEIGHTS)}[CAST(schedule AS INT) + 1] AS weight, 2 * source_size AS cap FROM weighed),
-- the excess is dealt again and again until no target is above its cap: the level is the one at which all caps and shares add up
levels AS (
  SELECT c.stratum, c.cap::DOUBLE / c.weight AS fills_at,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes) - coalesce(sum(o.cap) FILTER (full_before), 0)) / (coalesce(sum(o.weight) FILTER (NOT full_before), 0)) AS level
  FROM (SELECT c.*, o.*, (o.cap::DOUBLE / o.weight, o.stratum) < (c.cap::DOUBLE / c.weight, c.stratum) AS full_before FROM capped c, capped o) AS x(stratum_c, ss, sch, w, cap_c, stratum, source_size, schedule, weight, cap, full_before)
    JOIN capped c ON c.stratum = x.stratum_c JOIN capped o ON o.stratum = x.stratum
  GROUP BY c.stratum, c.cap, c.weight
), chosen AS (SELECT arg_min(level, (fills_at, stratum)) AS level FROM levels WHERE level < fills_at),
targets AS (
  SELECT c.*, CASE WHEN level IS NULL OR c.cap::DOUBLE / c.weight <= level THEN c.cap::DOUBLE ELSE c.weight * level END AS target FROM capped c, chosen
), placed AS (
  SELECT r.*, source_size, target, schedule, CAST(floor(target) AS BIGINT) AS words,
    coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM rows r JOIN targets USING (stratum)
), taken AS (
  SELECT *, greatest(0, least(size, words - begins)) AS once, greatest(0, least(size, words - source_size - begins)) AS twice FROM placed
)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken, CAST((once > 0)::INT + (twice > 0)::INT AS INT) AS copies,
  CASE WHEN once > 0 THEN {time_of('(begins::DOUBLE / target)')} END AS first_at
FROM taken
"""

PERSPECTIVES = """
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
seen AS (
  SELECT *, CASE WHEN speaker = perspective THEN '<|im_start|>assistant' WHEN speaker = 'system' THEN '<|im_start|>system'
    ELSE '<|im_start|>user name=' || speaker END || chr(10) AS head
  FROM rows JOIN people USING (conv_id)
), placed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS segment, row_number() OVER w - 1 AS place,
    coalesce(sum(length(head || said) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM seen WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, said)
)
SELECT conv_id, perspective, CAST(place AS BIGINT) AS place, turn, speaker, segment, CAST(start AS BIGINT) AS start, CAST(start + length(segment) AS BIGINT) AS stop,
  CAST(CASE WHEN speaker = perspective THEN start + length(head) END AS BIGINT) AS train_start,
  CAST(CASE WHEN speaker = perspective THEN start + length(segment) - 1 END AS BIGINT) AS train_stop
FROM placed
"""

SHINGLE_JOIN = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = d.doc_id
"""

PHRASES = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), counted AS (
  SELECT lang, phrase, k, CAST(count(*) AS HUGEINT) AS f
  FROM (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, words, k, unnest(range(1, CAST(len(words) AS BIGINT) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
  )) GROUP BY ALL HAVING count(*) >= 100
), sizes AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, n, cut, 1000 * c.f * n // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM counted WHERE k > 1) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 : c.k], ' ')
  JOIN sizes s ON s.lang = c.lang
), parts AS (
  SELECT DISTINCT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM counted WHERE k > 2))
), best AS (
  SELECT * FROM cuts WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = cuts.lang AND p.phrase = cuts.phrase AND 100 * p.f >= 100 * cuts.a)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""

# the levels of each tree as lists; a row's siblings with their sides are then folded from its leaf to the root
MERKLE = """
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([v, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crc
  FROM (SELECT CAST(range AS BIGINT) AS v FROM range(256))
), fields AS (
  SELECT doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS plain, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS added,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) AS INT) + 1]))) % 7 = 0 AS tampered
  FROM documents, steps
), leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree,
    sha256(array_to_string(list_transform(plain, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) AS leaf,
    CASE WHEN tampered THEN sha256(array_to_string(list_transform(added, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) END AS changed
  FROM fields
), ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS INT) AS pos FROM leaves),
low AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM ordered GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, CAST(len(nodes) AS BIGINT), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM low WHERE len(nodes) > 1
), tops AS (SELECT tree, nodes[1] AS subroot, CAST(row_number() OVER (ORDER BY tree) - 1 AS INT) AS place FROM low WHERE len(nodes) = 1),
high AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM tops
  UNION ALL
  SELECT level + 1, list_transform(range(0, CAST(len(nodes) AS BIGINT), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM high WHERE len(nodes) > 1
), steps_up AS (
  SELECT doc_id, leaf, changed, place, subroot, pos, tree, 0 AS part, level, nodes, (pos >> level) AS here FROM ordered JOIN tops USING (tree) JOIN low USING (tree) WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, leaf, changed, place, subroot, pos, tree, 1, level, nodes, (place >> level) FROM ordered JOIN tops USING (tree), high WHERE len(nodes) > 1
), paths AS (
  SELECT tree, pos, list(CASE WHEN here % 2 = 1 THEN '<' || nodes[here] ELSE coalesce('>' || nodes[here + 2], '.') END ORDER BY part, level) AS proof FROM steps_up GROUP BY tree, pos
), folded AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, coalesce(proof, []) AS proof,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(proof, [])), lambda acc, s: CASE s[1] WHEN '<' THEN sha256(s[2:] || acc) WHEN '>' THEN sha256(acc || s[2:]) ELSE sha256(acc) END) AS folded_root
  FROM ordered JOIN tops USING (tree) LEFT JOIN paths USING (tree, pos)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

ORACLES: dict[str, str] = {
    "op1_sharding": SHARDING,
    "op2_pstable": NEAR_VECTORS,
    "op4_line_runs": LINE_RUNS,
    "op5_mixing": MIXING,
    "op9_perspectives": PERSPECTIVES,
    "op10_shingle_join": SHINGLE_JOIN,
    "op11_phrases": PHRASES,
    "op13_merkle": MERKLE,
}
