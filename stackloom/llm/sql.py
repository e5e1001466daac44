"""DuckDB SQL of the queries that SQL can express over whole tables."""

WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("coalesce(" + LOWER.format("text") + ", '')")} AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

_FAILS = """(
  (len(b) - len(translate(b, '#*$%&|<>', '')) >= 3 AND (len(b) - len(translate(b, '#*$%&|<>', ''))) * 20 > len(b))
  OR (len(b) - len(replace(b, '|', '')) >= 2 AND (len(b) - len(replace(b, '|', ''))) * 25 > len(b))
  OR (len(b) >= 20 AND upper(b) = b AND lower(b) <> b)
  OR (len(b) >= 20 AND right(b, 1) NOT IN ('.', '!', '?', ':', ';', ',', '"', '''', ')', ']', '}}', '…', '。', '»', '”', '’') AND NOT contains(b, '. ') AND NOT contains(b, '! ') AND NOT contains(b, '? '))
  OR (regexp_matches(lower(b), '{0}') AND (len(lower(b)) - len(regexp_replace(lower(b), '{0}', '', 'g'))) * 12 >= len(lower(b))))""".format(
    r"\b(all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|subscribe to our|sign up for|click here to|enable javascript|skip to (main )?content"
    "|alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutzerklärung|cookies akzeptieren|newsletter abonnieren|hier klicken|zum inhalt springen"
    "|tous droits réservés|sous licence|conditions d.utilisation|politique de confidentialité|accepter (tous )?les cookies|abonnez-vous|cliquez ici|aller au contenu"
    "|todos los derechos reservados|bajo la licencia|condiciones de uso|política de privacidad|aceptar (todas )?las cookies|suscríbete|haz clic aquí|saltar al contenido)"
)

OP5 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), lf AS (
  SELECT doc_id, line, {_FAILS} AS fails, b FROM (SELECT *, trim(line, E' \t\n\x0b\x0c\r') AS b FROM l)
), ls AS (
  SELECT doc_id, count(*) FILTER (b <> '') - count(DISTINCT line) FILTER (b <> '') AS dup, sum(len(line)) AS chars, coalesce(sum(len(line)) FILTER (NOT fails), 0) AS kept FROM lf GROUP BY doc_id
), facts AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
    (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, ls.dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, ls.chars, ls.kept
  FROM w JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept * 100 >= chars * 60 AS kept
FROM (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM facts)
"""

OP7 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format("coalesce(" + LOWER.format("text") + ", '')")} AS ws FROM documents
), m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS size, len(list_filter(range(1, len(ws) + 1), lambda i: i = 1 OR ws[i] <> ws[i - 1])) AS fresh,
    strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters, strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM w
), k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) * 64.0
    / greatest(1, (64 * fresh // greatest(size, 1)) * letters // greatest(chars, 1)) AS key FROM m
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, sum(size)::DOUBLE * 2 AS cap FROM k GROUP BY source
), l AS (
  SELECT *, cap / weight AS fill, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM s WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT arg_min(level, fill) AS level, min(fill) AS fill FROM l WHERE level * weight < cap
), p AS (
  SELECT source, source_size, CASE WHEN l.fill >= o.fill THEN least(o.level * weight, cap) ELSE cap END AS target FROM l LEFT JOIN o ON true
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs, target - epochs * source_size AS rest FROM p
), r AS (
  SELECT k.*, source_size, target, epochs, rest, row_number() OVER o AS rn, sum(size) OVER o - rest AS over
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source WINDOW o AS (PARTITION BY k.source ORDER BY size = 0, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), c AS (
  SELECT source, max(rn) AS last FROM r WHERE size > 0 AND rest > 0 AND (over <= 0 OR over <= size - over) GROUP BY source
)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (epochs + CASE WHEN rn <= last THEN 1 ELSE 0 END) * size END::BIGINT AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""

OP10 = rf"""
WITH l AS (
  SELECT doc_id, unnest(list_zip(range(1, len(ls) + 1), ls)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, z[1] AS i, z[2] AS line, {LOWER.format("trim(z[2], E' \t\n\x0b\x0c\r')")} AS key FROM l
), bad AS (
  SELECT key, max(doc_id) AS last FROM k WHERE len(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.*, bad.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN bad ON k.key = bad.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP6 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> s) & 31) + 1)::INTEGER, 1)), '')), '') AS payload_digest FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""

#: The whole dialogue is rendered, and masked, first; parts of 64 turns are then cut out of it by character.
OP2 = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS rn FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), j AS (
  SELECT t.*, speaker, '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, (sum(len(head) + len(body)) OVER w - len(body))::BIGINT AS a, a + len(body) - 1 AS b FROM j WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY rn)
), whole AS (
  SELECT conv_id, speaker, string_agg(head || body, '' ORDER BY rn) AS rendered FROM o GROUP BY ALL
), cut AS (
  SELECT conv_id, speaker, ((rn - 1) // 64)::BIGINT AS part, count(*)::BIGINT AS n_turns, min(a - len(head)) AS start, max(b + 1) AS stop,
    coalesce(sum(b - a) FILTER (role = speaker), 0)::BIGINT AS n_target_chars, coalesce(string_agg(a || '-' || b, ',' ORDER BY rn) FILTER (role = speaker), '') AS mask FROM o GROUP BY ALL
)
SELECT cut.conv_id, cut.speaker, part, start::BIGINT AS start, n_turns, n_target_chars, substr(rendered, (start + 1)::BIGINT, (stop - start)::BIGINT) AS rendered, mask
FROM cut JOIN whole ON cut.conv_id IS NOT DISTINCT FROM whole.conv_id AND cut.speaker = whole.speaker
"""

OP8 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), h AS (
  SELECT r, unnest(list_transform(range(1, octet_length(b) - 198), lambda i: {'i': i, 'h': md5_number(b[i:i+199])}), recursive := true) FROM d
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1
), runs AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM twice)
), spans AS (
  SELECT r, min(i) AS a, max(i) + 199 AS z FROM runs GROUP BY r, run
), cuts AS (
  SELECT r, a, z FROM spans UNION ALL SELECT r, octet_length(b) + 1, NULL FROM d
), pieces AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a) + 1, 1) AS since FROM cuts
), kept AS (
  SELECT r, coalesce(sum(z - a + 1), 0)::BIGINT AS n_removed, count(z)::BIGINT AS n_spans, string_agg(CASE WHEN a > since THEN hex(b[since:a - 1]) ELSE '' END, '' ORDER BY a) AS rest FROM pieces JOIN d USING (r) GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM d JOIN kept USING (r)
"""


def _kmeans(k: int, rounds: int, dims: int) -> str:
    """Rounds written out one after the other; d0, d1, ... hold each vector's nearest centroid, c1, c2, ... the moved centroids."""
    nearest = "SELECT r, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT v.r, c.c, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.v[i] - c.z[i]) * (v.v[i] - c.z[i])))::BIGINT AS far FROM v CROSS JOIN c{n} c) GROUP BY r"
    moved = (
        "SELECT c.c, coalesce(m.z, c.z) AS z FROM c{n} c LEFT JOIN (SELECT c, list(z ORDER BY i) AS z FROM (SELECT d.c, i, (sum(v.v[i])::HUGEINT - CASE WHEN sum(v.v[i])::HUGEINT % count(*) < 0 THEN count(*) ELSE 0 END) // count(*) AS z"
        " FROM d{n} d JOIN v USING (r), range(1, {dims} + 1) AS t(i) GROUP BY d.c, i) GROUP BY c) m USING (c)"
    )
    steps = "".join(f", d{n} AS MATERIALIZED ({nearest.format(n=n, dims=dims)}), c{n + 1} AS MATERIALIZED ({moved.format(n=n, dims=dims)})" for n in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS z FROM v QUALIFY c < {k}
){steps}, last AS MATERIALIZED ({nearest.format(n=rounds, dims=dims)}), inertias AS (
  SELECT c, sum(far)::BIGINT AS cluster_inertia, sum(sum(far)) OVER ()::BIGINT AS inertia FROM last GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, far AS distance, cluster_inertia, inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN inertias USING (c) JOIN c{rounds} USING (c)
"""


OP11 = _kmeans(40, 5, 64)


OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM (SELECT lang, words, array_to_string(ws[i:i + words - 1], ' ') AS phrase FROM (SELECT lang, ws, words, unnest(range(1, len(ws) - words + 2)) AS i FROM w, range(1, 5) AS t(words))) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 30
), longer AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, size, a, unnest(range(1, words - size + 2)) AS i FROM candidates, range(2, 4) AS t(size) WHERE size < words) GROUP BY ALL
), free AS (
  SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM free)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.words = k JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000::HUGEINT * a) // (x.f + y.f), k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM scored JOIN n USING (lang) QUALIFY rank <= 2000
"""
