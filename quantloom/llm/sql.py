"""DuckDB SQL for the training-data queries that SQL can express."""

from quantloom.llm import licenses


def license_scan() -> str:
    """Normalisation and rules as chained common table expressions over the same fixed values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = "chr(10) || lower(coalesce(text, '')) || ' ' || chr(10)"
    for pattern, to in licenses.STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"
    text = f"regexp_replace({text}, '\x02[\x02 ]*', {quoted(licenses.LINE)}, 'g')"
    text = f"regexp_replace({text}, ' *\x01 *', {quoted(' ' + licenses.END)}, 'g')"
    pairs = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in licenses.identifiers().items())
    rest = "x"
    for pattern, to in licenses.REST:
        rest = f"regexp_replace({rest}, {quoted(pattern)}, {quoted(to)}, 'g')"
    steps, before = [], "r"
    for k, (name, rule) in enumerate(licenses.RULES):
        sequence = quoted(licenses.as_sequence(rule))
        found = f"CASE WHEN contains(seq, {sequence}) THEN list_append(found, {quoted(name)}) ELSE found END"
        steps.append(f"r{k} AS (SELECT doc_id, ids, replace(seq, {sequence}, '|') AS seq, {found} AS found FROM {before})")
        before = f"r{k}"
    return f"""
WITH n AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), {quoted(licenses.WORD)})
    THEN regexp_extract_all({text}, {quoted(licenses.sentence_pattern())}, 1) ELSE []::VARCHAR[] END AS found
  FROM documents
), i AS (
  SELECT doc_id, flatten(list_transform(list_transform(found, lambda x: replace(x, {quoted(licenses.LINE)}, '')), lambda x:
    CASE WHEN coalesce((MAP {{{pairs}}})[x], (MAP {{{pairs}}})[{rest}]) IS NOT NULL THEN [coalesce((MAP {{{pairs}}})[x], (MAP {{{pairs}}})[{rest}])]
    ELSE list_transform(string_split_regex(rtrim({rest}), ' (?:or|and) '), lambda y: (MAP {{{pairs}}})[y || ' ']) END)) AS ids FROM n
), r AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS seq, []::VARCHAR[] AS found FROM i
), {", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, (length(seq) - length(replace(seq, '<', '')))::BIGINT AS n_open,
       coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses
FROM {before}
"""


EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

LINE_CLEAN = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM b
), g AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
         || ' ' || lead(word, 4) OVER o AS gram
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS twice FROM g
), c AS (
  SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM (
    SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r
  ) GROUP BY doc_id
), k AS (
  SELECT doc_id, t, words, lines, list_filter(lines, lambda x: NOT (
      (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100 > length(x) * 5
      OR (NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}')
          AND regexp_matches(x, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){4}[^\x20\x09-\x0D]'))
      OR (NOT regexp_matches(x, '[.!?…:;"”»)\]][\x20\x09-\x0D]*$')
          AND NOT regexp_matches(x, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){4}[^\x20\x09-\x0D]'))
      OR regexp_matches(x, '(?:\S[\x20\x09]*[|»›·•>][\x20\x09]*){3}')
      OR (regexp_matches(lower(x), 'accept cookies|cookie policy|enable javascript|terms of use|terms of service|privacy policy|all rights reserved|sign in|log in|sign up|click here|read more|lorem ipsum|share this|subscribe to')
          AND NOT regexp_matches(x, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){30}[^\x20\x09-\x0D]'))
    )) AS good
  FROM b
), s AS (
  SELECT k.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS kept_chars,
         (len(lines) - len(good))::BIGINT AS n_lines_removed
  FROM k LEFT JOIN c ON k.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars * 100 >= word_chars * 50 AS kept,
       n_lines_removed
FROM s
"""


#: All pairs of a label by cosine, then what is reachable.
NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) AS n ON n.a = vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS r ON r.a = vec_id
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.b AS negative_id, p.score AS positive_score,
  n.score AS negative_score
FROM p JOIN s AS n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)
QUALIFY row_number() OVER w <= 10
"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds one after the other, with all distances."""
    nearest = """
      SELECT v.vec_id, v.e, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
      FROM v CROSS JOIN {c} AS c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.cluster) = 1"""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS cluster, e FROM v
      QUALIFY cluster < {k})""",
    ]
    for n in range(rounds):
        steps += [
            f"a{n} AS MATERIALIZED ({nearest.format(c=f'c{n}')})",
            f"""m{n} AS (SELECT cluster, i, sum(e[i]) AS s, count(*) AS w FROM a{n}, range(1, 65) AS r(i) GROUP BY cluster, i)""",
            f"""c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} AS c LEFT JOIN (
      SELECT cluster, list(((s - ((s % w) + w) % w) // w)::BIGINT ORDER BY i) AS e FROM m{n} GROUP BY cluster) AS m ON m.cluster = c.cluster)""",
        ]
    steps.append(f"a AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})")
    return f"""WITH {', '.join(steps)}
    SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
      (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a JOIN c{rounds} AS c ON c.cluster = a.cluster"""
