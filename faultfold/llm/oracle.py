"""SQL counterparts of the registered queries, where SQL can express them.

The other operators hash with functions that SQL lacks (2, 9, 10), learn (6), take eigenvectors (11), or
follow tokenizer tables and templates (4, 7); their tests hold them against brute force.
"""

from __future__ import annotations

#: A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
    FROM pages
),
letters AS (
    SELECT *, [('0x' || substr(hex, 5 * g + 1, 5))::BIGINT FOR g IN range(8)] AS parts FROM payloads
)
SELECT page_id,
       strlen(payload)::BIGINT AS payload_bytes,
       array_to_string([
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)
           FOR v IN parts], '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM letters
"""

OP3 = f"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
),
windows AS (
    SELECT doc_id, j, md5(array_to_string(words[j : j + 49], ' ')) AS key
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS j FROM texts WHERE len(words) >= 50)
),
later AS (
    SELECT doc_id, j
    FROM (SELECT doc_id, j, min(doc_id) OVER (PARTITION BY key) AS first FROM windows)
    WHERE first < doc_id
),
placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
),
judged AS (
    SELECT p.doc_id, p.i, p.word,
           max(CASE WHEN l.j IS NULL THEN 0 ELSE 1 END) OVER (
               PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW
           ) AS gone
    FROM placed p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.j = p.i
),
kept AS (
    SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS rest
    FROM judged GROUP BY doc_id
)
SELECT t.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

OP5 = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
    FROM documents
),
placed AS (
    SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM texts
),
threes AS (
    SELECT doc_id, i, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
counted AS (
    SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice FROM threes
),
covered AS (
    SELECT doc_id, max(twice::INT) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again
    FROM counted
),
repeats AS (SELECT doc_id, sum(again) AS n_repeat_words FROM covered GROUP BY doc_id),
split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM texts
),
lines AS (
    SELECT doc_id, line, own, len(own) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS seen
    FROM (SELECT *, regexp_extract_all(line, '{WORD}') AS own FROM split)
    WHERE len(own) > 0
),
failed AS (
    SELECT doc_id, seen, length(array_to_string(own, '')) AS chars,
           (seen AND n > 3)
           OR len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.25 * n + 1
           OR len([w FOR w IN own IF w LIKE '%!!']) > 0.5 * n
           OR (n <= 40 AND len([w FOR w IN own IF regexp_full_match(w, '[|»>›•·/]+')]) >= 2)
           OR (n >= 12 AND len([w FOR w IN own IF regexp_matches(w, '[.!?:;…。！？؟।]["''”’»)\]]*$')]) = 0)
           OR (n <= 40 AND regexp_matches(line, '(?i)(?:^|[^\pL\pN_])(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|click here|read more|sign up|log ?in|subscribe|lorem ipsum|skip to (?:main )?content|share (?:this|on))(?:[^\pL\pN_]|$)'))
           AS fails
    FROM lines
),
by_lines AS (
    SELECT doc_id, count(*) FILTER (seen) AS n_dup_lines, sum(chars) AS word_chars,
           coalesce(sum(chars) FILTER (fails), 0) AS lost
    FROM failed GROUP BY doc_id
),
base AS (
    SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(l.word_chars, 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
           coalesce(l.lost, 0)::DOUBLE AS lost
    FROM texts t
    LEFT JOIN by_lines l ON l.doc_id = t.doc_id
    LEFT JOIN repeats r ON r.doc_id = t.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND (word_chars = 0 OR lost / word_chars <= 0.3) AS kept
FROM base
"""

OP8 = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM sized GROUP BY source
),
filling AS (
    SELECT source, source_size, weight, source_size * 2.0::DOUBLE AS cap,
           (SELECT sum(source_size)::DOUBLE FROM totals) * 1.5::DOUBLE AS mix,
           row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS place
    FROM totals
),
levels AS (
    SELECT a.source, a.cap, a.weight, a.source_size, a.place,
           (a.mix - coalesce((SELECT sum(b.cap) FROM filling b WHERE b.place < a.place), 0.0::DOUBLE))
           / (SELECT sum(b.weight) FROM filling b WHERE b.place >= a.place) AS level
    FROM filling a
),
fixed AS (SELECT level FROM levels WHERE level * weight < cap ORDER BY place LIMIT 1),
targets AS (
    SELECT source, source_size, coalesce(least((SELECT level FROM fixed) * weight, cap), cap) AS target,
           ('0x' || substr(md5('17/' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 5))::BIGINT
           / 1048576.0::DOUBLE AS start
    FROM levels
),
cells AS (
    SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
              % (count(*) OVER (PARTITION BY source, size) // 1000 + 1) AS cell
    FROM sized
),
steps AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, cell, doc_id NULLS LAST) AS step FROM cells
),
rated AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, s.step, t.start,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
    FROM steps s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(step * rate + start) - floor((step - 1) * rate + start), 2) * size)::BIGINT AS taken
FROM rated
"""


#: A maximal run of letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '{TERM}')"


OP12 = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS terms FROM documents),
live AS (SELECT r, doc_id, terms, len(terms) AS n FROM texts WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big, sum(n)::BIGINT AS total FROM live),
counted AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM live) GROUP BY r, term
),
frequency AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
asked AS (SELECT DISTINCT item_id, text FROM benchmark),
wanted AS (SELECT item_id, text, unnest({_terms('text')}) AS term FROM asked),
weighed AS (
    SELECT w.item_id, w.text, w.term, count(*) AS times,
           floor(1000 * ln((2 * any_value(big) + 2)::DOUBLE / (2 * any_value(f.df) + 1)))::BIGINT AS w
    FROM wanted w JOIN frequency f ON f.term = w.term CROSS JOIN totals GROUP BY w.item_id, w.text, w.term
),
scored AS (
    SELECT g.item_id, g.text, l.doc_id, l.r,
           sum(g.times * g.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * l.n * t.big) // t.total))))::BIGINT AS score
    FROM weighed g JOIN counted c ON c.term = g.term JOIN live l ON l.r = c.r CROSS JOIN totals t
    GROUP BY g.item_id, g.text, l.doc_id, l.r
),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: All pairs; the small tables lie in one cell, where the operator loses none.
OP13 = """
WITH RECURSIVE fine AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM fine
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT DISTINCT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""


def statements() -> dict[str, str]:
    return {
        "op1_warc_chain": OP1,
        "op3_phrase_automata": OP3,
        "op5_line_quality": OP5,
        "op8_systematic_mix": OP8,
        "op12_bloom_search": OP12,
        "op13_multi_index": OP13,
    }
