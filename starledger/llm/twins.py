"""DuckDB SQL for the text queries that SQL can express, with its own parameters."""

from __future__ import annotations

# --- fixed values: as in the contracts of the queries ---------------------------

CLASSES = """
    len(regexp_extract_all(t, '[aeiouy]')),
    len(regexp_extract_all(t, '[b-df-hj-np-tv-xz]')),
    len(regexp_extract_all(t, '\\p{Ll}')) - len(regexp_extract_all(t, '[a-z]')),
    len(regexp_extract_all(t, '\\p{Lu}')),
    len(regexp_extract_all(t, '\\p{L}')) - len(regexp_extract_all(t, '\\p{Lu}'))
        - len(regexp_extract_all(t, '\\p{Ll}')),
    len(regexp_extract_all(t, '\\p{N}')),
    len(regexp_extract_all(t, '[.,;:!?''"()-]')),
    len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]'))
"""
COMMON = (
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "the of and to in is that for it was with as be on by this are from at or "
    "de la que el en y a los se del las un por con no una para es al lo "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec"
)
LAST_WORD_BIN = len(set(COMMON.split()))  # counts the words that are not listed

NGRAM_JACCARD = """
WITH RECURSIVE worded AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        END) AS s FROM worded)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
    ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id
FROM sizes s JOIN reached r USING (doc_id) GROUP BY 1, 2
"""

DIVERGENCE_RULES = f"""
WITH texts AS (
    SELECT doc_id, lang, coalesce(text, '') AS t FROM documents
), split AS MATERIALIZED (
    SELECT doc_id, lang, t,
        regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
        list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'),
            lambda x: list_contains(string_split('{COMMON}', ' '), x)) AS common
    FROM texts
), windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 6)) AS pos,
        unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS win
    FROM split WHERE len(w) >= 8
), repeated AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
    FROM repeated, range(8) AS r(k) GROUP BY doc_id
), metrics AS MATERIALIZED (
    SELECT s.doc_id, lang, len(t) AS n_chars, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        [{CLASSES}] AS classes,
        list_transform(
            list_sort(list_distinct(string_split('{COMMON}', ' '))),
            lambda c: len(list_filter(common, lambda x: x = c))) AS commons
    FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id
), judged AS MATERIALIZED (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        n_words >= 50 AND n_chars >= 250 AS long_enough FROM metrics
), bins AS MATERIALIZED (
    SELECT doc_id, lang, base_failed, kind, unnest(range(len(h))) AS bin, unnest(h) AS c FROM (
        SELECT doc_id, lang, base_failed, 'class' AS kind,
            list_append(classes, greatest(n_chars - list_sum(classes), 0)) AS h FROM judged
        UNION ALL
        SELECT doc_id, lang, base_failed, 'word',
            list_append(commons, greatest(n_words - list_sum(commons), 0)) FROM judged)
), own AS MATERIALIZED (
    SELECT *, c / greatest(sum(c) OVER (PARTITION BY doc_id, kind), 1) AS p FROM bins
), first_shares AS MATERIALIZED (
    SELECT lang, kind, bin, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q
    FROM bins WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang, kind, bin
), first_distances AS MATERIALIZED (
    SELECT doc_id, lang, max(d) FILTER (kind = 'class') AS class_d,
        max(d) FILTER (kind = 'word' AND lang IN (SELECT s.lang FROM first_shares s
            WHERE s.kind = 'word' AND s.bin = {LAST_WORD_BIN} AND 1 - s.q >= 0.05)) AS word_d
    FROM (
        SELECT doc_id, kind, lang, round(sqrt(greatest(sum(
            (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
             + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 6) AS d
        FROM (SELECT doc_id, kind, bin, p FROM own) JOIN first_shares USING (kind, bin)
        GROUP BY doc_id, kind, lang)
    GROUP BY doc_id, lang
), near AS (
    SELECT j.doc_id FROM judged j WHERE NOT base_failed AND (NOT long_enough OR EXISTS (
        SELECT 1 FROM first_distances f
        WHERE f.doc_id = j.doc_id AND f.class_d <= 0.18 AND coalesce(f.word_d, 0) <= 0.4))
), shares AS MATERIALIZED (
    SELECT lang, kind, bin, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q
    FROM bins JOIN near USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang, kind, bin
), distances AS MATERIALIZED (
    SELECT doc_id, lang, max(d) FILTER (kind = 'class') AS class_d,
        max(d) FILTER (kind = 'word' AND lang IN (SELECT s.lang FROM shares s
            WHERE s.kind = 'word' AND s.bin = {LAST_WORD_BIN} AND 1 - s.q >= 0.05)) AS word_d
    FROM (
        SELECT doc_id, kind, lang, round(sqrt(greatest(sum(
            (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
             + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 6) AS d
        FROM (SELECT doc_id, kind, bin, p FROM own) JOIN shares USING (kind, bin)
        GROUP BY doc_id, kind, lang)
    GROUP BY doc_id, lang
), nearest AS (
    SELECT doc_id, class_d, word_d, class_d <= 0.18 AND coalesce(word_d, 0) <= 0.4 AS is_near
    FROM distances QUALIFY row_number() OVER (PARTITION BY doc_id
        ORDER BY greatest(class_d / 0.18, coalesce(word_d / 0.4, 0)), lang) = 1
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_d AS class_distance, word_d AS word_distance,
    NOT base_failed AND (NOT long_enough OR is_near) AS kept
FROM judged j JOIN nearest n ON n.doc_id = j.doc_id
"""

SPACED_SEEDS = """
WITH masks AS (
    SELECT unnest(['11001111', '11101011']) AS mask
), docs AS (
    SELECT DISTINCT doc_id, list_filter(
        regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
), items AS (
    SELECT DISTINCT item_id, list_filter(
        regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark
), doc_seeds AS (
    SELECT doc_id, w, pos, mask || ':' || array_to_string(list_transform(
        list_filter(range(1, 9), lambda i: mask[i] = '1'), lambda i: w[pos + i]), ' ') AS seed
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS pos FROM docs WHERE len(w) >= 8), masks
), item_seeds AS (
    SELECT item_id, w AS v, pos AS item_pos, mask || ':' || array_to_string(list_transform(
        list_filter(range(1, 9), lambda i: mask[i] = '1'), lambda i: w[pos + i]), ' ') AS seed
    FROM (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS pos FROM items WHERE len(w) >= 8), masks
), hits AS (
    SELECT doc_id, item_id, w, v, pos - item_pos AS shift, min(pos) AS first_pos
    FROM doc_seeds JOIN item_seeds USING (seed) GROUP BY ALL
), aligned AS (
    SELECT *, list_transform(
        range(greatest(0, -shift), least(len(v), len(w) - shift)),
        lambda j: CASE WHEN v[j + 1] = w[j + shift + 1] THEN 1 ELSE 0 END) AS same
    FROM hits
), best AS (
    SELECT *, list_max(list_transform(
        range(1, len(same) - least(13, len(same)) + 2),
        lambda i: list_sum(same[i:i + least(13, len(same)) - 1]))) AS equal
    FROM aligned
)
SELECT doc_id, item_id, CAST(max(equal) AS BIGINT) AS equal_words,
    CAST(min(first_pos) AS BIGINT) AS first_word
FROM best
WHERE equal >= CASE WHEN len(v) >= 13 THEN 11 WHEN len(v) >= 10 THEN len(v) - 1 ELSE len(v) END
GROUP BY doc_id, item_id
"""

LINE_EDIT_JOIN = """
WITH lines AS MATERIALIZED (
    SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS raw
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), firsts AS MATERIALIZED (
    SELECT trim(raw) AS line, length(trim(raw)) AS size,
        min({'d': doc_id, 'n': line_no}) AS first, row_number() OVER (ORDER BY first) AS place
    FROM lines WHERE length(trim(raw)) >= 30 GROUP BY trim(raw)
), aimed AS (
    SELECT *, unnest(range(size - 2, size + 3)) AS aim FROM firsts
), near AS (
    SELECT DISTINCT a.line FROM aimed a JOIN firsts b ON b.size = a.aim AND b.place < a.place
    WHERE (  -- two edits leave one third of a line as it was
        starts_with(b.line, substr(a.line, 1, a.size // 3))
        OR contains(b.line, substr(a.line, 1 + a.size // 3, a.size // 3))
        OR ends_with(b.line, substr(a.line, 1 + 2 * (a.size // 3)))
    ) AND levenshtein(a.line, b.line) <= 2
), marked AS (
    SELECT l.doc_id, l.line_no, l.raw,
        f.line IS NOT NULL AND (n.line IS NOT NULL OR {'d': l.doc_id, 'n': l.line_no} <> f.first) AS gone
    FROM lines l LEFT JOIN firsts f ON f.line = trim(l.raw) LEFT JOIN near n ON n.line = f.line
)
SELECT d.doc_id,
    CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(raw, chr(10) ORDER BY line_no)
        FILTER (WHERE NOT gone), '') END AS text,
    count(m.line_no) AS n_lines,
    CAST(count_if(gone) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
"""

WARC_NORMALISER = """
WITH paged AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
), keepers AS (
    SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM paged
)
SELECT
    page_id,
    CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    list_aggregate(
        list_transform(
            range(0, 32),
            lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(
                    (CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT)
                     // [32768, 1024, 32, 1][i % 4 + 1]) % 32 AS INT
                ) + 1,
                1
            )
        ),
        'string_agg', ''
    ) AS payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM keepers
"""


def _laesa_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks of all rounds one after the other; every part against every entry of its codebook."""
    steps = [
        """kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""pieces AS MATERIALIZED (
    SELECT vec_id, part, x[1 + part * len(x) // {parts} : (part + 1) * len(x) // {parts}] AS p
    FROM kept, range({parts}) AS r(part)
)""",
        f"""book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM pieces
    QUALIFY entry < {entries}
)""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""found{k} AS MATERIALIZED (
    SELECT vec_id, part, any_value(p) AS p, min({{'d': d, 'e': entry}}) AS best FROM (
        SELECT vec_id, part, p, entry, list_sum(list_transform(
            range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i]))) AS d
        FROM pieces JOIN book{k} USING (part))
    GROUP BY vec_id, part
)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
        SELECT part, entry, list(q ORDER BY i) AS m FROM (
            SELECT part, best.e AS entry, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*))
                // count(*) AS BIGINT) AS q
            FROM (SELECT part, best, unnest(range(len(p))) AS i, unnest(p) AS v FROM found{k})
            GROUP BY part, best.e, i)
        GROUP BY part, entry) USING (part, entry)
)"""
            )
    return "WITH " + ", ".join(steps) + f"""
, codes AS MATERIALIZED (
    SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code,
        CAST(sum(best.d) AS BIGINT) AS error
    FROM found{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds})
        AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""


LAESA_CODES = _laesa_codes()

CRC_RESAMPLING = """
WITH RECURSIVE steps AS (
    SELECT b, b AS c, 0 AS k FROM range(256) AS r(b)
    UNION ALL
    SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k + 1
    FROM steps WHERE k < 8
), crc_table AS MATERIALIZED (
    SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
), texts AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents
    UNION ALL SELECT 't', row_number() OVER (), text FROM benchmark
), worded AS MATERIALIZED (
    SELECT side, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM texts
), features AS MATERIALIZED (
    SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
    FROM worded
), folded AS MATERIALIZED (
    SELECT side, id, f, count(*) AS n FROM features GROUP BY side, id, f
), spelled AS MATERIALIZED (
    SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM folded)
), bucketed AS MATERIALIZED (
    SELECT f, xor(list_reduce(
        list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8),
        CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
    FROM spelled, crc_table
), counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
    FROM folded JOIN bucketed USING (f) GROUP BY bucket
), sums AS (
    SELECT coalesce(sum(s), 0) + 10000 AS all_s, coalesce(sum(t), 0) + 10000 AS all_t FROM counts
), gain AS MATERIALIZED (
    SELECT bucket, CAST(floor(1000 * ln(
        CAST((t + 1) * all_s AS DOUBLE) / CAST((s + 1) * all_t AS DOUBLE))) AS BIGINT) AS g
    FROM counts, sums
), weights AS (
    SELECT id, sum(n) AS n, sum(n * g) AS total
    FROM folded JOIN bucketed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS MATERIALIZED (
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
        CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
            / 4294967296::DOUBLE))) AS BIGINT) AS noise
    FROM documents d LEFT JOIN weights ON id = d.doc_id
), drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank
    FROM scored WHERE n_features >= 39
    QUALIFY rank <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_features >= 39)
)
SELECT doc_id, n_features, weight, weight + noise AS score, CAST(rank AS BIGINT) AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""
