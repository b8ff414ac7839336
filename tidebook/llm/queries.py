"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import (
    byte_pairs,
    centroids,
    importance,
    licences,
    line_dedup,
    minhash,
    packing,
    personal_data,
    quality_rules,
    spelling,
    subwords,
    toxicity,
    vector_dedup,
)
from tidebook.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.encoded_and_checked(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.digest(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pack": op2_pack,
    "op3_license": op3_license,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_minhash": op8_minhash,
    "op9_pii": op9_pii,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_centroids": op11_centroids,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_spelling": op13_spelling,
}


def _centroid_sql(rounds: int = 3) -> str:
    """Vectors and centroids with one row per component; every round is an assignment and a mean."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        assigned{r} AS MATERIALIZED (
            SELECT k, min(c) AS c, min(d) AS d FROM (
                SELECT k, c, d, min(d) OVER (PARTITION BY k) AS least FROM (
                    SELECT p.k, z.c, sum((p.x - z.x) * (p.x - z.x))::BIGINT AS d
                    FROM parts p JOIN centroids{r} z ON p.i = z.i GROUP BY p.k, z.c
                )
            ) WHERE d = least GROUP BY k
        )""")
        if r < rounds:
            steps.append(f"""
        centroids{r + 1} AS MATERIALIZED (
            SELECT z.c, z.i, coalesce(m.x, z.x) AS x FROM centroids{r} z LEFT JOIN (
                SELECT c, i, (s - ((s % n) + n) % n) // n AS x
                FROM (SELECT a.c, p.i, sum(p.x)::BIGINT AS s, count(*)::BIGINT AS n
                    FROM assigned{r} a JOIN parts p ON a.k = p.k GROUP BY a.c, p.i)
            ) m ON m.c = z.c AND m.i = z.i
        )""")
    return f"""
        WITH points AS MATERIALIZED (
            SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND list_count(embedding) = 64
                AND len(list_filter(embedding, lambda e: NOT isfinite(e))) = 0
        ), parts AS MATERIALIZED (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM points),
        centroids0 AS MATERIALIZED (
            SELECT s.c, p.i, p.x FROM (
                SELECT k, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c
                FROM points WHERE vec_id IS NOT NULL QUALIFY c < 16
            ) s JOIN parts p ON s.k = p.k
        ), {",".join(steps)},
        named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM centroids{rounds} GROUP BY c)
        SELECT p.vec_id, a.c::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
            sum(a.d) OVER ()::BIGINT AS inertia, n.sha AS centroid_sha256
        FROM points p JOIN assigned{rounds} a ON p.k = a.k JOIN named n ON n.c = a.c
    """


ORACLES = {
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, coalesce(source, '') AS site, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS bare
            FROM (
                SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS pos
                FROM documents WHERE text IS NOT NULL
            )
        ), widespread AS (
            SELECT bare, min(doc_id) AS keeper FROM lines WHERE bare <> ''
            GROUP BY bare HAVING count(DISTINCT site) >= 10
        ), marked AS (
            SELECT l.*, w.bare IS NOT NULL AS gone
            FROM lines l LEFT JOIN widespread w ON l.bare = w.bare AND l.doc_id <> w.keeper
        ), cleaned AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(c.n_lines, 0)::INT AS n_lines, coalesce(c.n_removed, 0)::INT AS n_removed, c.text
        FROM documents d LEFT JOIN cleaned c USING (doc_id)
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
                CASE WHEN vec_id IS NULL OR label IS NULL OR embedding IS NULL OR len(embedding) = 0 THEN false
                    WHEN list_count(embedding) < len(embedding) THEN false
                    WHEN NOT isfinite(list_sum(CAST(embedding AS DOUBLE[]))) THEN false
                    ELSE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 END AS usable
            FROM embeddings
        ), normed AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM vectors WHERE usable),
        links AS (
            SELECT a.k AS x, b.k AS y, a.vec_id AS of_x, b.vec_id AS of_y
            FROM normed a JOIN normed b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ), reach AS (
            SELECT k AS x, k AS y FROM vectors UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), counted AS (SELECT x, count(*) AS n FROM links GROUP BY x),
        named AS (SELECT r.x, min(v.vec_id) AS component FROM reach r JOIN vectors v ON r.y = v.k GROUP BY r.x)
        SELECT v.vec_id, coalesce(c.n, 0) AS n_links, n.component AS component_id,
            coalesce(v.vec_id = n.component, true) AS kept
        FROM vectors v JOIN named n ON n.x = v.k LEFT JOIN counted c ON c.x = v.k
    """,
    "op8_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        sized AS (SELECT * FROM shingles JOIN sizes USING (doc_id)),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id
            WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), named AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component AS component_id, d.doc_id = c.component AS kept
        FROM documents d JOIN named c ON c.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
    "op11_centroids": _centroid_sql(),
    "op13_spelling": """
        WITH RECURSIVE runs AS (
            SELECT id, run, count(*) AS c FROM (
                SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(
                    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                FROM documents WHERE text IS NOT NULL
            ) WHERE length(run) >= 6 GROUP BY id, run
        ), halves AS (  -- half bytes of the text to hash, the lower half of each byte first
            SELECT *, list_transform(string_split(regexp_replace(hex(encode(id || ':' || run)), '(.)(.)', '\\2\\1', 'g'), ''),
                lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT) AS h
            FROM runs
        ), hashed AS (  -- crc32 by half bytes; the list is its table
            SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, h), lambda a, x: xor(a >> 4, [0, 498536548,
                997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
                3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, x) & 15) + 1]))) AS h
            FROM halves
        ), words AS MATERIALIZED (
            SELECT word, sum(c)::BIGINT AS n FROM (
                SELECT c, CASE WHEN h % 199 = 0
                    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
                FROM hashed
            ) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
        ), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        cuts AS MATERIALIZED (
            SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM places
        ), pairs AS MATERIALIZED (
            SELECT a.word AS a, b.word AS b, b.n AS n
            FROM cuts a JOIN cuts b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.l || c.r
            UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.l || c.r
        ), near AS (
            SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM pairs GROUP BY a
        ), found AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.form_n >= 5 * w.n THEN m.form END AS form,
                CASE WHEN m.form_n >= 5 * w.n THEN m.form_n END AS form_n
            FROM words w LEFT JOIN near m ON m.a = w.word
        ), steps AS (
            SELECT word, word AS here, 0 AS depth FROM found
            UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN found f ON f.word = s.here WHERE f.form IS NOT NULL
        ), ends AS (SELECT word, arg_max(here, depth) AS root FROM steps GROUP BY word)
        SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM found f JOIN ends l ON l.word = f.word
    """,
}
