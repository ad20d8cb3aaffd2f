"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonaril.llm.common import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.piece_viterbi import digest

    return digest(read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.chat_hmm import format_chats

    return format_chats(read(spark, sf_dir, "conversations"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.maxent import score

    return score(read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.site_tree import main_texts

    return main_texts(read(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.suffix_dedup import digest

    return digest(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.fim_dfa import digest

    return digest(read(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.recompression import digest

    return digest(read(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaril.llm.phrase_tries import top_collocations

    return top_collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_chat_format, op3_minhash_dedup, op4_maxent_scoring, op5_fingerprints, op6_topk_search, op7_html_extraction, op8_suffix_dedup, op9_language_id, op10_packing, op11_fill_in_middle, op12_substring_dedup, op13_phrases)}


#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL = {
    "op12_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             w AS (SELECT row, coalesce(doc_id, 9223372036854775807) AS id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM d),
             s AS (SELECT row, id, i, n, sha256(string_agg(word, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM w),
             v AS (SELECT * FROM s WHERE i + 50 <= n),
             m AS (SELECT h, min(id) AS m FROM v GROUP BY 1 HAVING count(*) > 1),
             c AS (SELECT DISTINCT row, i + j AS i FROM v JOIN m USING (h), range(50) t(j) WHERE id > m),
             k AS (SELECT w.row, string_agg(word, ' ' ORDER BY w.i) AS kept, count(*) AS n FROM w ANTI JOIN c ON c.row = w.row AND c.i = w.i GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (row)
    """,
    "op13_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
             w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
             g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM w, range(1, 5) t(m), unnest(range(1, len(w) - m + 2)) u(i)),
             f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
             n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY 1),
             c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
             k AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM c, range(1, 4) t(k) WHERE k < m),
             s AS (SELECT k.*, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (x.a + y.a) AS BIGINT) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lp JOIN f y ON y.lang = k.lang AND y.phrase = rp),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             o AS (SELECT lang, array_to_string(ws[i:i + z - 1], ' ') AS phrase, max(a) AS held FROM c, range(2, 4) t(z), unnest(range(1, m - z + 2)) u(i) WHERE z < m GROUP BY 1, 2),
             d AS (SELECT b.*, n FROM b JOIN n USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE held IS NULL OR CAST(100 AS HUGEINT) * held < CAST(80 AS HUGEINT) * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                          list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
             c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a,
                          greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
                          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                               WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
             p AS (SELECT *, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN t ELSE x || y || z END) AS restored_sha256
        FROM p
    """,
    "op6_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                          CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
