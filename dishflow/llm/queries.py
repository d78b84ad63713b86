"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishflow.llm.chat_format import format_and_read_back
from dishflow.llm.common import shuffle_partitions, table
from dishflow.llm.exact_dedup import exact_dedup
from dishflow.llm.fill_in_middle import fill_in_middle
from dishflow.llm.license_scan import scan_licenses
from dishflow.llm.mixing import mix
from dishflow.llm.packing import pack_documents
from dishflow.llm.quality import classify
from dishflow.llm.simhash_dedup import near_duplicates
from dishflow.llm.spelling import spelling_variants
from dishflow.llm.substring_dedup import drop_repeated_passages
from dishflow.llm.suffix_dedup import drop_repeated_bytes
from dishflow.llm.token_files import encode_and_read_back
from dishflow.llm.topk import integer_weights, top_k

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), integer_weights(F.col("embedding")).alias("w"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With conversation -1, whose texts say what other templates use as control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_and_read_back(turns.unionByName(extra))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), share=1.5, most=2.0)
    first = F.array_min(F.transform("uses", lambda u: u["position"]))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return rows.repartitionByRange(shuffle_partitions(spark), F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_passages(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, capacity=2048)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_bytes(table(spark, sf_dir, "documents"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return fill_in_middle(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_topk": op2_topk,
    "op3_chat_format": op3_chat_format,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling": op11_spelling,
    "op12_licenses": op12_licenses,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op2_topk": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   coalesce(list_sum(list_transform(list_zip(q.w[:least(len(q.w), len(c.w))], c.w[:least(len(q.w), len(c.w))]), lambda z: z[1] * z[2])), 0)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS "rank", vec_id, score
        FROM s QUALIFY "rank" <= 5""",
    "op3_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        u AS (SELECT *, 3 + length(role || text) + length(role || text) - length(regexp_replace(role || text, '[\x02\x03\x0E]', '', 'g')) + length(role) - length(replace(role, chr(10), '')) AS chars FROM t),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                     coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
                     count(*) FILTER (WHERE role = 'assistant') AS n_examples FROM u GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_examples FROM g""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        x AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
        b AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS d FROM x) WHERE d < doc_id),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM b),
        r AS (SELECT doc_id, count(*) AS n_removed, sum(first)::BIGINT AS n_spans FROM (SELECT doc_id, CASE WHEN p = lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 1 THEN 0 ELSE 1 END AS first FROM c) GROUP BY doc_id),
        k AS (SELECT e.doc_id, string_agg(e.t, ' ' ORDER BY e.p) AS kept FROM (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM w) e ANTI JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_suffix_dedup": r"""
        WITH b AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
        w AS (SELECT r, i, md5(t[i + 1:i + 400]) AS h FROM (SELECT r, t, unnest(range(0, octet_length(t) - 399)) AS i FROM b)),
        s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
        n AS (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM s),
        g AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY r, span),
        k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS behind FROM (SELECT * FROM g UNION ALL SELECT r, octet_length(t), octet_length(t) FROM b)),
        j AS (SELECT r, string_agg(hex(t[behind + 1:a]), '' ORDER BY a, z) AS kept, sum(z - a)::BIGINT AS n_removed, count(*) - 1 AS n_spans FROM k JOIN b USING (r) GROUP BY r)
        SELECT doc_id, octet_length(t) AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM b JOIN j USING (r)""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_spelling": r"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
        r AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS word FROM documents) WHERE length(word) >= 7 GROUP BY ALL),
        b AS (SELECT word, k, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM r),
        h AS (SELECT word, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h FROM b, t),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, k FROM h),
        v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        l AS (SELECT DISTINCT v.word AS short, v.n AS short_n, d.word AS long, d.n AS long_n FROM d JOIN v ON d.rest = v.word),
        p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION ALL SELECT short, long, long_n FROM l UNION ALL SELECT long, short, short_n FROM l),
        q AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN q USING (word)),
        c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f last ON last.word = c.at AND last.form IS NULL""",
    "op12_licenses": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        o AS (SELECT * FROM w WHERE regexp_matches(array_to_string(ws, ' '), 'apache|lic|ense|general|creative|commons|attri|bution|cc by')),
        x AS (SELECT doc_id, i, ws[i:i + 5] AS ws FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM o)),
        s AS (SELECT * FROM (SELECT doc_id, i, array_to_string(ws[1:c], ' ') AS said FROM x, range(1, 7) r(c) WHERE c <= len(ws)) WHERE length(said) BETWEEN 5 AND 31),
        b AS (SELECT doc_id, i - 1 AS i, label FROM s JOIN (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) p(phrase, label) ON s.said = p.phrase),
        n AS (SELECT * FROM (VALUES ('gpl', 'gnu ', 'general public license', 2), ('apache', '', 'apache license', 1), ('mit', 'mit ', 'license', 1), ('cc-by', '', 'creative commons attribution', 3)) v(label, head, body, errors)),
        z AS (SELECT doc_id, label, head, body, errors, regexp_replace(substr(said, length(head) + 1), '[^\x00-\x7F]', '#', 'g') AS rest FROM s JOIN n ON length(said) BETWEEN length(head || body) - errors AND length(head || body) + errors AND substr(said, 1, length(head)) = head),
        m AS (SELECT doc_id, label, errors, length(head || body) AS size, levenshtein(rest, body) AS edits FROM z),
        g AS (SELECT doc_id, label, 1 - edits / size::DOUBLE AS score FROM m WHERE edits <= errors UNION ALL SELECT doc_id, label, 1.0 FROM b),
        a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM g GROUP BY doc_id),
        e AS (SELECT doc_id, count(*) AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM w LEFT JOIN e USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
        h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(s, 9, 8))::BIGINT % (len(u) + 1) AS b, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS share FROM d),
        f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN share < 50 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS x FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""",
}
