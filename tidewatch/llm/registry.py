"""The numbered queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import codes, covertree, ctw, mixing, packing, repair, repeats, secrets, simhash, telephony, tokencount, tokenfile, tokens, toxicity
from tidewatch.llm.common import documents
from tidewatch.session import stored, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and the verdict on every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as telephony audio, read back and measured."""
    media = telephony.store(telephony.text_payload(documents(table(spark, sf_dir, "documents"))))
    return telephony.decode(stored(media, "media")).drop("codec")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the shard files through their index."""
    shards = tokenfile.write(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read_all(shards)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, tokens, sampling probability and decision of every document."""
    out = mixing.decide(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    return out.select("row.doc_id", "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), F.col("p").alias("probability"), "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=2).drop("ids")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated word sequences."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("kept")


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of every document."""
    return ctw.score(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired rows' digest of every conversation."""
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every vector."""
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokens.tokenizer_path("piece_bpe_32k.model"), limit=4096)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_top_k, op4_telephony, op5_token_shards, op6_mixing, op7_packing, op8_secrets, op9_repeats, op10_ctw, op11_repair, op12_codes, op13_token_counts)}



def _moved(i: int) -> str:
    """SQL of one k-means round: c{i+1} from c{i}."""
    return f"""
        n{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
               FROM (SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                     FROM x JOIN c{i} c USING (p)) GROUP BY r, p)"""


def _entries(i: int) -> str:
    return f"""
        s{i} AS (SELECT p, e, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
               FROM (SELECT p, n.e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM n{i} n JOIN x USING (r, p)) GROUP BY p, e, i),
        c{i + 1} AS MATERIALIZED (SELECT p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c
               LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS x FROM s{i} GROUP BY p, e) m USING (p, e))"""


ORACLE_SQL = {
    "op11_repair": r"""
        WITH crcs AS (
            SELECT list(list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
            FROM (SELECT unnest(range(0, 256)) AS n)),
        k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h
            FROM conversations, crcs),
        d AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
            FROM k WHERE h <> 0),
        o AS (
            SELECT conv_id, turn, role, text, left(role, 1) AS initial,
                   row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
            FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
        f AS (
            SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
        st AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                   count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
                   count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
                   count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
                   list({'initial': initial, 'gone': coalesce(fault IN ('blank', 'duplicate'), false), 'late': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'role': role, 'text': text} ORDER BY i) AS seq
            FROM f GROUP BY conv_id),
        -- what is written so far ends in nothing (z), s, u or a: the least (cost, audit) of each; three insertions may follow a row
        w AS (
            SELECT conv_id, list_reduce(
                flatten(list_prepend([add, add, add], list_transform(seq, lambda r: [{'way': 'row', 'k': r.initial, 'gone': r.gone, 'late': r.late}, add, add, add]))),
                lambda q, r: CASE WHEN r.way = 'add' THEN {
                    'z': q.z, 's': q.s,
                    'u': least(q.u, {'c': least(q.z, q.s, q.a).c + 2, 'e': least(q.z, q.s, q.a).e || 'I'}),
                    'a': least(q.a, {'c': q.u.c + 2, 'e': q.u.e || 'I'})}
                ELSE {
                    'z': {'c': q.z.c + 3, 'e': q.z.e || 'D'},
                    's': least({'c': q.s.c + 3, 'e': q.s.e || 'D'},
                               {'c': q.z.c + CASE WHEN r.k = 's' AND NOT r.gone THEN r.late ELSE 1000000 END, 'e': q.z.e || 'K'}),
                    'u': least({'c': q.u.c + 3, 'e': q.u.e || 'D'},
                               {'c': least(q.z, q.s, q.a).c + CASE WHEN r.k = 'u' AND NOT r.gone THEN r.late ELSE 1000000 END, 'e': least(q.z, q.s, q.a).e || 'K'},
                               {'c': least(q.z, q.s, q.a).c + CASE WHEN r.gone THEN 1000000 ELSE 2 + r.late END, 'e': least(q.z, q.s, q.a).e || 'R'}),
                    'a': least({'c': q.a.c + 3, 'e': q.a.e || 'D'},
                               {'c': q.u.c + CASE WHEN r.k = 'a' AND NOT r.gone THEN r.late ELSE 1000000 END, 'e': q.u.e || 'K'},
                               {'c': q.u.c + CASE WHEN r.gone THEN 1000000 ELSE 2 + r.late END, 'e': q.u.e || 'R'})} END, z) AS q
            FROM st, (SELECT {'z': {'c': 0::BIGINT, 'e': ''}, 's': {'c': 1000000::BIGINT, 'e': ''}, 'u': {'c': 1000000::BIGINT, 'e': ''}, 'a': {'c': 1000000::BIGINT, 'e': ''}} AS z,
                             {'way': 'add', 'k': '', 'gone': false, 'late': 0} AS add)),
        b AS (SELECT st.*, least(q.z, q.a).c AS cost, least(q.z, q.a).e AS audit FROM st JOIN w ON st.conv_id IS NOT DISTINCT FROM w.conv_id),
        l AS (SELECT conv_id, seq, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS i FROM b),
        n AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS nth FROM l),
        g AS (SELECT conv_id, i, e, CASE WHEN e <> 'I' THEN seq[nth] END AS own, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM n WHERE e NOT IN ('D', '')),
        t AS (SELECT *, bool_or(pos = 1 AND e = 'K' AND own.initial = 's') OVER (PARTITION BY conv_id) AS led FROM g),
        y AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN own.role WHEN (pos % 2 = 1) <> led THEN 'user' ELSE 'assistant' END
                     || ':' || CASE WHEN e = 'I' THEN '' ELSE own.text END, chr(10) ORDER BY pos)) AS h FROM t GROUP BY conv_id)
        SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) v
        LEFT JOIN b ON v.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN y ON v.conv_id IS NOT DISTINCT FROM y.conv_id
    """,
    "op12_codes": """
        WITH a AS (
            SELECT vec_id, label, list_transform(embedding, lambda y: floor(y::DOUBLE * 1024)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM a, (SELECT unnest(range(0, 4)) AS p)),
        c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM x WHERE r <= 256),"""
    + ",".join(part for i in range(4) for part in (_moved(i), _entries(i)))
    + ","
    + _moved(4)
    + """,
        o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n4 GROUP BY r),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN a USING (r), h
    """,
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20
    """,
    "op9_repeats": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        p AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
              FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
        m AS (SELECT r, i FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
        g AS (SELECT r, list(DISTINCT i + j) AS gone FROM (SELECT r, i, unnest(range(0, 35)) AS j FROM m) GROUP BY r),
        k AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
                     CASE WHEN gone IS NULL THEN w
                          ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
              FROM d LEFT JOIN g USING (r))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
}
