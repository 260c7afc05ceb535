"""The registered queries of the text operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import collocations, divergence, extract, jaccard, language, mixing, near_vectors, neighbours, packing, pii, substrings, toxicity, warc
from orderloom.llm.common import table
from orderloom.sources.stage import StageTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@_register("op1_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"), StageTables(spark))


@_register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


@_register(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT digest, min(page_id) AS first_id FROM p GROUP BY digest)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM p JOIN f USING (digest)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = StageTables(spark)
    index = warc.write(table(spark, sf_dir, "pages"), stage)
    return warc.resolve(stage.keep("records", warc.read(index, stage, payloads=False).drop("payload")))


@_register("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


@_register(
    "op5_jaccard",
    """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    s AS (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3])) END) AS s
        FROM w
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), StageTables(spark), jaccard.Rule(words=4, percent=85))


@_register(
    "op6_near_vectors",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    l AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
    ),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
        vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
    FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), StageTables(spark))


@_register("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), StageTables(spark))


@_register("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), StageTables(spark)).drop("key")


@_register("op7_extract")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@_register("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@_register(
    "op11_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (
        SELECT r, lang, source,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM d
    ),
    k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v) AS p,
            1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
        FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
    ),
    pair AS (
        SELECT a.lang, a.source, b.source AS item, (
            SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) FROM p x JOIN p y USING (lang, term)
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source
        )::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    ),
    own AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    r AS (
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
        UNION ALL
        SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM own)
        WHERE rank <= 10
    )
    SELECT * FROM r
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), StageTables(spark))


@_register(
    "op13_substrings",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    k AS (SELECT r, w.words, i FROM (
        SELECT r, n, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS words FROM x
    ) w WHERE i + 34 <= n),
    c AS (SELECT words FROM k GROUP BY words HAVING count(*) > 1),
    g AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS i FROM k SEMI JOIN c USING (words)),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN g USING (r, i) GROUP BY r),
    gone AS (SELECT r, count(*) AS n FROM g GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove(table(spark, sf_dir, "documents"), StageTables(spark)))


@_register(
    "op12_collocations",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
    g AS (
        SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])))) AS g
        FROM p WHERE len(w) > 0
    ),
    f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
    c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
    longer AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE len(g) = 3),
    gone AS (SELECT DISTINCT c.lang, c.g FROM c JOIN longer USING (lang, g) WHERE 100 * longer.a >= 50 * c.a),
    cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c ANTI JOIN gone USING (lang, g)),
    s AS (
        SELECT cut.lang, array_to_string(cut.g, ' ') AS phrase, a, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score,
            row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY 1000000 * a * a // (x.f * y.f), k) AS nth
        FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[k + 1 :]
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s WHERE nth = 1)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"), StageTables(spark))
