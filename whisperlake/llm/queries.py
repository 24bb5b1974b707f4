"""The queries opN_<name>: each applies its operator, with production parameters, to a whole table.

What null, empty, very long and repeated rows, ties and empty tables give is stated by the operator that each query names;
columns of the table that an operator doesn't name are not read, so that clashing names make no difference.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of every text: see pii.detect (null text: empty; a row for each row)."""
    from whisperlake.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to shards, found again through the perfect hash index and read back: see binary.write_tokens (a row for each doc_id that is not null)."""
    from whisperlake.llm.binary import digests, write_tokens

    docs = table(spark, sf_dir, "documents")
    return digests(write_tokens(docs, VOCABULARY), docs)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score: see toxicity.score and train (null text: empty; a row for each row)."""
    from whisperlake.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score: see quality.score and train (null text: empty; a row for each row)."""
    from whisperlake.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class: see simhash.near_duplicates (a row for each row)."""
    from whisperlake.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's best window in every document that leaks it: see decontaminate.leaks."""
    from whisperlake.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and class: see embeddings.near_duplicates (a row for each row)."""
    from whisperlake.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text: see html.extract (null html: empty; a row for each row)."""
    from whisperlake.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the packed sequences, as these are read back: see packing.pack."""
    from whisperlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that go, by document: how many, and their positions: see spans.remove."""
    from whisperlake.llm.spans import remove

    found = remove(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.size("removed") > 0)
    places = F.concat_ws(",", F.transform("removed", lambda k: k.cast("string")))
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), places.alias("removed"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of 2 to 5 words: see phrases.collocations."""
    from whisperlake.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20: see nearest.nearest."""
    from whisperlake.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item: see ranking.search."""
    from whisperlake.llm.ranking import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_index": op2_token_index,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_embeddings": op7_embeddings,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_spans": op10_spans,
    "op11_phrases": op11_phrases,
    "op12_nearest": op12_nearest,
    "op13_ranking": op13_ranking,
}

#: SQL for DuckDB where it can express the operator; the others are tested against brute force.
SQL: dict[str, str] = {
    "op7_embeddings": """
        WITH RECURSIVE e AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), r(x, y) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT m.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, m.vec_id) AS component_id, coalesce(component_id, m.vec_id) = m.vec_id AS kept
        FROM embeddings m LEFT JOIN c ON m.vec_id = c.vec_id LEFT JOIN n ON m.vec_id = n.vec_id""",
    "op11_phrases": r"""
        WITH p AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), g AS (SELECT lang, k, w[i : i + k - 1] AS w FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS s(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, k, w), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
        u AS (
            SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, n.n, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
            FROM c JOIN range(1, 5) AS s(j) ON j < c.k JOIN n ON n.lang = c.lang
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' ')
        ), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM u),
        i AS (
            SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS s FROM c, range(2, 5) AS z(m) WHERE m < k) GROUP BY ALL
        ), o AS (
            SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
            FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE o = 1 AND (longer IS NULL OR 100 * longer < 100 * a)
        ) SELECT * FROM o WHERE rank <= 2000""",
    "op12_nearest": """
        WITH e AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_ranking": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        x AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (r), s GROUP BY item_id, r, doc_id
        ), o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
