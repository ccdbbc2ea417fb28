"""Registered queries of the text operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from placekeep.llm import langid, toxicity
from placekeep.llm.divergence import audit_sources
from placekeep.llm.licenses import scan_licenses
from placekeep.llm.main_text import extract_main_text
from placekeep.llm.media import with_media
from placekeep.llm.minhash import near_duplicate_sets
from placekeep.llm.mixing import mix
from placekeep.llm.order_minhash import fingerprint_documents
from placekeep.llm.packing import pack_documents
from placekeep.llm.ranked_search import rank_documents
from placekeep.llm.simhash import near_duplicates
from placekeep.llm.url_filter import RULES, judge_urls
from placekeep.session import table


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def blocked_hosts() -> list[str]:
    """The list that comes with the package; users pass a table of their own."""
    return (Path(__file__).parent / "blocked_hosts.txt").read_text(encoding="utf-8").split()


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.createDataFrame([(h,) for h in blocked_hosts()], "host string")
    return judge_urls(table(spark, sf_dir, "pages"), hosts=hosts)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_media(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_sets(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_toxicity, op2_order_minhash, op3_mixing, op4_langid, op5_main_text, op6_simhash, op7_url_filter, op8_media, op9_licenses, op10_packing,
    op11_ranked_search, op12_minhash, op13_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    hosts = ", ".join(f"('{h}')" for h in blocked_hosts())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "op7_url_filter": f"""
            WITH rules(host, path, verdict) AS (VALUES {rules}), listed(host) AS (VALUES {hosts}),
            rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), '{upper}', '{lower}') AS host, regexp_replace(r, '^[^/]*', '') AS path FROM rest),
            fits AS (SELECT p.page_id, p.host, p.path, u.host || u.path AS rule, u.verdict,
                            row_number() OVER (PARTITION BY p.page_id ORDER BY length(u.host || u.path) DESC) AS n
                     FROM parts p LEFT JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path))
            SELECT page_id, host, path, rule,
                   coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE fits.host = l.host OR ends_with(fits.host, '.' || l.host)) THEN 'block' ELSE 'allow' END) AS verdict
            FROM fits WHERE n = 1""",
        "op11_ranked_search": f"""
            WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
            tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
            g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
            w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, g),
            m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM d, g),
            q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
            s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
            SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""",
        "op12_minhash": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
            s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
                  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
            c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
            e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
            k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY ALL)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
            FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.node = doc_id""",
        "op13_divergence": f"""
            WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
            kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
            v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
            g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
            gn AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
            p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p
                  FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
            lc AS (SELECT lang, term, sum(c)::BIGINT AS c FROM c GROUP BY ALL), ln AS (SELECT lang, sum(c)::BIGINT AS n FROM lc GROUP BY ALL),
            q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (n + 2 * v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
            pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
            f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            o AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN f USING (lang, source, item)
                  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
            r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
            SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
    }
