"""Queries of this subpackage: name -> callable(spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import html_extract

    return html_extract(_table(spark, sf_dir, "pages"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resharding import digest, reshard

    return digest(reshard(_table(spark, sf_dir, "documents"))[0])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import scan_shards, write_shards

    return scan_shards(spark, write_shards(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))[0]


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scoring

    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring(_table(spark, sf_dir, "documents"), good)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can say: host, path and rule of every url."""
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can say: the counts of every document and what the base rules make of them."""
    from .quality_rules import COUNTS

    return op9_quality_rules(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_substring_dedup,
        op3_lm_scoring,
        op4_sstable,
        op5_ngram_jaccard_join,
        op6_html_extract,
        op7_resharding,
        op8_packing,
        op9_quality_rules,
        op10_decontamination,
        url_rules,
        quality_counts,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS by_rule, '{r.split('/')[0]}' AS h, '/{r.split('/', 1)[1]}' AS p" for v, r in [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")])

ORACLES: dict[str, str] = {
    "url_rules": f"""WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS ({_RULES}), f AS (SELECT n, arg_max(rule, len(rule)) AS rule, arg_max(by_rule, len(rule)) AS by_rule FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY n)
 SELECT page_id, host, path, rule, by_rule FROM h LEFT JOIN f USING (n)""",
    "quality_counts": f"""WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents), d AS (SELECT n, doc_id, text, {_WORDS} AS w FROM t),
 g AS (SELECT n, i, list_slice(w, i, i + 7) AS k FROM (SELECT n, w, unnest(range(1, len(w) - 6)) AS i FROM d) q),
 c AS (SELECT n, count(DISTINCT p) AS covered FROM (SELECT n, unnest(range(i, i + 8)) AS p FROM (SELECT n, i, count(*) OVER (PARTITION BY n, k) AS times FROM g) q WHERE times > 1) q GROUP BY n),
 l AS (SELECT n, count(*) - count(DISTINCT line) AS dup FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM t) q WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
 x AS (SELECT n, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words FROM d LEFT JOIN l USING (n) LEFT JOIN c USING (n))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x""",
    "op2_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) q),
 m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (k) WHERE least < doc_id),
 x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
 kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS s FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id),
 r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [w] ELSE list_sort(list_distinct([list_slice(w, i, i + 4) for i in range(1, len(w) - 3)])) END AS g FROM d),
 f AS (SELECT doc_id, g, md5(CAST(g AS VARCHAR)) AS k FROM s WHERE g IS NOT NULL),
 nodes AS (SELECT k, min(doc_id) AS copy_of, count(*) AS n_copies, any_value(g) AS g FROM f GROUP BY k),
 ng AS (SELECT k, len(g) AS n, unnest(g) AS x FROM nodes),
 pr AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM ng a JOIN ng b ON a.x = b.x AND a.k < b.k GROUP BY ALL),
 ln AS (SELECT ka, kb FROM pr WHERE 9 * c >= 4 * (na + nb)), bo AS (SELECT ka AS u, kb AS v FROM ln UNION ALL SELECT kb, ka FROM ln),
 re AS (SELECT k, k AS r FROM nodes UNION SELECT re.k, bo.v FROM re JOIN bo ON bo.u = re.r),
 cl AS (SELECT re.k, min(copy_of) AS class_id FROM re JOIN nodes ON nodes.k = re.r GROUP BY re.k), de AS (SELECT u, count(*) AS n FROM bo GROUP BY u)
 SELECT s.doc_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(copy_of, s.doc_id) AS copy_of, coalesce(n_copies, 1) AS n_copies, coalesce(de.n, 0) AS n_links
 FROM s LEFT JOIN f ON f.doc_id = s.doc_id LEFT JOIN nodes ON nodes.k = f.k LEFT JOIN cl ON cl.k = f.k LEFT JOIN de ON de.u = f.k""",
}
