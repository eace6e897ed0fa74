"""The operators over their whole given tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.llm import (
    byte_bpe, chat_format, decontaminate, filter_audit, html_text, language_id, metric_join, quality_llr, secret_scan,
    simhash, toxicity, url_filter, zone_clusters,
)
from pagestream.llm.common import fold, ship, table
from pagestream.llm.url_filter import Rule

# The rules of the query.
URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return byte_bpe.digest_tokens(table(spark, sf_dir, "documents"), *byte_bpe.default_files())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_llr.judge_quality(table(spark, sf_dir, "documents"), trusted)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    found = language_id.identify(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return zone_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_url_filter, op3_byte_bpe, op4_simhash, op5_quality_llr, op6_html_text, op7_toxicity,
        op8_decontaminate, op9_chat_format, op10_language_id, op11_metric_join, op12_zone_clusters, op13_filter_audit,
    )
}


def _url_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def host(x: str) -> str:
        return f"translate(regexp_extract({x}, '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{upper.lower()}')"

    def path(x: str) -> str:
        return f"regexp_extract({x}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"

    def address(x: str) -> str:
        query = (
            f"regexp_replace(regexp_replace(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1, 's'), "
            f"'(^|&)({url_filter.TRACKING})=[^&]*', '', 'g'), '^&', '')"
        )
        return (
            f"CASE WHEN {host(x)} <> '' THEN regexp_replace({host(x)}, ':(80|443)$', '') || regexp_replace({path(x)}, '/+$', '') "
            f"|| CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
        )

    def fitting(x: str, what: str) -> str:
        ranked = sorted(URL_RULES, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
        whens = " ".join(
            f"WHEN ({host(x)} = '{r.host}' OR ends_with({host(x)}, '.{r.host}')) AND starts_with({path(x)}, '{r.path}') "
            f"THEN '{r.text if what == 'rule' else r.verdict}'"
            for r in ranked
        )
        return f"CASE {whens} END"

    def link(tag: str, mark: str, value: str) -> str:
        return (
            f"replace(nullif(regexp_extract(regexp_extract(html, '(?is)<{tag}\\b[^>]*\\b{mark}[^>]*>', 0), '{value}', 1), ''), "
            "'&amp;', '&')"
        )

    canonical = link("link", "rel\\s*=\\s*[\"'']?canonical\\b", "(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)")
    refresh = link("meta", "http-equiv\\s*=\\s*[\"'']?refresh\\b", "(?is)\\burl\\s*=\\s*[\"'']?([^\"''\\s>;]+)")
    site = "regexp_extract(url, '^.*?://[^/?#]*', 0, 's')"
    folder = f"coalesce(nullif(regexp_extract({path('url')}, '^.*/', 0, 's'), ''), '/')"
    return f"""
WITH RECURSIVE named AS (
  SELECT url, unnest([{canonical}, {refresh}]) AS target FROM pages WHERE contains(url, '://')
), links AS (
  SELECT url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || target
    WHEN starts_with(target, '/') THEN {site} || target
    ELSE {site} || {folder} || target END AS target
  FROM named WHERE target IS NOT NULL
), ends AS (
  SELECT {address('url')} AS a, {fitting('url', 'verdict')} AS a_said,
         {address('target')} AS b, {fitting('target', 'verdict')} AS b_said FROM links
), und AS (
  SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b
), reach(node, root) AS (
  SELECT a, a FROM und UNION SELECT reach.node, und.b FROM reach JOIN und ON reach.root = und.a
), classes AS (
  SELECT node, min(root) AS component FROM reach GROUP BY node
), own AS (
  SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path, {address('url')} AS address,
         {fitting('url', 'rule')} AS rule, {fitting('url', 'verdict')} AS said FROM pages
), said AS (
  SELECT address, said FROM own UNION ALL SELECT a, a_said FROM ends UNION ALL SELECT b, b_said FROM ends
), by_address AS (
  SELECT address, max(CASE said WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS rank FROM said
  WHERE address IS NOT NULL AND said IS NOT NULL GROUP BY address
), by_class AS (
  SELECT component, max(rank) AS rank FROM classes JOIN by_address ON node = address GROUP BY component
), decided AS (
  SELECT address, max(rank) AS rank FROM (
    SELECT address, rank FROM by_address UNION ALL SELECT node, rank FROM classes JOIN by_class USING (component)
  ) GROUP BY address
)
SELECT page_id, host, path, rule,
  coalesce(said, CASE rank WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict,
  CASE WHEN said IS NOT NULL THEN 'rule' WHEN rank IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM own LEFT JOIN decided USING (address)
"""


_FINITE = "coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)"


def _metric_sql() -> str:
    return f"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         {_FINITE} AND len(embedding) > 0 AND label IS NOT NULL AS finite FROM embeddings
), normed AS (
  SELECT k, label, e, sqrt(list_dot_product(e, e)) AS size FROM vectors WHERE finite
), links AS (
  SELECT a.k AS a, b.k AS b FROM normed a JOIN normed b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach(node, other) AS (
  SELECT k, k FROM vectors UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a
), classes AS (
  SELECT node, min(vec_id) AS component_id FROM reach JOIN vectors ON other = k GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN classes ON k = node LEFT JOIN counts ON k = a
"""


def _clusters_sql(rounds: int = 3) -> str:
    def assigned(step: int) -> str:
        square = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""a{step} AS (
  SELECT k, any_value(vec_id) AS vec_id, any_value(v) AS v, min(o).c AS c, min(o).d AS d FROM (
    SELECT q.k, q.vec_id, q.v, {{'d': CAST({square} AS BIGINT), 'c': c.c}} AS o FROM kept q CROSS JOIN c{step} c
  ) GROUP BY k
)"""

    def moved(step: int) -> str:
        return f"""s{step} AS (
  SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{step - 1}) GROUP BY c, p
), m{step} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{step} GROUP BY c
), c{step} AS (
  SELECT old.c, coalesce(new.v, old.v) AS v FROM c{step - 1} old LEFT JOIN m{step} new USING (c)
)"""

    steps = [assigned(0)]
    for step in range(1, rounds + 1):
        steps += [moved(step), assigned(step)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v
  FROM kept QUALIFY c < 16
), {", ".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
"""


def _audit_sql() -> str:
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    steps = ", ".join(
        f"('{order}', {step + 1}, {filter_audit.bits(order[step])}, {filter_audit.bits(order[:step])})"
        for order in filter_audit.ORDERS for step in range(5)
    )
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {words} AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM words GROUP BY text
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), masks AS (
  SELECT part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > least THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN firsts USING (text) LEFT JOIN marked ON words.doc_id = marked.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), steps(filter_order, step, own, before) AS (VALUES {steps}
), told AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts CROSS JOIN steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""


#: The others hash words, run automata or fit models, which SQL can't express; tests compare them with brute force.
ORACLE: dict[str, str] = {
    "op2_url_filter": _url_sql(), "op11_metric_join": _metric_sql(), "op12_zone_clusters": _clusters_sql(),
    "op13_filter_audit": _audit_sql(),
}
