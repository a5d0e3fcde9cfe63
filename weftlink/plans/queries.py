"""The registered queries over the driver's tables, and the SQL that says the same.

Records come from ``documents``: the id is doc_id, the name a text's first line,
the address the rest, the country its language.  All documents stand on both
sides, a record never being its own candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import similarity as S
from weftlink.functions import fixed, text, udfs
from weftlink.operators import blocking, diagnostics, features, metrics, sampling, scoring, tuning, validate
from weftlink.operators.model import Matcher, training_pairs
from weftlink.plans import resolve as resolving
from weftlink.plans.normalise import normalised
from weftlink.plans.presets import Channel
from weftlink.sources import readers, scratch, writers

NAME = Channel("name", "name_tokens", 60)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    first = F.regexp_extract(t, r"^[^\n]*", 0)
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("entity_id"), first.alias("business_name"), F.substr(t, F.length(first) + 2).alias("business_address"), F.col("lang").alias("country"), F.col("doc_id").alias("row_idx")
    )


def records(spark: SparkSession, sf: str, family: str = "plain") -> DataFrame:
    return normalised(entities(spark, sf), family)


#: Stand-in businesses with numbers in their addresses, made of customers (the same text in both languages).
_SHOP_NAME = "c_mktsegment || ' ' || CASE c_custkey % 4 WHEN 0 THEN 'trading' WHEN 1 THEN 'the great' WHEN 2 THEN 'www.shop' || c_nationkey || '.com' ELSE 'of ' || c_nationkey END || CASE c_custkey % 7 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' LLC' WHEN 3 THEN ' Services' WHEN 4 THEN ' Consulting Pvt Ltd' WHEN 5 THEN '' ELSE ' Limits' END"
_SHOP_ADDRESS = "CASE c_custkey % 11 WHEN 0 THEN '' ELSE (c_custkey % 97) || ' Main St, Suite ' || (c_nationkey + 100) || ', ' END || CASE c_nationkey % 8 WHEN 0 THEN 'Dallas, TX' WHEN 1 THEN 'Columbus Ohio' WHEN 2 THEN 'New York' WHEN 3 THEN 'Pune, MH' WHEN 4 THEN 'Chennai Tamil Nadu' WHEN 5 THEN '12 Rue Cler, Paris' WHEN 6 THEN 'West Virginia in WV' ELSE 'Box 7' END || ' ' || CASE c_custkey % 5 WHEN 0 THEN '' ELSE '' || (70000 + c_nationkey * 37 + c_custkey % 3) END"
_SHOP_COUNTRY = "CASE c_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END"
_SHOP_ID = "'S' || (1 + c_custkey % 3) || '-' || c_custkey"


def shops(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(f"{_SHOP_ID} AS entity_id", f"{_SHOP_NAME} AS business_name", f"{_SHOP_ADDRESS} AS business_address", f"{_SHOP_COUNTRY} AS country", "c_custkey AS row_idx")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def blocked(spark: SparkSession, sf: str, *channels: Channel) -> DataFrame:
    r = records(spark, sf)
    return blocking.candidates(r, r, channels or (NAME,))


def pairs(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Name-token pairs with these fields of both records, sets of words as hashes."""
    r = records(spark, sf)
    r = scratch.saved(r.select(*dict.fromkeys(["id", "country", "name_tokens", "clean_name", *(f for f in fields if f not in resolving.GRAMS)])), "records")
    derived = {f: c for f, c in (resolving.GRAMS | resolving.WORDS).items() if f in fields and (f in resolving.GRAMS or "clean_name" in fields)}
    sent = ["id", *fields, *(["clean_name"] if derived and "clean_name" not in fields else [])]
    out = blocking.met(blocking.lists(r, r, (NAME,)), r, r, sent, derived).withColumn("provenance", F.lit(NAME.weight))
    scratch.dropped(r)
    return out


def halves(r: DataFrame, fields: list[str], words: tuple[str, ...] = ()) -> DataFrame:
    """Name-token pairs of r, one of a pair and its reverse, with these fields, sets of words as numbers but for those named in words."""
    r = scratch.saved(r.select(*dict.fromkeys(["id", "country", "name_tokens", *fields])), "records")
    each = blocking.lists(r, r, (NAME,))
    later = each.withColumn("each", F.filter("each", lambda x: x > F.col("s1"))).where(F.size("each") > 0)
    met = blocking.met(later, r, r, fields, words=words)
    scratch.dropped(r)
    return met


def spread(r: DataFrame, fields: list[str], words: tuple[str, ...] = ()) -> DataFrame:
    """halves() and their reverses; the two come one after the other, so that kernels that are the same both ways round run once for both."""
    met = halves(r, fields, words)
    back = F.struct(F.col("cid").alias("s1"), F.col("s1").alias("cid"), F.col("r").alias("l"), F.col("l").alias("r"))
    return met.select(F.explode(F.array(F.struct("s1", "cid", "l", "r"), back)).alias("_p")).select("_p.*")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(s1, cid, score): name-token candidates and the Jaccard similarity of their tokens."""
    return pairs(spark, sf, "name_tokens").select("s1", "cid", S.jaccard(*scoring.side("name_tokens")).alias("score"))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("score >= 0.5")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(id, class): documents of a language with equal letters and digits are one class, each other's matches; those without any are in none."""
    k = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", "")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(k != "", F.sha2(F.concat("lang", F.lit(" "), k), 256)).alias("class"))


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("s1"), F.col("doc_id").alias("row_idx"))


# SQL building blocks -----------------------------------------------------------

_PLAIN = "trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SPACED = "trim(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), ' ')"
_WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_SET = "list_distinct(" + _WORDS + ")"
_E = "e AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang AS country, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS name, substr(coalesce(text, ''), length(regexp_extract(coalesce(text, ''), '^[^\\n]*')) + 2) AS addr FROM documents)"
_N = f"{_E}, n AS (SELECT id, doc_id, country, {_PLAIN.format('name')} AS cn, {_PLAIN.format('addr')} AS ca FROM e), t AS (SELECT *, {_SET.format('cn')} AS nt, {_SET.format('ca')} AS ats, regexp_extract_all(ca, '\\b\\d+\\b') AS nums FROM n)"


_E2 = f"e AS (SELECT {_SHOP_ID} AS id, c_custkey AS doc_id, {_SHOP_COUNTRY} AS country, {_SHOP_NAME} AS name, {_SHOP_ADDRESS} AS addr FROM customer)"
_N2 = _N.replace(_E, _E2)


def _post(name: str, expression: str, cap: int | None = 60, least: int = 1) -> str:
    """Postings p_name, its capped keys and pairs c_name."""
    having = f"HAVING count(*) <= {cap}" if cap else ""
    return (
        f"p_{name} AS (SELECT country, id, k FROM (SELECT country, id, unnest({expression}) AS k FROM t) WHERE length(k) >= {least}), "
        f"k_{name} AS (SELECT country, k FROM p_{name} GROUP BY country, k {having}), "
        f"c_{name} AS (SELECT DISTINCT a.country, a.id AS s1, b.id AS cid FROM p_{name} a JOIN k_{name} USING (country, k) JOIN p_{name} b ON a.country = b.country AND a.k = b.k AND a.id <> b.id)"
    )


_JAC = "(CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN {2} WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END)"
_NAME = f"{_N}, {_post('name', 'nt')}"
_SCORED = f"{_NAME}, scored AS (SELECT c.s1, c.cid, {_JAC.format('x.nt', 'y.nt', '1.0')} AS score FROM c_name c JOIN t x ON x.id = c.s1 JOIN t y ON y.id = c.cid), accepted AS (SELECT * FROM scored WHERE score >= 0.5)"
_TRUTH = "d AS (SELECT doc_id, lang, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS k FROM documents), truth AS (SELECT CAST(a.doc_id AS VARCHAR) AS s1, CAST(b.doc_id AS VARCHAR) AS cid FROM d a JOIN d b ON a.lang = b.lang AND a.k = b.k AND a.doc_id <> b.doc_id WHERE a.k <> '')"
_COUNTS = "spine AS (SELECT CAST(doc_id AS VARCHAR) AS s1 FROM documents), cnt AS (SELECT spine.s1, (SELECT count(*) FROM accepted a WHERE a.s1 = spine.s1) AS n_pred, (SELECT count(*) FROM truth x WHERE x.s1 = spine.s1) AS n_true, (SELECT count(*) FROM accepted a JOIN truth x USING (s1, cid) WHERE a.s1 = spine.s1) AS tp FROM spine), f AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * tp / n_pred + tp / n_true) END AS f05, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 WHEN n_pred = 0 THEN 1.0 ELSE tp / n_pred END AS p, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_true END AS r FROM cnt)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Flagship ----------------------------------------------------------------------


@query(f"WITH {_SCORED}, k AS (SELECT s1, cid, score, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM scored) SELECT s1, cid, round(score, 6) AS score, CAST(rn AS INTEGER) AS rn FROM k WHERE rn <= 50 AND score >= 0.5")
def q_block_token_topk(spark, sf):
    s = scored(spark, sf).withColumn("score", r6("score"))
    return blocking.ranked(s, 50, "score").where("score >= 0.5").select("s1", "cid", "score", "rn")


# Text --------------------------------------------------------------------------


@query(f"WITH {_E} SELECT id, {_PLAIN.format('name')} AS name, {_PLAIN.format('addr')} AS addr FROM e")
def q_normalize_plain(spark, sf):
    return entities(spark, sf).select(F.col("entity_id").alias("id"), text.plain("business_name").alias("name"), text.plain("business_address").alias("addr"))


@query(f"WITH {_E} SELECT id, {_SPACED.format('name')} AS name, {_SPACED.format('addr')} AS addr FROM e")
def q_normalize_spaced(spark, sf):
    return entities(spark, sf).select(F.col("entity_id").alias("id"), text.spaced("business_name").alias("name"), text.spaced("business_address").alias("addr"))


@query("SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS alpha FROM documents")
def q_alpha_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.alpha("text").alias("alpha"))


@query("SELECT page_id, replace(regexp_extract(lower(coalesce(url, '')), '\\b([a-z0-9\\-]+)\\.(?:com|in|org|net|fr|co|io|biz|info)\\b', 1), '-', '') AS stem FROM pages")
def q_domain_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.domain_stem("url").alias("stem"))


@query(f"WITH {_N2} SELECT id, regexp_extract(cn, '(?:^| )(' || '{'|'.join(sorted(fixed.LEGAL_SUFFIXES, key=len, reverse=True))}' || ')$', 1) AS suffix FROM n")
def q_legal_suffix(spark, sf):
    return shops(spark, sf).select(F.col("entity_id").alias("id"), text.legal_suffix(text.plain("business_name")).alias("suffix"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\b\\d+\\b'))) AS digits FROM documents")
def q_address_digits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_sort(text.digits(text.spaced("text"))).alias("digits"))


@query(f"WITH c AS (SELECT doc_id, regexp_extract_all({_SPACED.format(chr(34) + 'text' + chr(34))}, '\\b\\d+\\b') AS nums FROM documents) SELECT doc_id, coalesce(list_filter(nums, lambda d: length(d) IN (5, 6))[1], '') AS postal FROM c")
def q_postal_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.postal(text.spaced("text")).alias("postal"))


@query(f"WITH c AS (SELECT doc_id, regexp_extract_all({_SPACED.format(chr(34) + 'text' + chr(34))}, '\\b\\d+\\b') AS nums FROM documents), p AS (SELECT *, coalesce(list_filter(nums, lambda d: length(d) IN (5, 6))[1], '') AS postal FROM c) SELECT doc_id, coalesce(list_filter(nums, lambda d: length(d) <= 5)[1], '') AS street, coalesce(list_filter(nums, lambda d: length(d) <= 5 AND d <> postal)[1], '') AS street_not_postal FROM p")
def q_street_number(spark, sf):
    clean = text.spaced("text")
    return table(spark, sf, "documents").select("doc_id", text.street_number(clean).alias("street"), text.street_not_postal(clean).alias("street_not_postal"))


@query(f"WITH {_N} SELECT id, list_sort(list_distinct(list_transform(ats, lambda x: CASE x WHEN 'st' THEN 'street' WHEN 'pl' THEN 'place' WHEN 'po' THEN 'postoffice' WHEN 'col' THEN 'colony' ELSE x END))) AS tokens FROM t")
def q_expand_addr(spark, sf):
    table_ = {"st": "street", "pl": "place", "po": "postoffice", "col": "colony"}
    return records(spark, sf).select("id", F.array_sort(text.expanded(F.col("clean_addr"), table_)).alias("tokens"))


@query(f"WITH {_N}, s AS (SELECT id, replace(cn, ' ', '') AS s FROM n) SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 4)))) AS grams FROM s")
def q_char_ngrams(spark, sf):
    return records(spark, sf).select("id", F.array_sort("ng4").alias("grams"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{0900}-\\x{0D7F}]') AS indic FROM documents")
def q_indic_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.has_indic("text").alias("indic"))


@query(f"WITH {_E} SELECT p_partkey, list_sort({_SET.format('lower(p_name)')}) AS tokens FROM part")
def q_name_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_sort(text.word_set(F.lower("p_name"))).alias("tokens"))


# Aggregates ----------------------------------------------------------------------


@query(f"WITH {_N} SELECT country, k AS token, count(*) AS df FROM (SELECT country, unnest(nt) AS k FROM t) GROUP BY country, k")
def q_token_df(spark, sf):
    return blocking.frequencies(blocking.postings(records(spark, sf), [NAME])).select("country", F.col("key").alias("token"), "df")


@query(f"WITH {_N} SELECT country, k AS token, count(*) AS df FROM (SELECT country, unnest(nt) AS k FROM t) GROUP BY country, k HAVING count(*) < 50")
def q_rare_tokens(spark, sf):
    return q_token_df(spark, sf).where("df < 50")


@query("SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang")
def q_country_counts(spark, sf):
    return diagnostics.value_counts(table(spark, sf, "documents"), "lang")


@query("SELECT count(*) AS n, count(DISTINCT page_id) AS ids, count(page_id) - count(DISTINCT page_id) AS duplicate_ids, count(*) FILTER (page_id IS NULL) AS missing_page_id, count(*) FILTER (url IS NULL OR url = '') AS missing_url, count(*) FILTER (html IS NULL OR html = '') AS missing_html FROM pages")
def q_missing_counts(spark, sf):
    return diagnostics.profile(table(spark, sf, "pages"), "page_id")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def q_dup_ids(spark, sf):
    return validate.duplicate_rows(table(spark, sf, "orders"), "o_custkey")


@query("SELECT regexp_extract(lower(trim(text)), '^\\S+') AS word, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, word LIMIT 500")
def q_frequent_first_words(spark, sf):
    return diagnostics.frequent_first_words(table(spark, sf, "documents"), "text", 500)


# Joins -----------------------------------------------------------------------------


def _block(name: str, channel: Channel, expression: str, of_shops: bool = False) -> None:
    def run(spark, sf):
        if of_shops:
            r = normalised(shops(spark, sf), "plain")
            return blocking.candidates(r, r, [channel]).select("country", "s1", "cid")
        return blocked(spark, sf, channel).select("country", "s1", "cid")

    run.__name__ = f"q_{name}"
    query(f"WITH {_N2 if of_shops else _N}, {_post('x', expression, channel.cap, channel.least)} SELECT country, s1, cid FROM c_x")(run)


_block("block_digits", Channel("digit", "digits", 40, least=2), "list_distinct(nums)")
_block("block_addr", Channel("address", "addr_tokens", 40, least=3), "ats")
_block("block_exact", Channel("exact", "clean_name", 150, least=3), "[cn]")
_block("block_street", Channel("street", "street", 40), "[regexp_extract(ca, '^(\\d+)\\b', 1)]", True)
_block("block_postal", Channel("postal", "postal", 30), "[coalesce(list_filter(nums, lambda d: length(d) IN (5, 6))[1], '')]", True)
_block("block_ngram4", Channel("grams", "ng4", 30), "list_distinct(list_transform(range(1, greatest(length(replace(cn, ' ', '')) - 2, 1)), lambda i: substr(replace(cn, ' ', ''), i, 4)))")


@query("WITH p AS (SELECT page_id, replace(regexp_extract(lower(coalesce(url, '')), '\\b([a-z0-9\\-]+)\\.(?:com|in|org|net|fr|co|io|biz|info)\\b', 1), '-', '') AS k FROM pages), q AS (SELECT * FROM p WHERE length(k) >= 4) SELECT CAST(a.page_id AS VARCHAR) AS s1, CAST(b.page_id AS VARCHAR) AS cid FROM q a JOIN q b ON a.k = b.k AND a.page_id <> b.page_id")
def q_block_domain(spark, sf):
    r = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), text.domain_stem("url").alias("key"))
    return blocking.equal_keys(r.where(F.length("key") >= 4))


@query(f"WITH {_NAME} SELECT p_name.country, id, k AS token FROM p_name JOIN k_name USING (country, k)")
def q_cap_skip(spark, sf):
    r = records(spark, sf)
    return blocking.capped(blocking.postings(r, [NAME]), [NAME]).select("country", "id", F.col("key").alias("token"))


@query(f"WITH {_N}, p AS (SELECT country, id, doc_id, unnest(nt) AS k FROM t) SELECT country, id, k AS token FROM (SELECT *, row_number() OVER (PARTITION BY country, k ORDER BY doc_id, id) AS rn FROM p) WHERE rn <= 60")
def q_cap_first_n(spark, sf):
    first = Channel("name", "name_tokens", 60, "first")
    return blocking.capped(blocking.postings(records(spark, sf), [first]), [first]).select("country", "id", F.col("key").alias("token"))


_UNION = f"{_NAME}, {_post('digit', 'list_distinct(nums)', 40, 2)}, {_post('exact', '[cn]', 150, 3)}"
_THREE = (NAME, Channel("digit", "digits", 40, least=2), Channel("exact", "clean_name", 150, least=3, weight=2))


@query(f"WITH {_UNION} SELECT s1, cid FROM c_name UNION SELECT s1, cid FROM c_digit UNION SELECT s1, cid FROM c_exact")
def q_channel_union(spark, sf):
    return blocked(spark, sf, *_THREE).select("s1", "cid")


@query(f"WITH {_UNION} SELECT s1, cid, CAST(sum(w) AS INTEGER) AS provenance FROM (SELECT s1, cid, 1 AS w FROM c_name UNION ALL SELECT s1, cid, 1 FROM c_digit UNION ALL SELECT s1, cid, 2 FROM c_exact) GROUP BY s1, cid")
def q_provenance(spark, sf):
    return blocked(spark, sf, *_THREE).select("s1", "cid", "provenance")


def _prelim(kind: str, formula: str) -> None:
    def run(spark, sf):
        return pairs(spark, sf, *scoring.RANKING[kind]).select("s1", "cid", r6(scoring.prelim(kind) + 1e-9).alias("score"))

    run.__name__ = f"q_prelim_{kind}"
    nj, aj = _JAC.format("x.nt", "y.nt", "0.0"), _JAC.format("x.ats", "y.ats", "0.0")
    known, hit = "(len(x.nums) > 0 AND len(y.nums) > 0)", "len(list_intersect(x.nums, y.nums)) > 0"
    body = formula.format(nj=nj, aj=aj, known=known, hit=hit, alike="(CASE WHEN x.al <> '' AND x.al = y.al THEN 1.0 ELSE 0.0 END)")
    al = f"al AS (SELECT t.*, regexp_replace({_strip_sql('sn')}, '[^a-z0-9]', '', 'g') AS al FROM (SELECT t.*, {_SPACED.format('e.name')} AS sn FROM t JOIN e USING (id)) t)"
    query(f"WITH {_NAME}, {al} SELECT c.s1, c.cid, round({body} + 1e-9, 6) AS score FROM c_name c JOIN al x ON x.id = c.s1 JOIN al y ON y.id = c.cid")(run)


def _strip_sql(c: str) -> str:
    from weftlink.functions import fixed

    for s in sorted(fixed.LEGAL_SUFFIXES, key=len, reverse=True):
        c = f"trim(regexp_replace({c}, '(^| ){s}$', ''), ' ')"
    return c


_prelim("p1", "0.65 * {nj} + 0.25 * (CASE WHEN NOT {known} THEN 0.2 WHEN {hit} THEN 1.0 ELSE -0.5 END) + least(0.3, 0.1 * 1)")
_prelim("p2", "0.75 * {nj} + 0.25 * (CASE WHEN NOT {known} THEN 0.2 WHEN {hit} THEN 0.5 ELSE 0.0 END)")
_prelim("p3", "5.0 * {alike} + 3.0 * {nj} + 2.0 * {aj} + 2.0 * (CASE WHEN {known} AND {hit} THEN 1.0 ELSE 0.0 END)")
_prelim("p5", "0.7 * {nj} + 0.3 * (CASE WHEN NOT {known} THEN 0.3 WHEN {hit} THEN 1.0 ELSE 0.0 END)")


@query(f"WITH {_SCORED}, {_TRUTH}, k AS (SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM scored), h AS (SELECT k.*, t.cid IS NOT NULL AS hit FROM k LEFT JOIN truth t USING (s1, cid)), ks AS (SELECT unnest([1, 5, 10, 25, 50]) AS k) SELECT ks.k, (SELECT count(*) FROM h WHERE rn <= ks.k) AS pairs, (SELECT count(*) FROM h WHERE rn <= ks.k AND hit) AS hits, (SELECT count(*) FROM h WHERE rn <= ks.k AND hit) / greatest((SELECT count(*) FROM truth), 1) AS pair_recall FROM ks")
def q_k_sweep(spark, sf):
    s = scored(spark, sf).withColumn("score", r6("score"))
    return metrics.k_sweep(spine(spark, sf), blocking.ranked(s, None, "score"), truth(spark, sf), [1, 5, 10, 25, 50])


# Similarities ------------------------------------------------------------------------


def _similar(name: str, field: str, column: Callable[[], Column], sql: str | None) -> None:
    def run(spark, sf):
        return pairs(spark, sf, field).select("s1", "cid", r6(column()).alias("sim"))

    run.__name__ = f"q_{name}"
    query(f"WITH {_NAME} SELECT c.s1, c.cid, round({sql}, 6) AS sim FROM c_name c JOIN t x ON x.id = c.s1 JOIN t y ON y.id = c.cid" if sql else None)(run)


def _ng(c: str, n: int) -> str:
    s = f"replace({c}.cn, ' ', '')"
    return f"list_distinct(list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: substr({s}, i, {n})))"


_both = "len(list_intersect(x.nt, y.nt))"
_similar("sim_jaccard", "name_tokens", lambda: S.jaccard(*scoring.side("name_tokens")), _JAC.format("x.nt", "y.nt", "1.0"))
_similar("sim_containment", "name_tokens", lambda: S.containment(*scoring.side("name_tokens")), f"CASE WHEN len(x.nt) = 0 OR len(y.nt) = 0 THEN 0.0 ELSE CAST({_both} AS DOUBLE) / least(len(x.nt), len(y.nt)) END")
_similar("sim_dice", "name_tokens", lambda: S.set_dice(*scoring.side("name_tokens")), f"CASE WHEN x.cn = '' OR y.cn = '' THEN 0.0 WHEN list_sort({_WORDS.format('x.cn')}) = list_sort({_WORDS.format('y.cn')}) THEN 1.0 ELSE 2.0 * {_both} / (len(x.nt) + len(y.nt)) END")
_similar("sim_levenshtein", "clean_name", lambda: S.levenshtein_share(*scoring.side("clean_name")), "CASE WHEN x.cn = y.cn THEN 1.0 WHEN x.cn = '' OR y.cn = '' THEN 0.0 WHEN abs(length(x.cn) - length(y.cn)) / greatest(length(x.cn), length(y.cn)) > 0.4 THEN 0.0 ELSE greatest(0.0, 1.0 - levenshtein(left(x.cn, 100), left(y.cn, 100)) / greatest(length(left(x.cn, 100)), length(left(y.cn, 100)))) END")
_similar("sim_ngram", "ng3", lambda: S.jaccard(*scoring.side("ng3")), None)
# Grams once for each record; shared ones are counted by a join, not by lists for each pair.
SQL["sim_ngram"] = f"WITH {_NAME}, gr AS (SELECT id, {_ng('t', 3)} AS g FROM t), n3 AS (SELECT id, len(g) AS n FROM gr), ex AS (SELECT id, unnest(g) AS k FROM gr), sh AS (SELECT c.s1, c.cid, count(*) AS m FROM c_name c JOIN ex a ON a.id = c.s1 JOIN ex b ON b.id = c.cid AND b.k = a.k GROUP BY 1, 2) SELECT c.s1, c.cid, round(CASE WHEN x.n = 0 AND y.n = 0 THEN 1.0 WHEN x.n = 0 OR y.n = 0 THEN 0.0 ELSE CAST(coalesce(m, 0) AS DOUBLE) / (x.n + y.n - coalesce(m, 0)) END, 6) AS sim FROM c_name c JOIN n3 x ON x.id = c.s1 JOIN n3 y ON y.id = c.cid LEFT JOIN sh ON sh.s1 = c.s1 AND sh.cid = c.cid"
_similar("sim_digits", "digits", lambda: S.jaccard(*scoring.side("digits"), one=0.5), "CASE WHEN len(x.nums) = 0 AND len(y.nums) = 0 THEN 1.0 WHEN len(x.nums) = 0 OR len(y.nums) = 0 THEN 0.5 ELSE CAST(len(list_intersect(x.nums, y.nums)) AS DOUBLE) / len(list_distinct(list_concat(x.nums, y.nums))) END")
_similar("sim_prefix", "clean_name", lambda: S.prefix_share(*scoring.side("clean_name")), "CASE WHEN least(length(x.cn), length(y.cn)) = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, least(length(x.cn), length(y.cn), 4) + 1), lambda i: CASE WHEN substr(x.cn, i, 1) = substr(y.cn, i, 1) THEN 1.0 ELSE 0.0 END)) / least(length(x.cn), length(y.cn), 4) END")
_similar("sim_jaro_winkler", "clean_name", lambda: udfs.jaro_winkler(F.col("l.clean_name"), F.col("r.clean_name"), 40, "any"), None)


@query()
def q_sim_lcs(spark, sf):
    p = halves(records(spark, sf), ["clean_name"]).select("s1", "cid", r6(udfs.lcs_ratio(*scoring.side("clean_name"))).alias("sim"))
    back = F.struct(F.col("cid").alias("s1"), F.col("s1").alias("cid"))
    return p.select(F.explode(F.array(F.struct("s1", "cid"), back)).alias("_d"), "sim").select("_d.*", "sim")


@query()
def q_sim_monge_elkan(spark, sf):
    return spread(records(spark, sf), ["id", "clean_name"]).select("s1", "cid", r6(udfs.monge_elkan(*scoring.side("clean_name"))).alias("sim"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def q_sim_cosine_emb(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", r6(S.cosine(F.col("x"), F.col("y"))).alias("cosine"))


@query()
def q_nfkd_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(udfs.fold_accents(F.col("text")), 256).alias("folded_sha256"))


# Features and presets -----------------------------------------------------------------


@query()
def q_features_28d(spark, sf):
    r = features.worded(records(spark, sf, "joined"))
    return features.extract_both(halves(r, features.SHORT)).select("s1", "cid", *(r6(n).alias(n) for n in features.NAMES))


@query()
def q_features_core(spark, sf):
    r = records(spark, sf, "contracting")
    return features.extract(spread(r, features.FIELDS["core"], ("name_tokens",)), "core").select("s1", "cid", *(r6(n).alias(n) for n in features.NAMES))


def _match(preset: str) -> None:
    def run(spark, sf):
        e = entities(spark, sf)
        return resolving.resolve(e, e, preset).select("s1", "cid", r6("score").alias("score"))

    run.__name__ = f"q_match_{preset}"
    query()(run)


for _name in ("champion", "reproduce_0793", "phase5", "phase8", "phase8b", "phase9", "phase9b", "production", "phase10", "phase10b", "phase16", "argmax", "optimised", "strict"):
    _match(_name)


# Selections ------------------------------------------------------------------------------


@query(f"WITH {_SCORED}, w AS (SELECT s1, cid, round(score, 6) AS score, row_number() OVER (PARTITION BY cid ORDER BY round(score, 6) DESC, s1) AS rn FROM scored WHERE round(score, 6) >= 0.5) SELECT s1, cid, score FROM w WHERE rn = 1 AND score >= 0.6")
def q_argmax_assign(spark, sf):
    return scoring.argmax_assignment(scored(spark, sf).withColumn("score", r6("score")), 0.5, 0.6)


@query(f"WITH {_SCORED}, w AS (SELECT s1, cid, round(score, 6) AS score, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM scored), b AS (SELECT s1, max(score) AS top, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS second FROM w GROUP BY s1) SELECT s1, cid, score FROM w JOIN b USING (s1) WHERE score >= 0.4 AND (top >= 0.8 OR top - second >= 0.1)")
def q_margin_guard(spark, sf):
    return scoring.margin_guard(scored(spark, sf).withColumn("score", r6("score")), 0.1, 0.8, 0.4)


@query(f"WITH {_SCORED}, w AS (SELECT s1, cid, round(score, 6) AS score, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn, max(round(score, 6)) OVER (PARTITION BY s1) AS top FROM scored) SELECT s1, cid, score FROM w WHERE ((rn = 1 AND score >= 0.6) OR (rn > 1 AND score >= 0.52 AND top - score < 0.12)) AND rn <= 10")
def q_margin_competition(spark, sf):
    return scoring.margin_competition(scored(spark, sf).withColumn("score", r6("score")))


@query(f"WITH {_SCORED} SELECT s1, cid, score, CAST(rn AS INTEGER) AS rn FROM (SELECT s1, cid, round(score, 6) AS score, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM accepted) WHERE rn <= 10")
def q_cardinality_cap(spark, sf):
    return scoring.cardinality_cap(accepted(spark, sf).withColumn("score", r6("score")), 10)


# Evaluation ------------------------------------------------------------------------------


@query(f"WITH {_SCORED}, {_TRUTH}, {_COUNTS} SELECT s1, n_pred, n_true, tp, round(f05, 6) AS f05 FROM f")
def q_entity_f05(spark, sf):
    n = metrics.counts(spine(spark, sf), accepted(spark, sf), truth(spark, sf))
    return metrics.entity_f05(n).select("s1", "n_pred", "n_true", "tp", r6("f05").alias("f05"))


@query(f"WITH {_SCORED}, {_TRUTH}, {_COUNTS} SELECT count(*) AS n_entities, round(avg(f05), 6) AS macro_f05, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(coalesce(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS singleton_accuracy, count(*) FILTER (n_true = 0 AND n_pred > 0) AS false_merges, count(*) FILTER (n_true > 0 AND n_pred = 0) AS missed_matches, CAST(sum(n_pred - tp) AS BIGINT) AS false_pairs, CAST(sum(n_true - tp) AS BIGINT) AS missed_pairs FROM f")
def q_macro_metrics(spark, sf):
    m = metrics.macro(spine(spark, sf), accepted(spark, sf), truth(spark, sf))
    return m.select("n_entities", *(r6(c).alias(c) for c in ("macro_f05", "precision", "recall", "singleton_accuracy")), "false_merges", "missed_matches", "false_pairs", "missed_pairs")


@query(f"WITH {_SCORED}, {_TRUTH}, cand AS (SELECT s1, count(*) AS n FROM c_name GROUP BY s1), hit AS (SELECT s1, count(*) AS tp FROM c_name JOIN truth USING (s1, cid) GROUP BY s1), tr AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1), sp AS (SELECT CAST(doc_id AS VARCHAR) AS s1 FROM documents), a AS (SELECT sp.s1, coalesce(n, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM sp LEFT JOIN cand USING (s1) LEFT JOIN hit USING (s1) LEFT JOIN tr USING (s1)) SELECT round(sum(tp) / greatest(sum(n_true), 1), 6) AS pair_recall, round(avg(CASE WHEN n_true > 0 THEN CASE WHEN tp = n_true THEN 1.0 ELSE 0.0 END END), 6) AS perfect_recall, round(avg(CASE WHEN n_true > 0 THEN CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END END), 6) AS hit_recall, round(avg(n_pred), 6) AS mean_candidates, round(quantile_cont(n_pred, 0.5), 6) AS median_candidates, max(n_pred) AS most_candidates, count(*) FILTER (n_true = 0 AND n_pred > 0) AS singletons_with_candidates, round(1.0 - sum(n_pred) / (count(*) * (SELECT count(*) FROM documents)), 6) AS reduction_ratio FROM a")
def q_blocking_recall(spark, sf):
    s = spine(spark, sf)
    b = metrics.blocking_quality(s, s, blocked(spark, sf), truth(spark, sf))
    return b.select(*(r6(c).alias(c) for c in ("pair_recall", "perfect_recall", "hit_recall", "mean_candidates", "median_candidates")), "most_candidates", "singletons_with_candidates", r6("reduction_ratio").alias("reduction_ratio"))


@query(f"WITH {_UNION}, {_TRUTH}, h AS (SELECT 'name' AS channel, count(*) AS hits FROM c_name JOIN truth USING (s1, cid) UNION ALL SELECT 'digit', count(*) FROM c_digit JOIN truth USING (s1, cid) UNION ALL SELECT 'exact', count(*) FROM c_exact JOIN truth USING (s1, cid) UNION ALL SELECT 'all', count(*) FROM (SELECT s1, cid FROM c_name UNION SELECT s1, cid FROM c_digit UNION SELECT s1, cid FROM c_exact) JOIN truth USING (s1, cid)) SELECT channel, hits, round(hits / greatest((SELECT count(*) FROM truth), 1), 6) AS recall FROM h WHERE hits > 0 OR channel = 'all'")
def q_channel_recall(spark, sf):
    return metrics.channel_recall(blocked(spark, sf, *_THREE), truth(spark, sf)).select("channel", "hits", r6("recall").alias("recall"))


_CURVE = "tr AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1), sp AS (SELECT CAST(doc_id AS VARCHAR) AS s1 FROM documents), pr AS (SELECT g.*, s.s1, count(*) AS n_pred, count(x.cid) AS tp FROM g JOIN scored s ON {keep} LEFT JOIN truth x ON x.s1 = s.s1 AND x.cid = s.cid GROUP BY ALL), a AS (SELECT g.*, sp.s1, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM g CROSS JOIN sp LEFT JOIN pr ON pr.s1 = sp.s1 AND {same} LEFT JOIN tr ON tr.s1 = sp.s1), f AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * tp / n_pred + tp / n_true) END AS f05, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 WHEN n_pred = 0 THEN 1.0 ELSE tp / n_pred END AS p, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_true END AS r FROM a)"
_FIGURES = "round(avg(f05), 6) AS macro_f05, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END END), 6) AS singleton_accuracy"
_TAUS = tuning.steps(0.05, 0.99, 0.01)
#: A grid of 140 settings, as the last tuning of the champion has.
_GRID = (tuning.steps(0.48, 0.60, 0.02), tuning.steps(0.70, 0.85, 0.05), tuning.steps(0.14, 0.30, 0.04))


@query(f"WITH {_SCORED}, {_TRUTH}, g AS (SELECT unnest({_TAUS}::DOUBLE[]) AS tau), {_CURVE.format(keep='s.score >= g.tau', same='pr.tau = g.tau')} SELECT CAST(tau AS DOUBLE) AS tau, {_FIGURES} FROM f GROUP BY tau")
def q_threshold_curve(spark, sf):
    c = tuning.threshold_curve(spine(spark, sf), scored(spark, sf), truth(spark, sf), _TAUS)
    return c.select("tau", *(r6(x).alias(x) for x in c.columns[1:]))


@query(f"WITH {_SCORED}, {_TRUTH}, g AS (SELECT * FROM (SELECT unnest({_GRID[0]}::DOUBLE[]) AS tau), (SELECT unnest({_GRID[1]}::DOUBLE[]) AS high), (SELECT unnest({_GRID[2]}::DOUBLE[]) AS floor)), scored2 AS (SELECT s.s1, s.cid, s.score, {_JAC.format('x.ats', 'y.ats', '1.0')} AS address FROM scored s JOIN t x ON x.id = s.s1 JOIN t y ON y.id = s.cid), {_CURVE.replace('JOIN scored s', 'JOIN scored2 s').format(keep='(s.score >= g.high OR (s.score >= g.tau AND s.address >= g.floor))', same='pr.tau = g.tau AND pr.high = g.high AND pr.floor = g.floor')} SELECT CAST(tau AS DOUBLE) AS tau, CAST(high AS DOUBLE) AS high, CAST(floor AS DOUBLE) AS floor, {_FIGURES} FROM f GROUP BY tau, high, floor")
def q_grid_search(spark, sf):
    s = pairs(spark, sf, "name_tokens", "addr_tokens").select("s1", "cid", S.jaccard(*scoring.side("name_tokens")).alias("score"), scoring.address_similarity("raw").alias("address"))
    c = tuning.tiered_grid(spine(spark, sf), s, truth(spark, sf), *_GRID)
    return c.select("tau", "high", "floor", *(r6(x).alias(x) for x in c.columns[3:]))


@query(SQL["threshold_curve"].replace(str(_TAUS), str(tuning.steps(0.20, 0.96, 0.02))).replace("SELECT CAST(tau", "SELECT * FROM (SELECT CAST(tau") + ") ORDER BY macro_f05 DESC, tau LIMIT 1")
def q_best_threshold(spark, sf):
    c = tuning.threshold_curve(spine(spark, sf), scored(spark, sf), truth(spark, sf), tuning.steps(0.20, 0.96, 0.02))
    return tuning.best(c.select("tau", *(r6(x).alias(x) for x in c.columns[1:])), ["tau"])


# Samples, training, validation -------------------------------------------------------------


@query("SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS INTEGER) AS bucket, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 >= 80 THEN 'validation' ELSE 'train' END AS split FROM documents")
def q_hash_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"))
    return sampling.hash_split(d, "k").select("doc_id", "bucket", "split")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS size FROM orders GROUP BY ALL")
def q_stratum_sizes(spark, sf):
    return sampling.quotas(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], 500).select("o_orderpriority", "o_orderstatus", "size")


@query("WITH z AS (SELECT o_orderpriority, o_orderstatus, count(*) AS size FROM orders GROUP BY ALL), r AS (SELECT *, CAST(greatest(1, round_even(500 * size / (SELECT sum(size) FROM z), 0)) AS BIGINT) AS raw, row_number() OVER (ORDER BY size DESC, o_orderpriority, o_orderstatus) - 1 AS rn FROM z), g AS (SELECT *, 500 - (SELECT sum(raw) FROM r) AS off, (SELECT count(*) FROM r) AS strata FROM r) SELECT o_orderpriority, o_orderstatus, CAST(least(size, greatest(0, raw + sign(off) * (floor(abs(off) / strata) + CASE WHEN rn < abs(off) % strata THEN 1 ELSE 0 END))) AS BIGINT) AS quota FROM g")
def q_stratified_quota(spark, sf):
    return sampling.quotas(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], 500).select("o_orderpriority", "o_orderstatus", "quota")


@query("WITH p AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS place FROM documents) SELECT doc_id, lang, CASE WHEN place >= 0.85 THEN 'test' WHEN place >= 0.7 THEN 'validation' ELSE 'train' END AS split FROM p")
def q_stratified_split(spark, sf):
    return sampling.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", ["lang"], {"train": 0.7, "validation": 0.15, "test": 0.15})


@query(f"WITH {_SCORED}, {_TRUTH}, k AS (SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM scored), m AS (SELECT k.*, CASE WHEN x.cid IS NULL THEN 0 ELSE 1 END AS label FROM k LEFT JOIN truth x USING (s1, cid)), w AS (SELECT *, sum(label) OVER (PARTITION BY s1) AS tr, row_number() OVER (PARTITION BY s1 ORDER BY label, rn, cid) AS nth FROM m WHERE rn <= 50) SELECT s1, cid, CAST(label AS INTEGER) AS label FROM w WHERE label = 1 OR nth <= greatest(4 * tr, 2)")
def q_train_pairs(spark, sf):
    s = blocking.ranked(scored(spark, sf).withColumn("score", r6("score")), 50, "score")
    return training_pairs(s, truth(spark, sf))


def _files(spark, sf) -> DataFrame:
    return writers.id_lists(spine(spark, sf), accepted(spark, sf).withColumn("score", r6("score")))


_LISTS = "lists AS (SELECT CAST(d.doc_id AS VARCHAR) AS source1_entity_id, coalesce((SELECT string_agg(cid, ',' ORDER BY round(score, 6) DESC, cid) FROM accepted a WHERE a.s1 = CAST(d.doc_id AS VARCHAR)), '') AS matched_entity_ids FROM documents d)"


@query(f"WITH {_SCORED}, {_LISTS} SELECT * FROM lists")
def q_matching_results_tsv(spark, sf):
    return _files(spark, sf).drop("row_idx")


_SHOP_LISTS = "SELECT 'S1-' || c_custkey AS source1_entity_id, 'S2-' || c_nationkey || ', ' || CASE c_custkey % 5 WHEN 0 THEN 'S1-' || c_custkey WHEN 1 THEN 'X9-1' WHEN 2 THEN '' ELSE 'S3-' || c_custkey END AS matched_entity_ids FROM customer"


@query(f"WITH l AS ({_SHOP_LISTS}), x AS (SELECT source1_entity_id, trim(unnest(string_split(matched_entity_ids, ','))) AS cid FROM l), v AS (SELECT DISTINCT 'S3-' || c_custkey AS cid FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT 'S2-' || c_nationkey FROM customer), p AS (SELECT source1_entity_id, cid, CASE WHEN cid LIKE 'S1-%' THEN 'self match' WHEN cid NOT LIKE 'S2-%' AND cid NOT LIKE 'S3-%' THEN 'wrong prefix' WHEN cid NOT IN (SELECT cid FROM v) THEN 'unknown id' END AS problem FROM x WHERE cid <> '') SELECT * FROM p WHERE problem IS NOT NULL")
def q_validate_prefix(spark, sf):
    c = table(spark, sf, "customer")
    valid = c.where("c_custkey % 2 = 0").selectExpr("'S3-' || c_custkey AS cid").union(c.selectExpr("'S2-' || c_nationkey"))
    return validate.bad_ids(spark.sql(_SHOP_LISTS.replace("FROM customer", "FROM {c}"), c=c), "source1_entity_id", "matched_entity_ids", valid)


@query(f"WITH {_SCORED}, {_LISTS}, twice AS (SELECT source1_entity_id, matched_entity_ids || ',' || matched_entity_ids AS l FROM lists), c AS (SELECT source1_entity_id, list_filter(string_split(l, ','), lambda x: x <> '') AS ids FROM twice) SELECT source1_entity_id, CAST(len(ids) - len(list_distinct(ids)) AS INTEGER) AS extra FROM c WHERE len(ids) > len(list_distinct(ids))")
def q_validate_dups(spark, sf):
    twice = _files(spark, sf).withColumn("matched_entity_ids", F.concat_ws(",", "matched_entity_ids", "matched_entity_ids"))
    return validate.duplicate_ids(twice, "source1_entity_id", "matched_entity_ids")


#: A result file that misses some customers and names some that are none.
_SHIFTED = "SELECT o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1000000 ELSE 0 END AS c_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 0"


def _shifted(spark, sf) -> DataFrame:
    return spark.sql(_SHIFTED.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))


@query(f"SELECT DISTINCT c_custkey FROM ({_SHIFTED}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def q_validate_extra(spark, sf):
    return validate.extra(_shifted(spark, sf), table(spark, sf, "customer"), "c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_SHIFTED}))")
def q_validate_missing(spark, sf):
    return validate.missing(_shifted(spark, sf), table(spark, sf, "customer"), "c_custkey")


@query(f"WITH {_SCORED}, k AS (SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM scored) SELECT s1, cid FROM accepted EXCEPT SELECT s1, cid FROM k WHERE rn <= 3")
def q_validate_subset(spark, sf):
    s = scored(spark, sf).withColumn("score", r6("score"))
    return validate.not_candidates(accepted(spark, sf), blocking.ranked(s, 3, "score"))


# Diagnostics -------------------------------------------------------------------------------


@query(f"WITH {_SCORED}, {_TRUTH}, k AS (SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cid) AS rn FROM scored), s AS (SELECT CASE WHEN a.s1 IS NOT NULL THEN 'accepted' WHEN c.s1 IS NULL THEN 'not blocked' WHEN k.s1 IS NULL THEN 'pruned' WHEN c.score < 0.5 THEN 'below threshold' ELSE 'address floor' END AS stage FROM truth t LEFT JOIN scored c USING (s1, cid) LEFT JOIN (SELECT * FROM k WHERE rn <= 5) k USING (s1, cid) LEFT JOIN (SELECT a.* FROM accepted a JOIN k USING (s1, cid) WHERE rn <= 5) a USING (s1, cid)) SELECT stage, count(*) AS n, round(count(*) / (SELECT count(*) FROM truth), 6) AS share FROM s GROUP BY stage")
def q_error_stages(spark, sf):
    s = scored(spark, sf)
    kept = blocking.ranked(s.withColumn("score", r6("score")), 5, "score")
    out = diagnostics.failure_stages(truth(spark, sf), s, kept, s, kept.where("score >= 0.5"), 0.5)
    return out.select("stage", "n", r6("share").alias("share"))


@query(f"WITH {_SCORED}, {_TRUTH}, {_COUNTS} SELECT round(avg(n_pred), 6) AS mean, round(quantile_cont(n_pred, 0.5), 6) AS median, round(quantile_cont(n_pred, 0.75), 6) AS p75, round(quantile_cont(n_pred, 0.9), 6) AS p90, round(quantile_cont(n_pred, 0.95), 6) AS p95, round(quantile_cont(n_pred, 0.99), 6) AS p99, max(n_pred) AS most, round(avg(CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_empty, round(avg(CASE WHEN n_pred >= 5 THEN 1.0 ELSE 0.0 END), 6) AS share_5, round(avg(CASE WHEN n_pred >= 10 THEN 1.0 ELSE 0.0 END), 6) AS share_10, count(*) FILTER (n_pred >= 20) AS n_20 FROM cnt")
def q_cardinality_stats(spark, sf):
    c = metrics.cardinality(metrics.counts(spine(spark, sf), accepted(spark, sf), truth(spark, sf)))
    return c.select(*(c_ if c_ in ("most", "n_20") else r6(c_).alias(c_) for c_ in c.columns))


@query(f"WITH {_TRUTH}, n AS (SELECT d.doc_id, (SELECT count(*) FROM truth t WHERE t.s1 = CAST(d.doc_id AS VARCHAR)) AS matches FROM documents d) SELECT matches, count(*) AS entities FROM n GROUP BY matches ORDER BY matches LIMIT 15")
def q_match_histogram(spark, sf):
    return diagnostics.match_histogram(spine(spark, sf), truth(spark, sf))


@query(f"WITH {_SCORED}, {_TRUTH} SELECT s1, cid, 'false' AS error, CAST(1 AS BIGINT) AS n FROM (SELECT s1, cid FROM accepted EXCEPT SELECT s1, cid FROM truth) UNION ALL SELECT s1, NULL, 'missed', count(*) FROM (SELECT s1, cid FROM truth EXCEPT SELECT s1, cid FROM accepted) GROUP BY s1")
def q_wrong_pairs(spark, sf):
    return diagnostics.wrong_pairs(accepted(spark, sf), truth(spark, sf))


@query(f"WITH {_SCORED}, {_TRUTH}, lone AS (SELECT s1, cid, round(score, 6) AS score FROM accepted WHERE s1 NOT IN (SELECT s1 FROM truth)) SELECT s1, cid, score FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid DESC) AS rn FROM lone) WHERE rn = 1")
def q_singleton_errors(spark, sf):
    return diagnostics.singleton_errors(accepted(spark, sf).withColumn("score", r6("score")), truth(spark, sf))


@query("SELECT * FROM customer WHERE c_custkey = 42")
def q_entity_lookup(spark, sf):
    return readers.entity([table(spark, sf, "customer").withColumn("k", F.col("c_custkey").cast("string"))], "42", "k").drop("k")


@query()
def q_gbt_match(spark, sf):
    """All candidates predicted by 250 trees of depth 6; fitted, as the reference does, on the true pairs and the first negatives of the training records (split by the hash of their ids)."""
    r = features.worded(records(spark, sf, "joined")).join(truth(spark, sf), "id")
    p = halves(r, [*features.SHORT, "class"])
    label = F.coalesce(F.col("l.class") == F.col("r.class"), F.lit(False)).cast("int")
    data = scratch.saved(features.extract_both(p.withColumn("label", label), ["label"]), "features")  # read by the fit and by the prediction
    by_id = blocking.ranked(sampling.hash_split(data.select("s1", "cid"), "s1").where("split = 'train'"), None, None)
    fit = data.join(training_pairs(by_id, data.where("label = 1").select("s1", "cid")).select("s1", "cid"), ["s1", "cid"])
    model = Matcher.fit(fit, rounds=250, depth=6, step=0.05, positive_weight=1.2)
    out = model.predict(data).select("s1", "cid", "label", r6("p").alias("p")).where("p >= 0.5")
    return sampling.hash_split(out, "s1").drop("bucket")


@query()
def q_feature_audit(spark, sf):
    return features.audit(q_features_28d(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from weftlink.plans import more  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from weftlink.plans import more  # noqa: F401

    return dict(SQL)
