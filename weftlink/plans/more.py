"""Further registered queries: readers and writers, normalisers, channels, selections and samples that the main catalogue leaves out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import fixed, text
from weftlink.functions import similarity as S
from weftlink.operators import blocking, diagnostics, features, metrics, model, sampling, scoring, tuning, validate
from weftlink.plans.normalise import normalised
from weftlink.plans.presets import Channel
from weftlink.plans.queries import (
    _CURVE, _E2, _FIGURES, _JAC, _N, _N2, _NAME, _SCORED, _SHOP_ID, _SHOP_LISTS, _SPACED, _TRUTH, _WORDS,
    NAME, _post, _prelim, _strip_sql, accepted, query, r6, records, scored, shops, spine, table, truth,
)
from weftlink.sources import readers, scratch, writers


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Normalisers and tokens ------------------------------------------------------------


@query(f"WITH e AS (SELECT doc_id, {_SPACED.format(chr(34) + 'text' + chr(34))} AS t FROM documents), {_E2.replace('e AS', 'e2 AS')} SELECT id, regexp_replace({_strip_sql('sn')}, '[^a-z0-9]', '', 'g') AS alpha FROM (SELECT id, {_SPACED.format('name')} AS sn FROM e2)")
def q_alpha_stripped(spark, sf):
    return shops(spark, sf).select(F.col("entity_id").alias("id"), text.alpha_stripped("business_name").alias("alpha"))


@query(f"WITH {_N}, w AS (SELECT id, list_filter({_WORDS.format('cn')}, lambda x: NOT list_contains({_list(fixed.LEGAL_STOPWORDS)}, x) AND length(x) >= 3) AS l FROM n) SELECT id, l AS long_tokens, list_sort(list_distinct(l)) AS content_tokens FROM w")
def q_content_tokens(spark, sf):
    r = records(spark, sf)
    return r.select("id", text.long_tokens(F.col("clean_name")).alias("long_tokens"), F.array_sort("content_tokens").alias("content_tokens"))


_GENERIC = sorted({*fixed.GENERIC_ADDRESS, *fixed.US_STATES, *fixed.US_STATES.values(), *fixed.INDIA_STATES, *fixed.INDIA_STATES.values(), *fixed.SHORT_STOPWORDS})


@query(f"WITH {_N2} SELECT id, list_sort(list_filter(ats, lambda x: NOT list_contains({_list(_GENERIC)}, x) AND length(x) >= 3)) AS specific FROM t")
def q_specific_tokens(spark, sf):
    return normalised(shops(spark, sf), "plain").select("id", F.array_sort("specific").alias("specific"))


@query(f"WITH {_N2} SELECT id, list_sort(list_filter(list_distinct({_WORDS.format('cn')}), lambda x: NOT list_contains({_list(fixed.NAME_ARTICLES)}, x))) AS tokens FROM t")
def q_tokens_without_articles(spark, sf):
    r = normalised(shops(spark, sf), "plain")
    return r.select("id", F.array_sort(text.name_tokens(F.col("clean_name"))).alias("tokens"))


@query(f"WITH {_N2} SELECT id, regexp_extract(ca, '^(\\d+)\\b', 1) AS leading, coalesce(nums[1], '') AS first, CASE WHEN length(coalesce(nums[1], '')) <= 4 THEN coalesce(nums[1], '') ELSE '' END AS first_short FROM t")
def q_first_numbers(spark, sf):
    c = F.col("clean_addr")
    return normalised(shops(spark, sf), "plain").select("id", text.leading_number(c).alias("leading"), text.first_number(c).alias("first"), text.first_number(c, 4).alias("first_short"))


def _states(states: dict[str, str], unsure: list[str], words: str) -> str:
    sure = _list(sorted(set(states.values()) - set(unsure)))
    named = " ".join(f"WHEN regexp_matches(ca, '\\b{n}\\b') THEN '{c}'" for n, c in states.items())
    return f"coalesce(CASE {named} END, list_filter({words}, lambda x: list_contains({sure}, x))[-1])"


_TWO = "regexp_extract_all(ca, '\\b([a-z]{2})\\b', 1)"


@query(f"WITH {_N2} SELECT id, coalesce(CASE country WHEN 'US' THEN {_states(fixed.US_STATES, fixed.UNSURE_US, _TWO)} WHEN 'India' THEN {_states(fixed.INDIA_STATES, fixed.UNSURE_INDIA, _TWO)} END, '') AS state FROM n")
def q_state_first(spark, sf):
    return normalised(shops(spark, sf), "plain").select("id", "state")


def _longest(states: dict[str, str], unsure: list[str]) -> str:
    pattern = "|".join(sorted(states, key=len, reverse=True))
    sure = _list(sorted(set(states.values()) - set(unsure)))
    code = "CASE regexp_extract(ca, '\\b(" + pattern + ")\\b', 1) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in states.items()) + " END"
    return f"coalesce({code}, list_filter({_WORDS.format('ca')}, lambda x: list_contains({sure}, x))[-1])"


@query(f"WITH {_N2} SELECT id, coalesce(CASE country WHEN 'US' THEN {_longest(fixed.US_STATES, fixed.UNSURE_US)} WHEN 'India' THEN {_longest(fixed.INDIA_STATES, fixed.UNSURE_INDIA)} END, '') AS state FROM n")
def q_state_longest(spark, sf):
    r = normalised(shops(spark, sf), "plain")
    return r.select("id", text.state_longest(F.col("clean_addr"), F.col("country")).alias("state"))


@query(f"WITH {_N2}, g AS (SELECT id, replace(cn, ' ', '_') AS s FROM n) SELECT id, list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substr(s, i, 3)) AS grams FROM g")
def q_grams_in_order(spark, sf):
    return normalised(shops(spark, sf), "plain").select("id", text.ngrams(F.col("clean_name"), 3).alias("grams"))


# Channels ----------------------------------------------------------------------------


@query(f"WITH {_NAME.split(', p_name AS')[0]}, p AS (SELECT country, id, unnest(nt) AS k FROM t), k AS (SELECT country, k FROM p GROUP BY country, k HAVING count(*) < 50 AND count(*) <= 30) SELECT DISTINCT a.country, a.id AS s1, b.id AS cid FROM p a JOIN k USING (country, k) JOIN p b ON a.country = b.country AND a.k = b.k AND a.id <> b.id")
def q_block_rare(spark, sf):
    r = records(spark, sf)
    return blocking.candidates(r, r, [Channel("rare", "name_tokens", 30, rare=50)]).select("country", "s1", "cid")


@query(f"WITH {_N}, p AS (SELECT country, id, unnest([cn]) AS k FROM t WHERE cn <> ''), k AS (SELECT country, k FROM p GROUP BY country, k HAVING count(*) <= 60) SELECT DISTINCT a.country, a.id AS s1, b.id AS cid FROM p a JOIN k USING (country, k) JOIN p b ON a.country = b.country AND a.k = b.k AND a.id <> b.id")
def q_block_first_key(spark, sf):
    r = records(spark, sf).withColumn("keys", F.array("clean_name", "id"))
    return blocking.candidates(r, r, [Channel("one", "keys", 60, first_keys=1)]).select("country", "s1", "cid")


_ABCD = {"A": ["name"], "B": ["name", "addr"], "C": ["name", "street"], "D": ["name", "addr", "street", "postal"]}
_CHANNELS = f"{_N2}, {_post('name', 'nt')}, {_post('addr', 'ats', 40)}, {_post('street', '''[regexp_extract(ca, '^(\\d+)\\b', 1)]''', 40)}, {_post('postal', '''[coalesce(list_filter(nums, lambda d: length(d) IN (5, 6))[1], '')]''', 30)}"


@query(f"WITH {_CHANNELS} " + " UNION ALL ".join(f"SELECT '{k}' AS strategy, count(*) AS pairs FROM ({' UNION '.join(f'SELECT s1, cid FROM c_{c}' for c in v)})" for k, v in _ABCD.items()))
def q_blocking_strategies(spark, sf):
    r = normalised(shops(spark, sf), "plain")
    out = None
    for name in "ABCD":
        part = blocking.strategy(r, r, name).agg(F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("pairs")).select("strategy", "pairs")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_N}, p AS (SELECT 'name' AS channel, 0 AS nth, country, id, unnest(nt) AS k FROM t UNION ALL SELECT 'address', 1, country, id, unnest(ats) FROM t), z AS (SELECT channel, nth, country, k, count(*) AS df FROM p WHERE k <> '' GROUP BY ALL HAVING count(*) <= CASE channel WHEN 'name' THEN 60 ELSE 40 END), s AS (SELECT p.*, df, coalesce(sum(df) OVER (PARTITION BY id ORDER BY nth, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM p JOIN z USING (channel, nth, country, k)) SELECT DISTINCT s.country, s.id AS s1, p.id AS cid FROM s JOIN p ON p.channel = s.channel AND p.country = s.country AND p.k = s.k WHERE seen < CASE s.channel WHEN 'name' THEN 50 ELSE 20 END AND s.id <> p.id")
def q_block_early_stop(spark, sf):
    r = records(spark, sf)
    return blocking.early_stopped(r, r, [NAME, Channel("address", "addr_tokens", 40)], {"name": 50, "address": 20})


_prelim("p3b", "5.0 * {alike} + 3.0 * {nj} + 2.0 * {aj} + 2.0 * (CASE WHEN regexp_extract(x.ca, '^(\\d+)\\b', 1) <> '' AND regexp_extract(x.ca, '^(\\d+)\\b', 1) = regexp_extract(y.ca, '^(\\d+)\\b', 1) THEN 1.0 ELSE 0.0 END) + 2.0 * (CASE WHEN list_filter(x.nums, lambda d: length(d) IN (5, 6))[1] = list_filter(y.nums, lambda d: length(d) IN (5, 6))[1] THEN 1.0 ELSE 0.0 END)")
_prelim("p4", "3.0 * len(list_intersect(x.nt, y.nt)) + 2.0 * len(list_intersect(x.ats, y.ats)) + 4.0 * (CASE WHEN regexp_extract(x.ca, '^(\\d+)\\b', 1) <> '' AND regexp_extract(x.ca, '^(\\d+)\\b', 1) = regexp_extract(y.ca, '^(\\d+)\\b', 1) THEN 1.0 ELSE 0.0 END) + 10.0 * {alike}")

_FIRST = "p AS (SELECT country, id, doc_id, unnest(nt) AS k FROM t), f AS (SELECT country, id, k FROM (SELECT *, row_number() OVER (PARTITION BY country, k ORDER BY doc_id, id) AS rn FROM p) WHERE rn <= 60), w AS (SELECT country, id, k FROM p QUALIFY count(*) OVER (PARTITION BY country, k) <= 60)"
_FIRST_PAIRS = "cf AS (SELECT DISTINCT p.id AS s1, f.id AS cid FROM p JOIN f ON f.country = p.country AND f.k = p.k AND f.id <> p.id), cw AS (SELECT DISTINCT p.id AS s1, w.id AS cid FROM p JOIN w ON w.country = p.country AND w.k = p.k AND w.id <> p.id)"
_RANKED = "{0} AS (SELECT c.s1, c.cid, row_number() OVER (PARTITION BY s1 ORDER BY {1} cid) AS rn FROM {2} c JOIN t x ON x.id = c.s1 JOIN t y ON y.id = c.cid)"
_BY_JAC = f"round({_JAC.format('x.nt', 'y.nt', '1.0')}, 6) DESC,"


@query(f"WITH {_N}, {_TRUTH}, {_FIRST}, {_FIRST_PAIRS}, {_RANKED.format('r1', _BY_JAC, 'cw')}, {_RANKED.format('r2', _BY_JAC, 'cf')}, {_RANKED.format('r3', '', 'cf')}, h AS (SELECT 'skip' AS mode, * FROM r1 UNION ALL SELECT 'first', * FROM r2 UNION ALL SELECT 'first unordered', * FROM r3), ks AS (SELECT unnest([1, 5, 25]) AS k) SELECT mode, ks.k, count(*) FILTER (rn <= ks.k) AS pairs, count(*) FILTER (rn <= ks.k AND x.cid IS NOT NULL) AS hits, count(*) FILTER (rn <= ks.k AND x.cid IS NOT NULL) / greatest((SELECT count(*) FROM truth), 1) AS pair_recall FROM h LEFT JOIN truth x USING (s1, cid) CROSS JOIN ks GROUP BY mode, ks.k")
def q_retrieval_loss(spark, sf):
    r = records(spark, sf)
    first = Channel("name", "name_tokens", 60, "first")

    def ranked(channel: Channel, by_score: bool) -> DataFrame:
        p = blocking.joined(blocking.candidates(r, r, [channel]), r, r).select("s1", "cid", r6(S.jaccard(*scoring.side("name_tokens"))).alias("prelim"))
        return blocking.ranked(p, None, "prelim" if by_score else None)

    # The unordered mode goes by the candidate's id.
    return diagnostics.retrieval_loss(spine(spark, sf), {"skip": ranked(NAME, True), "first": ranked(first, True), "first unordered": ranked(first, False)}, truth(spark, sf), [1, 5, 25])


# Evaluation ----------------------------------------------------------------------------


_CNT = "sp AS (SELECT CAST(doc_id AS VARCHAR) AS s1 FROM documents), np AS (SELECT s1, count(*) AS n FROM accepted GROUP BY s1), nt_ AS (SELECT s1, count(*) AS n FROM truth GROUP BY s1), h AS (SELECT s1, count(*) AS n FROM accepted JOIN truth USING (s1, cid) GROUP BY s1), cnt AS (SELECT sp.s1, coalesce(np.n, 0) AS n_pred, coalesce(nt_.n, 0) AS n_true, coalesce(h.n, 0) AS tp FROM sp LEFT JOIN np USING (s1) LEFT JOIN nt_ USING (s1) LEFT JOIN h USING (s1))"
_F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * tp / n_pred + tp / n_true) END"
_P = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 WHEN n_pred = 0 THEN 1.0 ELSE tp / n_pred END"
_R = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_true END"
_CONVENTIONS = {
    "default": (_P, _R),
    "one_sided_zero": (f"CASE WHEN (n_pred = 0) <> (n_true = 0) THEN 0.0 ELSE {_P} END", f"CASE WHEN (n_pred = 0) <> (n_true = 0) THEN 0.0 ELSE {_R} END"),
    "non_singletons": ("CASE WHEN n_true > 0 THEN CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END END", "CASE WHEN n_true > 0 THEN tp / n_true END"),
    "predicted": ("CASE WHEN n_true > 0 AND n_pred > 0 THEN tp / n_pred END", "CASE WHEN n_true > 0 THEN tp / n_true END"),
}


@query(f"WITH {_SCORED}, {_TRUTH}, {_CNT} " + " UNION ALL ".join(f"SELECT '{k}' AS convention, round(avg({_F05}), 6) AS macro_f05, round(avg({p}), 6) AS precision, round(avg({r}), 6) AS recall FROM cnt" for k, (p, r) in _CONVENTIONS.items()) + f" UNION ALL SELECT 'over predictions', round(avg({_F05}), 6), round(avg({_P}), 6), round(avg({_R}), 6) FROM cnt WHERE n_pred > 0")
def q_metric_conventions(spark, sf):
    s, a, t = spine(spark, sf), accepted(spark, sf), truth(spark, sf)
    rows = [(k, metrics.macro(s, a, t, k)) for k in _CONVENTIONS] + [("over predictions", metrics.over_predictions(a, t))]
    out = None
    for name, m in rows:
        part = m.select(F.lit(name).alias("convention"), *(r6(c).alias(c) for c in ("macro_f05", "precision", "recall")))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_SCORED}, {_TRUTH}, {_CNT} SELECT s1, n_pred FROM cnt WHERE n_pred >= 2 ORDER BY n_pred DESC, s1 LIMIT 500")
def q_largest_predictions(spark, sf):
    return diagnostics.largest(metrics.counts(spine(spark, sf), accepted(spark, sf), truth(spark, sf)), 2, 500)


_MARGIN = "g AS (SELECT * FROM (SELECT unnest([0.3, 0.4, 0.5]::DOUBLE[]) AS tau), (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS margin), (SELECT unnest([0.75, 0.85]::DOUBLE[]) AS high)), ahead AS (SELECT s1, max(score) AS top, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS second FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid) AS rn FROM scored) GROUP BY s1), scored2 AS (SELECT * FROM scored JOIN ahead USING (s1))"


@query(f"WITH {_SCORED}, {_TRUTH}, {_MARGIN}, {_CURVE.replace('JOIN scored s', 'JOIN scored2 s').format(keep='(s.score >= g.tau AND (s.top >= g.high OR s.top - s.second >= g.margin))', same='pr.tau = g.tau AND pr.margin = g.margin AND pr.high = g.high')} SELECT tau, margin, high, {_FIGURES} FROM f GROUP BY tau, margin, high")
def q_margin_grid(spark, sf):
    c = tuning.margin_grid(spine(spark, sf), scored(spark, sf), truth(spark, sf), [0.3, 0.4, 0.5], [0.05, 0.1], [0.75, 0.85])
    return c.select("tau", "margin", "high", *(r6(x).alias(x) for x in c.columns[3:]))


# Samples and training ----------------------------------------------------------------------


_STRATUM = f"WITH {_E2}, m AS (SELECT *, CASE c % 6 WHEN 0 THEN [] WHEN 1 THEN ['S2-1'] WHEN 2 THEN ['S3-1', 'S3-2'] WHEN 3 THEN ['S2-1', 'S3-9'] ELSE list_transform(range(1, c % 9 + 1), lambda i: 'S2-' || i) END AS matches FROM (SELECT *, doc_id AS c FROM e)), first AS (SELECT regexp_extract({_SPACED.format('name')}, '^\\S+') AS w, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, w LIMIT 3)"


@query(
    _STRATUM
    + f" SELECT id, country, len(matches) = 0 AS singleton, CAST(least(len(matches), 5) AS INTEGER) AS match_bucket, CASE WHEN len(matches) = 0 THEN 'none' WHEN len(list_filter(matches, lambda x: x LIKE 'S2-%')) > 0 AND len(list_filter(matches, lambda x: x LIKE 'S3-%')) > 0 THEN 'both' WHEN len(list_filter(matches, lambda x: x LIKE 'S2-%')) > 0 THEN 's2_only' ELSE 's3_only' END AS sources, trim(name) = '' AS missing_name, trim(addr) = '' AS missing_address, CASE WHEN length(trim(name)) < 15 THEN 'short' WHEN length(trim(name)) < 35 THEN 'med' ELSE 'long' END AS name_length, CASE WHEN length(trim(addr)) < 25 THEN 'short' WHEN length(trim(addr)) < 60 THEN 'med' ELSE 'long' END AS address_length, regexp_matches(addr, '\\b\\d+\\b') AS address_number, length(regexp_replace({_strip_sql(_SPACED.format('name'))}, '[^a-z0-9]', '', 'g')) >= 3 AS exact_name, regexp_matches(name || addr, '[^\\x00-\\x7F]') AS unicode, regexp_extract({_SPACED.format('name')}, '^\\S+') IN (SELECT w FROM first) AS common_name, len(matches) = 0 OR len(matches) >= 5 OR trim(addr) = '' OR trim(name) = '' OR regexp_matches(name || addr, '[^\\x00-\\x7F]') AS difficult FROM m"
)
def q_record_strata(spark, sf):
    s = shops(spark, sf)
    k = F.col("row_idx")
    many = F.transform(F.sequence(F.lit(1), (k % 9).cast("int")), lambda i: F.concat(F.lit("S2-"), i.cast("string")))
    none = F.array().cast("array<string>")
    some = lambda *ids: F.array(*map(F.lit, ids))
    matches = F.when(k % 6 == 0, none).when(k % 6 == 1, some("S2-1")).when(k % 6 == 2, some("S3-1", "S3-2")).when(k % 6 == 3, some("S2-1", "S3-9")).otherwise(F.when(k % 9 > 0, many).otherwise(none))
    clean = s.select(text.spaced("business_name").alias("name"))
    common = diagnostics.frequent_first_words(clean, "name", 3).agg(F.collect_list("word").alias("common"))  # n words, as asked
    out = s.withColumn("matches", matches).crossJoin(F.broadcast(common)).select("entity_id", sampling.record_stratum(F.col("common")).alias("s"))
    return out.select(F.col("entity_id").alias("id"), "s.*")


@query(f"WITH {_N}, {_TRUTH}, al AS (SELECT t.*, regexp_replace({_strip_sql('sn')}, '[^a-z0-9]', '', 'g') AS al FROM (SELECT t.*, {_SPACED.format('e.name')} AS sn FROM t JOIN e USING (id)) t), p AS (SELECT 'alpha' AS c, country, id, al AS k FROM al WHERE length(al) >= 3 UNION ALL SELECT 'name', country, id, unnest(nt) FROM t), z AS (SELECT c, country, k FROM p GROUP BY ALL HAVING count(*) <= 60), f AS (SELECT a.id AS s1, b.id AS cid, max(CASE WHEN p2 = 'alpha' THEN 1 ELSE 0 END) AS first FROM (SELECT p.*, c AS p2 FROM p JOIN z USING (c, country, k)) a JOIN p b ON a.c = b.c AND a.country = b.country AND a.k = b.k AND a.id <> b.id GROUP BY 1, 2), w AS (SELECT f.*, row_number() OVER (PARTITION BY s1, first ORDER BY cid) AS rn FROM f ANTI JOIN truth USING (s1, cid)) SELECT s1, cid FROM w WHERE (first = 1 AND rn <= 2) OR (first = 0 AND rn <= 3)")
def q_hard_negatives(spark, sf):
    r = records(spark, sf)
    found = blocking.candidates(r, r, [Channel("alpha", "alpha", 60, least=3), NAME])
    return model.hard_negatives(found, truth(spark, sf))


@query("WITH n AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS cid FROM documents WHERE doc_id % 50 = 0) SELECT CAST(d.doc_id AS VARCHAR) AS cid, n.cid IS NOT NULL AS needed FROM documents d LEFT JOIN n ON n.cid = CAST(d.doc_id AS VARCHAR) WHERE n.cid IS NOT NULL OR ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20")
def q_distractors(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("cid"))
    return sampling.distractors(d.select("cid"), d.where("doc_id % 50 = 0").select("cid"))


@query(f"WITH {_E2}, n AS (SELECT id FROM e WHERE doc_id % 100 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY doc_id, id) AS rn FROM e WHERE id NOT IN (SELECT id FROM n)) SELECT id, country FROM e WHERE id IN (SELECT id FROM n) UNION ALL SELECT id, country FROM o WHERE rn <= 40")
def q_candidate_pool(spark, sf):
    s = shops(spark, sf)
    pool = readers.candidate_pool(s, s.where("row_idx % 100 = 0"), "entity_id", "row_idx", 40, ["country"])
    return pool.select(F.col("entity_id").alias("id"), "country")


# Files -------------------------------------------------------------------------------------


def _written(spark, sf, name: str) -> str:
    path = scratch.folder(spark, name)
    writers.write_tsv(shops(spark, sf), path, files=1)
    return path


_ENTITIES = f"WITH {_E2} SELECT id AS entity_id, name AS business_name, addr AS business_address, country FROM e"


@query(_ENTITIES)
def q_read_tsv(spark, sf):
    return readers.tsv(spark, _written(spark, sf, "tsv"))


@query(_ENTITIES.replace(", addr AS business_address", ""))
def q_read_tsv_by_position(spark, sf):
    df = readers.tsv_by_position(spark, _written(spark, sf, "lines"), ["entity_id", "business_name", "business_address", "country"])
    return df.select("entity_id", "business_name", "country")


@query(_ENTITIES)
def q_read_tsv_by_header(spark, sf):
    return readers.tsv_by_header(spark, _written(spark, sf, "named"), ["entity_id", "business_name", "business_address", "country"])


@query(f"SELECT s1, trim(c) AS cid FROM (SELECT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS c FROM ({_SHOP_LISTS})) WHERE trim(c) <> ''")
def q_read_pairs(spark, sf):
    path = scratch.folder(spark, "truth")
    lists = spark.sql(_SHOP_LISTS.replace("FROM customer", "FROM {c}"), c=table(spark, sf, "customer"))
    writers.write_tsv(lists, path)
    return readers.pairs(readers.tsv(spark, path, readers.TRUTH))


@query("SELECT DISTINCT trim(matched) AS id FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN '  ' ELSE ' S2-' || c_nationkey || ' ' END AS matched FROM customer) WHERE trim(matched) <> ''")
def q_ids_only(spark, sf):
    return readers.ids_only(table(spark, sf, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN '  ' ELSE ' S2-' || c_nationkey || ' ' END AS id"), "id")


@query(f"WITH {_E2} SELECT id, country FROM e WHERE country = 'India' AND doc_id % 3 <> 0")
def q_resume_country(spark, sf):
    """Records written by country, one country read, those of the checkpoint left out."""
    path, done = scratch.folder(spark, "country"), scratch.folder(spark, "checkpoint")
    s = shops(spark, sf)
    lists = s.where("row_idx % 3 = 0").selectExpr("entity_id AS s1", "'' AS matched", "country")
    for part in ("row_idx % 6 = 0", "row_idx % 6 = 3"):
        writers.append_checkpoint(s.where(part).selectExpr("entity_id AS s1", "'' AS matched", "country"), done)
    assert lists.columns == ["s1", "matched", "country"]
    finished = spark.read.parquet(done).select(F.col("s1").alias("entity_id"))
    left = readers.unfinished(readers.by_country(spark, s, path).where("country = 'India'"), finished)
    return left.select(F.col("entity_id").alias("id"), "country")


@query(f"WITH {_E2} SELECT id AS s1, doc_id AS row_idx, CASE WHEN doc_id % 3 = 0 THEN 'S2-' || doc_id END AS matched FROM e")
def q_merged_checkpoint(spark, sf):
    done = scratch.folder(spark, "merge")
    s = shops(spark, sf)
    for part in ("row_idx % 6 = 0", "row_idx % 6 = 3", "row_idx % 12 = 3"):  # some entities are finished twice
        writers.append_checkpoint(s.where(part).selectExpr("entity_id AS s1", "'S2-' || row_idx AS matched", "country"), done)
    return writers.merged_checkpoint(spark, done, s.select(F.col("entity_id").alias("s1"), "row_idx"))


@query(f"WITH {_NAME} SELECT CAST(d.doc_id AS VARCHAR) AS source1_entity_id, coalesce((SELECT string_agg(cid, ',' ORDER BY cid) FROM c_name c WHERE c.s1 = CAST(d.doc_id AS VARCHAR)), '') AS candidate_entity_ids FROM documents d")
def q_candidate_pairs_tsv(spark, sf):
    r = records(spark, sf)
    found = blocking.candidates(r, r, [NAME]).select("s1", "cid")
    return writers.id_lists(spine(spark, sf), found, out_list="candidate_entity_ids").drop("row_idx")


@query("SELECT o_orderkey AS row_idx, 'x' || o_custkey || CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE '' END AS value FROM orders WHERE o_orderkey % 5 = 0")
def q_malformed_lines(spark, sf):
    tab = "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN chr(9) || 'y' ELSE chr(9) END"
    lines = table(spark, sf, "orders").selectExpr("o_orderkey AS row_idx", f"'x' || o_custkey || {tab} || CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE '' END AS value")
    return validate.malformed(lines)


@query("SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 50 <> 0 THEN 'S1-' || c_custkey END AS left_id, CASE WHEN c_custkey % 70 <> 0 THEN 'S1-' || (c_custkey + CASE WHEN c_custkey % 30 = 0 THEN 1 ELSE 0 END) END AS right_id FROM customer WHERE (c_custkey % 50 = 0) <> (c_custkey % 70 = 0) OR (c_custkey % 30 = 0 AND c_custkey % 50 <> 0 AND c_custkey % 70 <> 0)")
def q_misaligned_rows(spark, sf):
    c = table(spark, sf, "customer")
    a = c.where("c_custkey % 50 <> 0").selectExpr("c_custkey AS row_idx", "'S1-' || c_custkey AS id")
    b = c.where("c_custkey % 70 <> 0").selectExpr("c_custkey AS row_idx", "'S1-' || (c_custkey + CASE WHEN c_custkey % 30 = 0 THEN 1 ELSE 0 END) AS id")
    return validate.misaligned(a, b, "id")


# Scores and decisions, with a kernel that SQL has ---------------------------------------------

_GRAMS = "list_distinct(list_transform(range(1, greatest(length(replace(cn, ' ', '')) - {0} + 2, 1)), lambda i: substr(replace(cn, ' ', ''), i, {0})))"
_WIDE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.EXPAND_WIDE.items())
_SHOP_FIELDS = (
    f"s AS (SELECT t.id, t.country, cn, ca, nt, ats, list_distinct(nums) AS dg, regexp_extract(ca, '^(\\d+)\\b', 1) AS st, coalesce(list_filter(nums, lambda d: length(d) IN (5, 6))[1], '') AS po, "
    f"coalesce(CASE t.country WHEN 'US' THEN {_states(fixed.US_STATES, fixed.UNSURE_US, _TWO)} WHEN 'India' THEN {_states(fixed.INDIA_STATES, fixed.UNSURE_INDIA, _TWO)} END, '') AS state, "
    f"(SELECT regexp_replace({_strip_sql('sn')}, '[^a-z0-9]', '', 'g') FROM (SELECT {_SPACED.format('e.name')} AS sn)) AS al, "
    f"replace(regexp_extract(lower(e.name), '\\b([a-z0-9\\-]+)\\.(?:{fixed.DOMAINS})\\b', 1), '-', '') AS dom, "
    f"list_filter(ats, lambda x: NOT list_contains({_list(_GENERIC)}, x) AND length(x) >= 3) AS spec, "
    f"list_distinct(list_transform({_WORDS.format('ca')}, lambda x: CASE x {_WIDE} ELSE x END)) AS ex, {_GRAMS.format(3)} AS g3, {_GRAMS.format(4)} AS g4 FROM t JOIN e USING (id))"
)
_LEV = "CASE WHEN x.cn = y.cn THEN 1.0 WHEN x.cn = '' OR y.cn = '' THEN 0.0 ELSE greatest(0.0, 1.0 - levenshtein(left(x.cn, 100), left(y.cn, 100)) / greatest(length(left(x.cn, 100)), length(left(y.cn, 100)))) END"
_BOTH = lambda a: f"(x.{a} <> '' AND x.{a} = y.{a})"
_DIFFER = lambda a: f"(x.{a} <> '' AND y.{a} <> '' AND x.{a} <> y.{a})"
_SHOP_PAIRS = (
    f"{_N2}, {_post('name', 'nt')}, {_post('postal', '''[coalesce(list_filter(nums, lambda d: length(d) IN (5, 6))[1], '')]''', 30)}, {_SHOP_FIELDS}, c AS (SELECT s1, cid FROM c_name UNION SELECT s1, cid FROM c_postal), "
    f"m AS (SELECT c.s1, c.cid, {_LEV} AS jw, {_JAC.format('x.nt', 'y.nt', '1.0')} AS nj, {_JAC.format('x.ats', 'y.ats', '1.0')} AS aj, {_JAC.format('x.ex', 'y.ex', '1.0')} AS ej, {_JAC.format('x.ex', 'y.ex', '0.0')} AS ej0, "
    f"{_JAC.format('x.g4', 'y.g4', '1.0')} AS gj, {_JAC.format('x.g3', 'y.g3', '1.0')} AS tj, {_JAC.format('x.dg', 'y.dg', '1.0')} AS dj, "
    "CASE WHEN len(x.nt) = 0 OR len(y.nt) = 0 THEN 0.0 ELSE len(list_intersect(x.nt, y.nt)) / least(len(x.nt), len(y.nt)) END AS ct, "
    f"CASE WHEN {_DIFFER('st')} THEN 1.0 WHEN (x.st <> '' OR y.st <> '') AND x.st <> y.st THEN 0.2 ELSE 0.0 END AS cf, "
    f"CASE WHEN {_DIFFER('po')} THEN -0.15 WHEN {_BOTH('po')} THEN 0.06 ELSE 0.0 END AS pt, "
    f"{_DIFFER('st')} AS dst, {_DIFFER('po')} AS dpo, {_DIFFER('state')} AS dstate, {_BOTH('al')} AS same_al, length(x.al) AS l1, length(y.al) AS l2, (contains(x.al, y.al) OR contains(y.al, x.al)) AS within_al, x.al AS a1, y.al AS a2, x.dom AS d1, y.dom AS d2, "
    "len(x.g4) > 0 AND len(y.g4) > 0 AS some4, len(list_intersect(x.dg, y.dg)) AS nd, len(x.dg) > 0 AND len(y.dg) > 0 AS known, x.ca <> '' AND y.ca <> '' AS both_ca, "
    "len(list_intersect(x.spec, y.spec)) AS ns, len(x.spec) > 0 AND len(y.spec) > 0 AS both_spec, len(list_intersect(x.nt, y.nt)) AS common, CASE WHEN len(x.nt) > 0 AND len(y.nt) > 0 THEN least(len(x.nt), len(y.nt)) ELSE 0 END AS fewest, x.cn AS n1, y.cn AS n2 "
    "FROM c JOIN s x ON x.id = c.s1 JOIN s y ON y.id = c.cid)"
)


def shop_pairs(spark, sf) -> DataFrame:
    """Pairs of shops with a Levenshtein share in the place of Jaro-Winkler."""
    r = normalised(shops(spark, sf), "plain")
    p = blocking.joined(blocking.candidates(r, r, [NAME, Channel("postal", "postal", 30)]), r, r)
    jw = S.levenshtein_share(*scoring.side("clean_name"), gap=None)
    return p.withColumn("jw", jw).withColumn("jw_sorted", F.col("jw"))


_L1 = "(0.5 * jw + 0.25 * nj + 0.25 * aj - 0.3 * cf)"


def _l3(address: str, late: bool) -> str:
    base = f"(0.5 * jw + 0.25 * nj + 0.25 * {address} - 0.3 * cf + pt)"
    alt = f"(0.5 * jw + 0.15 * nj + 0.15 * {address} + 0.2 * gj - 0.3 * cf)"
    base = f"(CASE WHEN {'some4 AND ' if late else ''}gj >= 0.5 AND jw >= 0.65 THEN greatest({base}, {alt}) ELSE {base} END)"
    equal, boost = "(same_al AND l1 >= 4 AND cf < 1.0)", f"greatest({base}, 0.40 + 0.35 * jw + 0.25 * {address} - 0.2 * cf)"
    if late:
        base = f"(CASE WHEN {equal} THEN CASE WHEN {address} >= 0.08 OR nd > 0 OR NOT both_ca THEN {boost} ELSE least({base}, 0.65) END ELSE {base} END)"
    else:
        base = f"(CASE WHEN {equal} THEN {boost} ELSE {base} END)"
        base = f"(CASE WHEN l1 >= 8 AND l2 >= 8 AND within_al AND cf < 1.0 THEN greatest({base}, 0.35 + 0.35 * jw + 0.20 * {address} + 0.10 * gj - 0.2 * cf) ELSE {base} END)"
    return f"CASE WHEN dstate OR (dst AND dpo) THEN -1.0 ELSE {base} END"


_PEN = "(CASE WHEN dst THEN 0.25 ELSE 0 END + CASE WHEN dstate THEN 0.35 ELSE 0 END)"
_P9 = f"(CASE WHEN gj >= 0.5 AND jw >= 0.60 THEN greatest(0.45 * jw + 0.15 * nj + 0.10 * ct + 0.15 * aj + 0.10 * gj + 0.05 * dj - {_PEN}, 0.35 * jw + 0.10 * nj + 0.10 * ct + 0.15 * aj + 0.25 * gj + 0.05 * dj - {_PEN}) ELSE 0.45 * jw + 0.15 * nj + 0.10 * ct + 0.15 * aj + 0.10 * gj + 0.05 * dj - {_PEN} END)"
_P9 = f"CASE WHEN ct >= 0.8 AND tj >= 0.4 THEN greatest({_P9}, 0.30 * jw + 0.15 * ct + 0.15 * tj + 0.20 * aj + 0.10 * gj + 0.10 * dj - {_PEN}) ELSE {_P9} END"
_P9B = f"(CASE WHEN gj >= 0.5 AND jw >= 0.60 THEN greatest(0.50 * jw + 0.25 * nj + 0.25 * aj - {_PEN}, 0.40 * jw + 0.15 * nj + 0.15 * aj + 0.25 * gj + 0.05 * ct - {_PEN}) ELSE 0.50 * jw + 0.25 * nj + 0.25 * aj - {_PEN} END)"
_P9B = f"CASE WHEN ct >= 0.8 AND jw >= 0.60 THEN greatest({_P9B}, 0.40 * jw + 0.20 * ct + 0.20 * aj + 0.15 * gj + 0.05 * nj - {_PEN}) ELSE {_P9B} END"
_STEM = lambda d, a: f"({d} <> '' AND ({d} = {a} OR (length({d}) >= 8 AND {a} <> '' AND (contains({d}, {a}) OR contains({a}, {d})))))"
_AGAINST = "(known AND nd = 0)"
_SPEC = "(least(0.70, 0.35 * ns) + CASE WHEN nd > 0 THEN 0.25 ELSE 0 END)"
_NM = "(CASE WHEN fewest >= 2 AND common >= fewest - 1 THEN greatest(jw, 0.90) ELSE jw END)"
_AFF = f"CASE WHEN dstate OR ({_AGAINST} AND ns = 0) THEN 0.0 WHEN same_al THEN CASE WHEN {_AGAINST} THEN 0.85 ELSE 0.99 END WHEN {_STEM('d2', 'a1')} OR {_STEM('d1', 'a2')} THEN CASE WHEN {_AGAINST} THEN 0.80 ELSE 0.98 END WHEN NOT both_spec THEN CASE WHEN {_NM} >= 0.88 THEN {_NM} * 0.95 ELSE 0.0 END WHEN ns >= 1 OR nd > 0 THEN 0.5 * {_NM} + 0.5 * {_SPEC} WHEN {_NM} >= 0.94 THEN {_NM} * 0.85 ELSE 0.0 END"
_KINDS = {
    "l1": _L1, "l2": f"CASE WHEN gj >= 0.5 AND jw >= 0.65 THEN greatest({_L1}, 0.5 * jw + 0.15 * nj + 0.15 * aj + 0.2 * gj - 0.3 * cf) ELSE {_L1} END",
    "l3_raw": _l3("aj", False), "l3": _l3("greatest(aj, ej)", False), "l4": _l3("ej0", True), "p9": _P9, "p9b": _P9B, "affinity": _AFF,
}


def _score(kind: str, sql: str) -> None:
    def run(spark, sf):
        return shop_pairs(spark, sf).select("s1", "cid", r6(scoring.match_score(kind) + 1e-9).alias("score"))

    run.__name__ = f"q_score_{kind}"
    query(f"WITH {_SHOP_PAIRS} SELECT s1, cid, round({sql} + 1e-9, 6) AS score FROM m")(run)


for _kind, _sql in _KINDS.items():
    _score(_kind, _sql)


def _rules_sql(r: scoring.Rules) -> str:
    free, backed, strong = f"(NOT {_AGAINST})", "(NOT both_spec OR ns >= 1 OR nd > 0)", "(ns >= 2 OR (ns >= 1 AND nd > 0))"
    jw = "(CASE WHEN n1 <> '' AND n2 <> '' THEN jw ELSE 0 END)"
    stem = lambda d, a: f"(length({d}) >= {r.stem} AND ({d} = {a} OR (length({d}) >= 8 AND (contains({d}, {a}) OR contains({a}, {d})))))"
    equal = f"(same_al AND ({free}{' OR ns >= 1' if r.equal_backed else ''}))"
    return (
        f"(NOT dstate AND ({equal} OR ({free} AND ((l1 >= 8 AND l2 >= 8 AND abs(l1 - l2) <= {r.gap} AND within_al) OR {stem('d2', 'a1')} OR {stem('d1', 'a2')})) OR ({free} AND {jw} >= {r.high} AND ({backed} OR {jw} >= 0.98)) "
        f"OR ({free} AND {jw} >= {r.contained} AND fewest >= 2 AND common >= fewest AND {backed}) OR ({free} AND {strong} AND ({jw} >= {r.address} OR common >= 1))))"
    )


_GUARD = "(both_ca AND aj <= 0.0 AND nd = 0)"
_DECISIONS = {
    **{f"rules_{k}": _rules_sql(v) for k, v in scoring.RULES.items()},
    "guarded": _GUARD, "tiered": "(jw >= 0.82 OR (jw >= 0.54 AND aj >= 0.18))",
    "hybrid": f"(NOT dstate AND NOT dst AND NOT {_GUARD} AND (jw >= 0.70 OR (jw >= 0.48 AND aj >= 0.16)))",
}


@query(f"WITH {_SHOP_PAIRS} SELECT s1, cid, " + ", ".join(f"{v} AS {k}" for k, v in _DECISIONS.items()) + ", round(CASE WHEN cf > 0.5 THEN greatest(0.0, jw - 0.35) ELSE jw END, 6) AS penalised FROM m")
def q_match_decisions(spark, sf):
    p = shop_pairs(spark, sf)
    jw, address = F.col("jw"), S.jaccard(*scoring.side("addr_tokens"))
    columns = {f"rules_{k}": scoring.boolean_rules(v) for k, v in scoring.RULES.items()}
    columns |= {"guarded": scoring.address_guard(), "tiered": scoring.tiered(jw, address, 0.54, 0.82, 0.18), "hybrid": scoring.hybrid_decision(jw)}
    out = [F.coalesce(v, F.lit(False)).alias(k) for k, v in columns.items()]
    return p.select("s1", "cid", *out, r6(scoring.penalised(jw, S.conflict(*scoring.side("street")))).alias("penalised"))

_DICE = "(CASE WHEN n1 = '' OR n2 = '' THEN 0.0 WHEN list_sort({0}) = list_sort({1}) THEN 1.0 ELSE 2.0 * len(list_intersect(list_distinct({0}), list_distinct({1}))) / (len(list_distinct({0})) + len(list_distinct({1}))) END)".format(_WORDS.format("n1"), _WORDS.format("n2"))
_LIFT = "(CASE WHEN dc < 0.85 THEN CASE WHEN d1 <> '' AND d1 = d2 THEN greatest(dc, 0.95) WHEN (d1 <> '' AND contains(replace(n2, ' ', ''), d1)) OR (d2 <> '' AND contains(replace(n1, ' ', ''), d2)) THEN greatest(dc, 0.90) ELSE dc END ELSE dc END)"


@query(f"WITH {_SHOP_PAIRS}, k AS (SELECT *, {_DICE} AS dc FROM m), l AS (SELECT *, {_LIFT} AS nm FROM k), z AS (SELECT *, 0.65 * nm + 0.35 * (CASE WHEN NOT known THEN 0.5 ELSE dj END) - (CASE WHEN known AND nd = 0 THEN 0.30 ELSE 0 END) AS sc FROM l) SELECT s1, cid, round(sc + 1e-9, 6) AS score, (nm >= 0.82 OR (nm >= 0.60 AND nd >= 1) OR (nm >= 0.40 AND nd >= 2) OR sc >= 0.68) AS accepted, round(least(0.99, greatest(0.05, 0.65 * least(1.0, dc + CASE WHEN d1 <> '' AND d1 = d2 THEN 0.35 ELSE 0 END) + 0.35 * (CASE WHEN NOT known THEN 0.5 WHEN nd > 0 THEN dj ELSE 0.1 END))) + 1e-9, 6) AS explorer FROM z")
def q_score_champion(spark, sf):
    p = shop_pairs(spark, sf)
    return p.select("s1", "cid", r6(scoring.champion_parts()["score"] + 1e-9).alias("score"), scoring.champion_decision(0.68).alias("accepted"), r6(scoring.explorer_score() + 1e-9).alias("explorer"))


_AGREE = lambda a, n: f"CASE WHEN x.{a} = '' AND y.{a} = '' THEN {n} WHEN x.{a} = '' OR y.{a} = '' THEN 0.5 WHEN x.{a} = y.{a} THEN 1.0 ELSE 0.0 END"
_LAST = lambda v: f"({_WORDS.format(f'{v}.cn')})[-1]"
_FLAGS = {
    "postal": _AGREE("po", "1.0"), "street": _AGREE("st", "0.5"), "conflict": "CASE WHEN x.st <> '' AND y.st <> '' AND x.st <> y.st THEN 1.0 WHEN x.st <> y.st THEN 0.2 ELSE 0.0 END",
    "prefix": "CASE WHEN least(length(x.cn), length(y.cn)) = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, least(length(x.cn), length(y.cn), 4) + 1), lambda i: CASE WHEN substr(x.cn, i, 1) = substr(y.cn, i, 1) THEN 1.0 ELSE 0.0 END)) / least(length(x.cn), length(y.cn), 4) END",
    "suffix": f"CASE WHEN {_LAST('x')} IS NULL OR {_LAST('y')} IS NULL THEN 0.5 WHEN {_LAST('x')} = {_LAST('y')} THEN 1.0 WHEN list_contains({_list(fixed.CORPORATE_WORDS)}, {_LAST('x')}) AND list_contains({_list(fixed.CORPORATE_WORDS)}, {_LAST('y')}) THEN 0.7 ELSE 0.0 END",
    "long_token": "CASE WHEN len(list_filter(list_intersect(x.nt, y.nt), lambda w: length(w) > 3)) > 0 THEN 1.0 ELSE 0.0 END",
    "cosine": "CASE WHEN len(x.nt) = 0 AND len(y.nt) = 0 THEN 1.0 WHEN len(x.nt) = 0 OR len(y.nt) = 0 THEN 0.0 ELSE len(list_intersect(x.nt, y.nt)) / sqrt(len(x.nt) * len(y.nt)) END",
    "edit_short": "CASE WHEN x.cn = y.cn THEN 1.0 WHEN x.cn = '' OR y.cn = '' THEN 0.0 ELSE greatest(0.0, 1.0 - levenshtein(left(x.cn, 12), left(y.cn, 12)) / greatest(length(left(x.cn, 12)), length(left(y.cn, 12)))) END",
}


@query(f"WITH {_SHOP_PAIRS} SELECT c.s1, c.cid, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _FLAGS.items()) + " FROM c JOIN s x ON x.id = c.s1 JOIN s y ON y.id = c.cid")
def q_pair_measures(spark, sf):
    n, side = scoring.side("clean_name"), scoring.side
    columns = {
        "postal": S.agreement(*side("postal")), "street": S.agreement(*side("street"), neither=0.5), "conflict": S.conflict(*side("street")), "prefix": S.prefix_share(*n), "suffix": S.suffix_agreement(*n),
        "long_token": S.shared_long_token(*side("name_tokens")), "cosine": S.set_cosine(*side("name_tokens")), "edit_short": S.levenshtein_share(*n, longest=12, gap=None),
    }
    return shop_pairs(spark, sf).select("s1", "cid", *(r6(v).alias(k) for k, v in columns.items()))


def _phrases(c: str, phrases: dict[str, str], whole_words: bool) -> str:
    """The replacements one after the other, longest first; those with edges twice, as RE2 has no look-around and a match takes its edges."""
    for k in sorted(phrases, key=lambda k: -len(k)):
        if whole_words:
            c = f"regexp_replace({c}, '\\b{re.escape(k)}\\b', '{phrases[k]}', 'g')"
        else:
            for _ in range(2):
                c = f"regexp_replace({c}, '(^|[^A-Za-z]){re.escape(k)}([^A-Za-z]|$)', '\\1{phrases[k]}\\2', 'g')"
    return c


_PUNCT = "'[^a-z0-9_\\s]'"
_ANDED = "regexp_replace(lower({0}), '\\s*&\\s*', ' and ', 'g')"


@query(f"WITH {_E2}, n AS (SELECT id, {_phrases(_ANDED.format('name'), fixed.NAME_PHRASES, True)} AS nm, regexp_replace({_phrases(_ANDED.format('addr'), fixed.ADDRESS_PHRASES, False)}, {_PUNCT}, ' ', 'g') AS ad FROM e) SELECT id, array_to_string(list_filter(list_transform({_WORDS.format('nm')}, lambda w: regexp_replace(w, {_PUNCT}, '', 'g')), lambda w: w <> ''), ' ') AS name, trim(regexp_replace(ad, '\\s+', ' ', 'g')) AS address FROM n")
def q_contracted(spark, sf):
    return shops(spark, sf).select(F.col("entity_id").alias("id"), text.contract_name("business_name").alias("name"), text.contract_address("business_address").alias("address"))


_NOISE = fixed.LEGAL_WORDS.replace("(?U)", "")


@query(f"WITH {_E2} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '{fixed.NOISE_PREFIX}', ''), '{_NOISE}', ' ', 'g'), {_PUNCT}, ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM e")
def q_noise_stripped(spark, sf):
    return shops(spark, sf).select(F.col("entity_id").alias("id"), text.strip_noise("business_name").alias("name"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def q_normalize_folded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.plain_folded("text").alias("folded"))

# Feature vectors without their one kernel -----------------------------------------------------


def _share(c: str) -> str:
    return f"CASE WHEN x.{c} = y.{c} THEN 1.0 WHEN x.{c} = '' OR y.{c} = '' THEN 0.0 WHEN abs(length(x.{c}) - length(y.{c})) / greatest(length(x.{c}), length(y.{c})) > 0.4 THEN 0.0 ELSE greatest(0.0, 1.0 - levenshtein(left(x.{c}, 100), left(y.{c}, 100)) / greatest(length(left(x.{c}, 100)), length(left(y.{c}, 100)))) END"


def _ratio(c: str) -> str:
    return f"CASE WHEN x.{c} = '' OR y.{c} = '' THEN 0.0 ELSE least(length(x.{c}), length(y.{c})) / greatest(length(x.{c}), length(y.{c})) END"


_IF = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
_SUFFIX = lambda v: f"regexp_extract({v}.cn, '(?:^| )({'|'.join(sorted(fixed.LEGAL_SUFFIXES, key=len, reverse=True))})$', 1)"
_W1, _W2 = _WORDS.format("x.cn"), _WORDS.format("y.cn")
_NJ, _EJ = _JAC.format("x.nt", "y.nt", "1.0"), _JAC.format("x.ex", "y.ex", "1.0")
_FEATURES = [
    _share("cn"), "0.0", _NJ, "CASE WHEN len(x.nt) = 0 OR len(y.nt) = 0 THEN 0.0 ELSE len(list_intersect(x.nt, y.nt)) / least(len(x.nt), len(y.nt)) END", _IF("x.cn <> '' AND x.cn = y.cn"),
    _IF("length(x.cn) >= 4 AND length(y.cn) >= 4 AND left(x.cn, 4) = left(y.cn, 4)"), _IF("length(x.cn) >= 4 AND length(y.cn) >= 4 AND right(x.cn, 4) = right(y.cn, 4)"), _ratio("cn"), "1.0 / (1 + abs(len(x.nt) - len(y.nt)))",
    _IF(f"{_SUFFIX('x')} <> '' AND {_SUFFIX('x')} = {_SUFFIX('y')}"), _IF("len(list_intersect(x.nt, y.nt)) > 0"), _EJ, _JAC.format("x.dg", "y.dg", "1.0"),
    "CASE WHEN x.st <> '' AND y.st <> '' THEN CASE WHEN x.st = y.st THEN 1.0 ELSE 0.0 END ELSE 0.5 END", _AGREE("po", "0.5"), f"CASE WHEN x.ca <> '' AND y.ca <> '' AND len(list_intersect(x.ex, y.ex)) > 0 THEN {_share('ca')} ELSE 0.0 END",
    _IF("x.ca <> '' AND y.ca <> ''"), _ratio("ca"), *(_IF(f"(CASE WHEN x.country <> '' THEN x.country ELSE y.country END) = '{c}'") for c in ("US", "India", "France")), *(_IF(f"y.id LIKE '{p}%'") for p in ("S2-", "S3-")),
    f"({_NJ}) * ({_EJ})", f"CASE WHEN len({_W1}) > 0 AND len({_W2}) > 0 THEN least(len({_W1}), len({_W2})) ELSE 0 END", _IF(f"({_W1})[1] = ({_W2})[1]"), _IF(f"({_W1})[-1] = ({_W2})[-1]"),
    "CASE WHEN x.st <> '' AND y.st <> '' THEN CASE WHEN x.st <> y.st THEN 1.0 ELSE 0.0 END WHEN x.st <> '' OR y.st <> '' THEN 0.2 ELSE 0.0 END",
]


@query(f"WITH {_SHOP_PAIRS} SELECT c.s1, c.cid, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {n}" for v, n in zip(_FEATURES, features.NAMES)) + " FROM c JOIN s x ON x.id = c.s1 JOIN s y ON y.id = c.cid")
def q_features_without_kernel(spark, sf):
    columns = features.unified(kernels=False)
    return shop_pairs(spark, sf).select("s1", "cid", *columns).select("s1", "cid", *(r6(n).alias(n) for n in features.NAMES))


def _edit(c: str) -> str:
    return f"CASE WHEN x.{c} = y.{c} THEN 1.0 WHEN x.{c} = '' OR y.{c} = '' THEN 0.0 ELSE greatest(0.0, 1.0 - levenshtein(left(x.{c}, 40), left(y.{c}, 40)) / greatest(length(left(x.{c}, 40)), length(left(y.{c}, 40)))) END"


_SH = lambda a, of="len(list_distinct(list_concat(x.{0}, y.{0})))": f"(len(list_intersect(x.{a}, y.{a})) / greatest({of.format(a)}, 1))"
_LEN = lambda c: f"(least(length(x.{c}), length(y.{c})) / greatest(length(x.{c}), length(y.{c}), 1))"
_AJ = _JAC.format("x.ats", "y.ats", "1.0")
_VALIDATION = dict(zip(features.NAMES, _FEATURES)) | {
    "f00": _edit("cn"), "f01": _LEV, "f11": _AJ, "f15": f"CASE WHEN x.ca <> '' AND y.ca <> '' THEN {_edit('ca')} ELSE 0.0 END", "f23": f"({_NJ}) * ({_AJ})", **{n: _IF(f"x.country = '{c}'") for n, c in (("f18", "US"), ("f19", "India"), ("f20", "France"))},
}
_OPTIMISATION = _VALIDATION | {
    "f02": _SH("nt"), "f03": _SH("nt", "least(len(x.{0}), len(y.{0}))"), "f05": _IF("x.cn <> '' AND left(x.cn, 4) = left(y.cn, 4)"), "f06": _IF("x.cn <> '' AND right(x.cn, 4) = right(y.cn, 4)"), "f07": _LEN("cn"),
    "f08": "abs(len(x.nt) - len(y.nt)) / greatest(len(x.nt), len(y.nt), 1)", "f10": "0.0", "f11": _SH("ats"), "f12": _SH("dg"), "f15": _edit("ca"), "f17": _LEN("ca"), "f23": f"{_SH('nt')} * {_SH('ats')}", "f27": _IF("x.st <> '' AND y.st <> '' AND x.st <> y.st"),
}
_NUMBERS = f"(CASE WHEN len(x.dg) > 0 AND len(y.dg) > 0 THEN {_SH('dg')} ELSE 0.5 END)"
_FAST = _OPTIMISATION | {n: "0.0" for n in ("f10", "f11", "f14", "f17", "f24", "f25", "f26")} | {
    "f00": _LEV, "f09": _IF("x.dom <> '' AND x.dom = y.dom"), "f12": _NUMBERS, "f13": "CASE WHEN len(x.dg) > 0 AND len(y.dg) > 0 THEN CASE WHEN len(list_intersect(x.dg, y.dg)) > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 END",
    "f15": _edit("ca"), "f23": f"{_SH('nt')} * {_NUMBERS}", "f27": _IF("len(x.dg) > 0 AND len(y.dg) > 0 AND len(list_intersect(x.dg, y.dg)) = 0"),
}


def _variant(name: str, sql: dict[str, str]) -> None:
    """A feature vector with edit shares in the place of its Jaro-Winkler columns."""

    def run(spark, sf):
        p = shop_pairs(spark, sf).withColumn("jw_address", S.levenshtein_share(*scoring.side("clean_addr"), longest=40, gap=None))
        return p.select("s1", "cid", *getattr(features, name)()).select("s1", "cid", *(r6(n).alias(n) for n in features.NAMES))

    run.__name__ = f"q_features_{name}"
    query(f"WITH {_SHOP_PAIRS} SELECT c.s1, c.cid, " + ", ".join(f"round(CAST({sql[n]} AS DOUBLE), 6) AS {n}" for n in features.NAMES) + " FROM c JOIN s x ON x.id = c.s1 JOIN s y ON y.id = c.cid")(run)


for _name, _sql in (("validation", _VALIDATION), ("optimisation", _OPTIMISATION), ("fast", _FAST)):
    _variant(_name, _sql)


# Errors by kind ----------------------------------------------------------------------------------


def shop_truth(spark, sf) -> DataFrame:
    """(id, class): shops of one nation at one street number."""
    return table(spark, sf, "customer").selectExpr(f"{_SHOP_ID} AS id", "CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey || '-' || c_custkey % 97 END AS class")


_SHOP_TRUTH = f"tc AS (SELECT {_SHOP_ID} AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey || '-' || c_custkey % 97 END AS class FROM customer), truth AS (SELECT a.id AS s1, b.id AS cid FROM tc a JOIN tc b ON a.class = b.class AND a.id <> b.id), tn AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1)"
_SHOP_SCORED = f"{_SHOP_PAIRS}, {_SHOP_TRUTH}, sc AS (SELECT m.*, round({_L1} + 1e-9, 6) AS score, s1s.st <> '' AND s1s.st = cs.st AS number FROM m JOIN s s1s ON s1s.id = m.s1 JOIN s cs ON cs.id = m.cid), h AS (SELECT sc.*, t.cid IS NOT NULL AS hit FROM sc LEFT JOIN truth t ON t.s1 = sc.s1 AND t.cid = sc.cid)"


def shop_scored(spark, sf) -> DataFrame:
    p = shop_pairs(spark, sf).withColumn("address", scoring.address_similarity("raw"))
    return p.withColumn("score", r6(scoring.match_score("l1") + 1e-9))


@query(f"WITH {_SHOP_SCORED}, f AS (SELECT h.*, n_true FROM h LEFT JOIN tn USING (s1) WHERE score >= 0.56 AND NOT hit), per AS (SELECT s1, count(*) FILTER (hit) AS found, count(*) FILTER (hit AND score >= 0.56) AS tp FROM h GROUP BY s1), ms AS (SELECT count(*) FILTER (coalesce(tp, 0) < n_true) AS missed_entities, count(*) FILTER (coalesce(found, 0) < n_true) AS missed_at_retrieval FROM tn LEFT JOIN per USING (s1)) SELECT (SELECT count(*) FROM f WHERE n_true IS NULL) AS singleton_merges, (SELECT count(*) FROM f WHERE jw >= 0.90 AND aj < 0.20) AS same_name_elsewhere, (SELECT count(*) FROM f WHERE NOT (jw >= 0.90 AND aj < 0.20) AND jw >= 0.85) AS similar_name, (SELECT count(*) FROM f WHERE jw < 0.60 AND number) AS same_number, missed_entities, missed_at_retrieval FROM ms")
def q_error_counts(spark, sf):
    return diagnostics.error_counts(shop_scored(spark, sf), shop_truth(spark, sf))


@query(f"WITH {_SHOP_SCORED}, f AS (SELECT s1, cid, score, n1 = n2 AS same, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid DESC) AS rn FROM h WHERE score >= 0.56 AND s1 NOT IN (SELECT s1 FROM tn)) SELECT s1, cid, score, CASE WHEN same THEN 'same name, other address' ELSE 'similar name' END AS error FROM f WHERE rn = 1")
def q_singleton_error_types(spark, sf):
    good = shop_scored(spark, sf).where("score >= 0.56").select("s1", "cid", "score")
    return diagnostics.singleton_errors(good, shop_truth(spark, sf), normalised(shops(spark, sf), "plain").select("id", "clean_name"))


@query(f"WITH {_SHOP_SCORED}, r AS (SELECT h.*, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid) AS rn, CASE WHEN dstate THEN 'state' WHEN dst AND dpo THEN 'street and postal' END AS reject FROM h), z AS (SELECT CASE WHEN rn > 20 THEN 'pruned' WHEN reject IS NOT NULL THEN reject || ' reject' WHEN score >= 0.56 AND aj >= 0.3 THEN 'accepted' WHEN score < 0.56 THEN 'below threshold' ELSE 'address floor' END AS stage FROM r WHERE hit), g AS (SELECT stage, count(*) AS n FROM z GROUP BY stage UNION ALL SELECT 'not blocked', (SELECT count(*) FROM truth) - (SELECT count(*) FROM z)) SELECT stage, n, round(n / (SELECT count(*) FROM truth), 6) AS share FROM g WHERE n > 0")
def q_error_stages_by_reject(spark, sf):
    side = scoring.side
    reject = F.when(S.differ(*side("state")), "state").when(S.differ(*side("street")) & S.differ(*side("postal")), "street and postal")
    p = shop_scored(spark, sf).select("s1", "cid", "address", "score", reject.alias("reject"))
    kept = blocking.ranked(p, 20, "score")
    marked = p.withColumn("score", F.when(F.col("reject").isNotNull(), -1.0).otherwise(F.col("score")))
    good = kept.where("reject is null and score >= 0.56 and address >= 0.3")
    out = diagnostics.failure_stages(shop_truth(spark, sf), p, kept, marked, good, 0.56)
    return out.select("stage", "n", r6("share").alias("share"))


@query(f"WITH l AS (SELECT list_filter(list_transform(string_split(matched_entity_ids, ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM ({_SHOP_LISTS}) WHERE source1_entity_id NOT LIKE '%7') SELECT count(*) AS n_rows, count(*) FILTER (len(ids) > 0) AS with_matches, count(*) FILTER (len(ids) = 0) AS empty, CAST(max(len(ids)) AS INTEGER) AS most, CAST(sum(len(list_filter(ids, lambda x: x LIKE 'S2-%'))) AS BIGINT) AS s2_mentions, CAST(sum(len(list_filter(ids, lambda x: x LIKE 'S3-%'))) AS BIGINT) AS s3_mentions, (SELECT count(*) FROM customer) - count(*) AS absent, round(100.0 * (count(*) FILTER (len(ids) = 0) + (SELECT count(*) FROM customer) - count(*)) / (SELECT count(*) FROM customer), 6) AS singleton_percent FROM l")
def q_truth_profile(spark, sf):
    c = table(spark, sf, "customer")
    lists = spark.sql(_SHOP_LISTS.replace("FROM customer", "FROM {c}"), c=c).where("source1_entity_id NOT LIKE '%7'")
    out = diagnostics.truth_profile(lists, c.count())
    return out.withColumn("singleton_percent", r6("singleton_percent"))
