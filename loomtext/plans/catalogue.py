"""Relational and lexicon operators as declarative plans, each in both spellings.

Years are 2021 + doc_id % 5, corpora are lang = 'en' and the rest, raters are the
two labels, and arrival order in the event stream is (event_id * 7919) % 1000003.
"""

from __future__ import annotations

from collections.abc import Callable

from .dialect import Portable

PLANS: dict[str, Callable[[Portable], str]] = {}
POS, NEG = ("and", "is", "que", "und"), ("of", "der", "les", "por")
ARRIVAL = "(event_id * 7919) % 1000003"
YEAR = "(2021 + doc_id % 5)"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _hits(text: str, words) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) / {len(w)}" for w in words)


def plan(name: str):
    def keep(f):
        PLANS[name] = f
        return f

    return keep


def simple(name: str, sql: str) -> None:
    """A plan whose spelling is common; @name stands for a table."""
    import re

    PLANS[name] = lambda d: re.sub(r"@(\w+)", lambda m: d.t(m[1]), sql)


# Projections and predicates
simple("scan_projected", "SELECT doc_id, text FROM @documents WHERE text IS NOT NULL")
simple("null_to_blank", "SELECT d.doc_id, trim(coalesce(CAST(l.quality AS STRING), '')) AS quality_text FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
simple("year_prefix", "SELECT o_orderkey, substring(CAST(o_orderdate AS STRING), 1, 4) AS order_year FROM @orders")
simple("polarity_score", "SELECT doc_id, quality - toxic AS polarity FROM @labels")
simple("threshold_category", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice < 100000 THEN 'low' ELSE 'middle' END AS band FROM @orders")
simple("map_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END AS language FROM @documents")
simple("compose_url", "SELECT doc_id, 'https://example.org/' || source || '/' || CAST(doc_id AS STRING) || '?lang=' || lang AS url FROM @documents")
simple("row_ids", "SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS row_id FROM @documents")
simple("rename_drop", "SELECT doc_id AS id, text AS body, source AS outlet FROM @documents")
simple("text_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, CAST(length(text) AS BIGINT) = n_chars AS agrees FROM @documents")
simple("title_body", "SELECT doc_id, coalesce(source, '') || '. ' || coalesce(text, '') AS titled FROM @documents")
simple("prefix20", "SELECT doc_id, substring(text, 1, 20) AS prefix FROM @documents")
simple("case_ops", "SELECT doc_id, lower(text) AS lowered, upper(source) AS uppered FROM @documents")
simple("filter_quality", "SELECT doc_id, quality FROM @labels WHERE quality = 1")
simple("filter_in", "SELECT doc_id, lang FROM @documents WHERE lang IN ('en', 'fr')")
simple("filter_nonempty", "SELECT doc_id FROM @documents WHERE length(trim(text)) > 0")
simple("drop_nulls", "SELECT d.doc_id, l.quality FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
simple("exclude_ids", "SELECT d.doc_id FROM @documents d LEFT ANTI JOIN (SELECT doc_id FROM @labels WHERE quality = 0) x ON d.doc_id = x.doc_id".replace("LEFT ANTI JOIN", "ANTI JOIN"))
simple("having_min_count", "SELECT source, count(*) AS n FROM @documents GROUP BY source HAVING count(*) >= 40")
simple("exclude_month", "SELECT o_orderkey FROM @orders WHERE NOT (year(o_orderdate) = 1995 AND month(o_orderdate) = 3)")
simple("limit_n", "SELECT doc_id FROM @documents ORDER BY doc_id LIMIT 25")

# Joins
simple("join_labels_left", "SELECT l.doc_id, l.quality, l.toxic, d.source, d.n_chars FROM @labels l LEFT JOIN @documents d ON l.doc_id = d.doc_id")
simple("join_scores_left", "SELECT d.doc_id, d.source, l.quality AS score FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
simple("join_dedup_match_rate", "SELECT count(*) AS n, avg(CASE WHEN l.doc_id IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS match_rate FROM @documents d LEFT JOIN (SELECT DISTINCT doc_id FROM @labels) l ON d.doc_id = l.doc_id")
simple("join_inner", "SELECT e.vec_id, e.label, l.quality FROM @embeddings e JOIN @labels l ON e.vec_id = l.doc_id")
simple("join_many_to_one", "SELECT o.o_orderkey, c.c_name FROM @orders o LEFT JOIN @customer c ON o.o_custkey = c.c_custkey")
simple("join_one_to_one", "SELECT d.doc_id, d.lang, l.toxic FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
simple("anti_join_completed", "SELECT d.doc_id FROM @documents d ANTI JOIN @labels l ON d.doc_id = l.doc_id")
simple("task_grid", "SELECT a.lang, b.source FROM (SELECT DISTINCT lang FROM @documents) a CROSS JOIN (SELECT DISTINCT source FROM @documents) b")
simple("profile_intersection", f"SELECT a.source, a.year, a.n AS n_a, b.n AS n_b FROM (SELECT source, {YEAR} AS year, count(*) AS n FROM @documents WHERE lang = 'en' GROUP BY 1, 2) a JOIN (SELECT source, {YEAR} AS year, count(*) AS n FROM @documents WHERE lang <> 'en' GROUP BY 1, 2) b ON a.source = b.source AND a.year = b.year")
simple("insert_ignore", "SELECT doc_id, quality FROM @labels UNION ALL SELECT d.doc_id, NULL FROM @documents d ANTI JOIN @labels l ON d.doc_id = l.doc_id")
simple("upsert_replace", "SELECT doc_id, value FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS r FROM (SELECT doc_id, toxic AS value, 1 AS turn FROM @labels UNION ALL SELECT doc_id, quality, 2 FROM @labels WHERE doc_id % 2 = 0) u) v WHERE r = 1")

# Aggregates
simple("yearly_share", f"SELECT {YEAR} AS year, count(*) AS n, CAST(sum(quality) AS BIGINT) AS hits, 100.0 * CAST(sum(quality) AS DOUBLE) / count(*) AS pct FROM @labels GROUP BY {YEAR}")
simple("value_counts", "SELECT l.quality AS value, count(*) AS n FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id GROUP BY l.quality")
simple("group_means", "SELECT source, avg(CAST(n_chars AS DOUBLE)) AS mean_chars, count(*) AS n FROM @documents GROUP BY source")
simple("mean_ci95", "SELECT source, count(*) AS n, avg(CAST(n_chars AS DOUBLE)) AS mean, CASE WHEN count(*) < 2 THEN NULL ELSE 1.96 * stddev_samp(CAST(n_chars AS DOUBLE)) / sqrt(CAST(count(*) AS DOUBLE)) END AS ci FROM @documents GROUP BY source")
simple("descriptives", "SELECT lang, count(*) AS n, avg(CAST(n_chars AS DOUBLE)) AS mean, median(CAST(n_chars AS DOUBLE)) AS median, stddev_samp(CAST(n_chars AS DOUBLE)) AS sd, stddev_pop(CAST(n_chars AS DOUBLE)) AS sd_pop, min(n_chars) AS low, max(n_chars) AS high, avg(CASE WHEN n_chars > 2000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS share_long FROM @documents GROUP BY lang")
simple("distinct_count", "SELECT source, count(DISTINCT lang) AS n_lang FROM @documents GROUP BY source")
simple("flag_rate", "SELECT d.source, avg(CAST(l.toxic AS DOUBLE)) AS rate FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id GROUP BY d.source")
simple("crosstab", "SELECT quality, CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS toxic_0, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic_1 FROM @labels GROUP BY quality")
simple("gap_by_year", f"SELECT {YEAR} AS year, avg(CASE WHEN lang = 'en' THEN CAST(n_chars AS DOUBLE) END) - avg(CASE WHEN lang <> 'en' THEN CAST(n_chars AS DOUBLE) END) AS gap FROM @documents GROUP BY {YEAR}")
simple("mean_abs_change", "SELECT avg(abs(CAST(quality AS DOUBLE) - toxic)) AS mean_abs_change FROM @labels")
simple("label_audit", "SELECT 'rows' AS item, count(*) AS value FROM @labels UNION ALL SELECT 'quality', count(*) FROM @labels WHERE quality = 1 UNION ALL SELECT 'toxic', count(*) FROM @labels WHERE toxic = 1")
simple("dup_groups", "SELECT source, min(doc_id) AS first_id, count(*) AS n FROM @documents GROUP BY source, text HAVING count(*) > 1")
simple("majority_baseline", "SELECT greatest(avg(CAST(toxic AS DOUBLE)), 1 - avg(CAST(toxic AS DOUBLE))) AS baseline FROM @labels")
simple("variant_spread", "SELECT source, max(m) - min(m) AS spread, min(m) > 0 AS all_positive FROM (SELECT source, lang, avg(CAST(n_chars AS DOUBLE)) AS m FROM @documents GROUP BY source, lang) g GROUP BY source")
simple("stability_summary", "SELECT lang, min(m) AS low, avg(m) AS mean, median(m) AS median FROM (SELECT source, lang, avg(CAST(n_chars AS DOUBLE)) AS m FROM @documents GROUP BY source, lang) g GROUP BY lang")

# Windows, ranking, duplicates
simple("top_docs_per_topic", "SELECT source, doc_id, r AS rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS r FROM @documents) x WHERE r <= 5")
simple("avg_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS average_rank FROM @part".replace("/ 2.0", "* CAST(0.5 AS DOUBLE)"))
simple("prefix_running_min", f"SELECT event_id, earliest IS NULL OR ts < earliest AS accepted FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY {ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earliest FROM @events) x")


@plan("stratum_quota")
def _(d):
    return f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {d.ties(ARRIVAL, 'event_id')}) AS r FROM {d.t('events')}) x WHERE r <= 50"


simple("zscore_global", "SELECT doc_id, (n_chars - m) / (s + 1e-9) AS z FROM @documents CROSS JOIN (SELECT avg(CAST(n_chars AS DOUBLE)) AS m, stddev_samp(CAST(n_chars AS DOUBLE)) AS s FROM @documents) t")
simple("drop_duplicates_keyed", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM @documents) x WHERE r = 1")
simple("sort_nulls_last", "SELECT d.doc_id, l.quality FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id")
simple("top_k", "SELECT doc_id, n_chars FROM @documents ORDER BY n_chars DESC, doc_id LIMIT 20")
simple("bottom_k", "SELECT doc_id, n_chars FROM @documents ORDER BY n_chars, doc_id LIMIT 20")
simple("order_by_list", "SELECT d.doc_id, o.ord FROM @documents d JOIN (SELECT 'fr' AS lang, 1 AS ord UNION ALL SELECT 'en', 2) o ON d.lang = o.lang ORDER BY o.ord, d.doc_id")

# Sets
simple("union_all_tagged", "SELECT doc_id AS id, 'documents' AS origin FROM @documents UNION ALL SELECT item_id, 'benchmark' FROM @benchmark")
simple("union_by_name", "SELECT doc_id AS id, source, '' AS url FROM @documents UNION ALL SELECT page_id, '', url FROM @pages")
simple("set_union", "SELECT source FROM @documents WHERE lang = 'en' UNION SELECT source FROM @documents WHERE lang = 'fr'")
simple("set_except", "SELECT doc_id FROM @documents EXCEPT SELECT doc_id FROM @labels")
simple("set_intersect", "SELECT source FROM @documents WHERE lang = 'en' INTERSECT SELECT source FROM @documents WHERE lang = 'es'")
simple("lexicon_algebra", "(SELECT DISTINCT source FROM @documents WHERE lang = 'en' UNION SELECT source FROM @documents WHERE lang = 'fr') EXCEPT SELECT 'src3' EXCEPT SELECT 'src5'")

# Agreement and rank statistics
simple("cohen_kappa", "SELECT (po - pe) / (1 - pe) AS kappa FROM (SELECT avg(CASE WHEN quality = toxic THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS po, avg(CAST(quality AS DOUBLE)) * avg(CAST(toxic AS DOUBLE)) + (1 - avg(CAST(quality AS DOUBLE))) * (1 - avg(CAST(toxic AS DOUBLE))) AS pe FROM @labels) x")
simple("spearman", "SELECT corr(a, b) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) * CAST(0.5 AS DOUBLE) AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) * CAST(0.5 AS DOUBLE) AS b FROM @part) x")
simple("sign_stability", "SELECT source, a, b, sign(a) = sign(b) AS same_sign FROM (SELECT source, avg(CAST(n_chars AS DOUBLE)) - 2000 AS a, median(CAST(n_chars AS DOUBLE)) - 2000 AS b FROM @documents GROUP BY source) x")


@plan("length_summary")
def _(d):
    q = lambda p: d.quantile("CAST(n_chars AS DOUBLE)", p)
    return f"SELECT source, count(*) AS n, avg(CAST(n_chars AS DOUBLE)) AS mean, {q(0.5)} AS median, min(n_chars) AS low, {q(0.25)} AS q1, {q(0.75)} AS q3, max(n_chars) AS high FROM {d.t('documents')} GROUP BY source"


@plan("year_regex")
def _(d):
    return f"SELECT page_id, coalesce(nullif({d.first('url', '20[0-9][0-9]')}, ''), substring('2024-01-01', 1, 4)) AS year FROM {d.t('pages')}"


@plan("year_regex_fb")
def _(d):
    return f"SELECT page_id, coalesce(nullif({d.first('url', '20[0-9][0-9]')}, ''), nullif({d.first('html', '20[0-9][0-9]')}, ''), '') AS year FROM {d.t('pages')}"


@plan("manual_review")
def _(d):
    return f"SELECT doc_id FROM {d.t('documents')} WHERE length(text) < 100 OR {d.has('text', '[|]')}"


@plan("seed_polarity")
def _(d):
    return f"SELECT doc_id, (p - n) / (p + n + 1) AS polarity FROM (SELECT doc_id, CAST({_hits('text', POS)} AS DOUBLE) AS p, CAST({_hits('text', NEG)} AS DOUBLE) AS n FROM {d.t('documents')}) x"


@plan("tokenize")
def _(d):
    return f"SELECT doc_id, {d.text(d.letters(), ' ')} AS tokens, CAST({d.size(d.letters())} AS BIGINT) AS token_count FROM {d.t('documents')}"


@plan("word_frequency")
def _(d):
    return f"SELECT w AS word, count(*) AS n FROM {d.words()} GROUP BY w"


@plan("bow_frequency")
def _(d):
    return f"SELECT w AS word, count(*) AS n FROM {d.words()} GROUP BY w HAVING count(DISTINCT doc_id) >= 2"


@plan("fightin_words")
def _(d):
    return f"""WITH c AS (SELECT w AS word, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN lang = 'en' THEN 0 ELSE 1 END) AS DOUBLE) AS b FROM {d.words()} GROUP BY w),
    t AS (SELECT sum(a) AS na, sum(b) AS nb FROM c),
    p AS (SELECT word, a, b, na, nb, 1000 * (a + b) / (na + nb) AS prior FROM c CROSS JOIN t)
    SELECT word, a AS count_a, b AS count_b,
           (ln((a + prior) / (na + 1000 - a - prior)) - ln((b + prior) / (nb + 1000 - b - prior))) / sqrt(1 / (a + prior) + 1 / (b + prior)) AS z
    FROM p WHERE a + b >= 20"""


@plan("fightin_words_top")
def _(d):
    inner = PLANS["fightin_words"](d)
    return f"SELECT side, word, z FROM (SELECT CASE WHEN z > 0 THEN 'a' ELSE 'b' END AS side, word, z, row_number() OVER (PARTITION BY z > 0 ORDER BY abs(z) DESC, word) AS r FROM ({inner}) f) x WHERE r <= 15"


@plan("topn_per_group")
def _(d):
    return f"SELECT source, word, n FROM (SELECT source, w AS word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w) AS r FROM {d.words()} GROUP BY source, w) x WHERE r <= 10"


@plan("vocab_full_outer")
def _(d):
    side = lambda c: f"(SELECT w, count(*) AS n FROM {d.words(c)} GROUP BY w)"
    return f"SELECT coalesce(a.w, b.w) AS word, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM {side('lang = ' + repr('en'))} a FULL OUTER JOIN {side('lang <> ' + repr('en'))} b ON a.w = b.w"


@plan("semi_join_vocab")
def _(d):
    return f"SELECT doc_id, count(*) AS n FROM {d.words()} x SEMI JOIN (SELECT w AS v FROM {d.words()} GROUP BY w HAVING count(*) >= 100) v ON x.w = v.v GROUP BY doc_id"


@plan("doc_score_lookup")
def _(d):
    return f"SELECT d.doc_id, coalesce(s.score, 0.0) AS score FROM {d.t('documents')} d LEFT JOIN (SELECT doc_id, avg(CASE WHEN w IN {_in(POS)} THEN 1.0 ELSE -1.0 END) AS score FROM {d.words()} WHERE w IN {_in(POS + NEG)} GROUP BY doc_id) s ON d.doc_id = s.doc_id".replace("1.0 ELSE -1.0", "CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE)")


@plan("flag_any_token")
def _(d):
    return f"SELECT DISTINCT doc_id FROM {d.words()} WHERE w IN ('license', 'token')"


@plan("topic_diversity")
def _(d):
    return f"SELECT CAST(count(DISTINCT w) AS DOUBLE) / count(*) AS diversity FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r FROM {d.words()} GROUP BY lang, w) x WHERE r <= 15"


@plan("jaccard")
def _(d):
    return f"""WITH u AS (SELECT DISTINCT lang, source FROM {d.t('documents')})
    SELECT a.lang AS x, b.lang AS y, CAST(sum(CASE WHEN a.source = b.source THEN 1 ELSE 0 END) AS DOUBLE) / (max(na.n) + max(nb.n) - sum(CASE WHEN a.source = b.source THEN 1 ELSE 0 END)) AS jaccard
    FROM u a JOIN u b ON a.lang < b.lang JOIN (SELECT lang, count(*) AS n FROM u GROUP BY lang) na ON na.lang = a.lang JOIN (SELECT lang, count(*) AS n FROM u GROUP BY lang) nb ON nb.lang = b.lang GROUP BY a.lang, b.lang"""


@plan("lexicon_theta_join")
def _(d):
    lexicon = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in ("License", "token", "The and", "***"))
    return f"SELECT d.doc_id, l.term FROM {d.t('documents')} d JOIN ({lexicon}) l ON instr(d.text, l.term) > 0"


@plan("collect_json_unique")
def _(d):
    return f"SELECT lang, {d.text(d.gathered('source'), ',')} AS sources FROM {d.t('documents')} GROUP BY lang"


@plan("date_labels")
def _(d):
    return f"SELECT event_type, {d.stamp('ts', 'month')} AS month, {d.stamp('ts', 'day')} AS day, count(*) AS n FROM {d.t('events')} GROUP BY 1, 2, 3"


@plan("tumbling_blocks")
def _(d):
    block = {"Spark": "CAST(floor(datediff(CAST(ts AS DATE), DATE '2024-01-01') / 5) AS BIGINT)"}.get(type(d).__name__, "CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS BIGINT)")
    return f"SELECT event_type, {block} AS block, count(*) AS n, avg(value) AS mean_value FROM {d.t('events')} GROUP BY 1, 2"


@plan("vector_mean_by_group")
def _(d):
    each = f"SELECT label, posexplode(embedding) AS (dim, x) FROM {d.t('embeddings')}" if type(d).__name__ == "Spark" else f"SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM {d.t('embeddings')}"
    return f"SELECT label, CAST(dim AS BIGINT) AS dim, avg(CAST(x AS DOUBLE)) AS mean FROM ({each}) e GROUP BY label, dim"


@plan("topic_cosine")
def _(d):
    return f"""WITH m AS ({PLANS['vector_mean_by_group'](d)}), n AS (SELECT label, sqrt(sum(mean * mean)) AS n FROM m GROUP BY label)
    SELECT a.label AS x, b.label AS y, sum(a.mean * b.mean) / (max(p.n) * max(q.n)) AS cosine
    FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label JOIN n p ON p.label = a.label JOIN n q ON q.label = b.label GROUP BY a.label, b.label"""


@plan("bincount")
def _(d):
    grid = f"(SELECT {d.each(d.spread('0', '11'))} AS k)"
    return f"SELECT CAST(g.k AS BIGINT) AS k, coalesce(c.n, 0) AS n FROM {grid} g LEFT JOIN (SELECT label, count(*) AS n FROM {d.t('embeddings')} GROUP BY label) c ON g.k = c.label"


@plan("viz_top_terms")
def _(d):
    return f"SELECT w AS word, count(*) AS n FROM {d.words()} GROUP BY w ORDER BY n DESC, word LIMIT 20"
