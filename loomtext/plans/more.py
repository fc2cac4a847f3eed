"""More plans: dates, lists, spans, rule classifiers, attitude axes, specifications."""

from __future__ import annotations

from .catalogue import NEG, POS, YEAR, _in, plan, simple

TANH = "(2 / (1 + exp(-2 * ({0}))) - 1)"

simple("parse_num", "SELECT doc_id, TRY_CAST(source AS DOUBLE) AS number, TRY_CAST(replace(source, 'src', '') AS BIGINT) AS source_no FROM @documents")
simple("nanlike_filter", "SELECT doc_id, lang FROM @documents WHERE lower(trim(lang)) NOT IN ('', 'nan', 'none', 'null', 'na', '<na>', 'de')")
simple("topic_labels", "SELECT e.vec_id, e.label, n.n_name AS topic_name FROM @embeddings e LEFT JOIN @nation n ON e.label = n.n_nationkey")
simple("export_ordered", "SELECT source, doc_id, substring(text, 1, 60) AS title FROM @documents ORDER BY source ASC NULLS LAST, doc_id")
simple("scored_export", "SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 1000, 3) AS kchars, substring(text, 1, 60) AS title FROM @documents")
simple("matrix_best_summary", f"SELECT avg(best) AS mean_best, min(best) AS low_best FROM (SELECT source, max(n) AS best FROM (SELECT source, {YEAR} AS year, count(*) AS n FROM @documents GROUP BY 1, 2) a GROUP BY source) b")
simple("band_accuracy", "SELECT CASE WHEN d.n_chars > 3000 THEN 'high' WHEN d.n_chars > 1000 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, avg(CASE WHEN l.quality = l.toxic THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS agreement FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id GROUP BY 1")
simple("cv_summary", "SELECT lang, avg(m) AS mean, stddev_samp(m) AS sd, count(*) AS folds FROM (SELECT lang, doc_id % 5 AS fold, avg(CAST(n_chars AS DOUBLE)) AS m FROM @documents GROUP BY 1, 2) x GROUP BY lang")
simple("unpivot_means", "SELECT source, 'quality' AS measure, avg(CAST(quality AS DOUBLE)) AS mean FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id GROUP BY source UNION ALL SELECT source, 'toxic', avg(CAST(toxic AS DOUBLE)) FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id GROUP BY source")
simple("softmax_probs", "SELECT doc_id, exp(a) / (exp(a) + exp(b) + 1) AS p_neg, exp(b) / (exp(a) + exp(b) + 1) AS p_pos, 1 / (exp(a) + exp(b) + 1) AS p_neutral FROM (SELECT doc_id, CAST(quality AS DOUBLE) AS a, CAST(toxic AS DOUBLE) AS b FROM @labels) x")
simple("grouped_spearman", "SELECT p_brand, corr(a, b) AS rho FROM (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) * CAST(0.5 AS DOUBLE) AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) * CAST(0.5 AS DOUBLE) AS b FROM @part) x GROUP BY p_brand HAVING count(*) >= 3")
simple("ordered_union_dedup", "SELECT source, count(*) AS lists, min(ord) AS first_list FROM (SELECT DISTINCT source, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS ord FROM @documents) x GROUP BY source ORDER BY lists DESC, first_list, source")
simple("doc_score_variants", "SELECT source, avg(CAST(n_chars AS DOUBLE)) AS by_mean, median(CAST(n_chars AS DOUBLE)) AS by_median FROM @documents GROUP BY source")


@plan("url_predicates")
def _(d):
    return f"SELECT page_id, {d.has('url', '^https?://')} AS web, {d.has('url', '[.](html|htm)$')} AS page FROM {d.t('pages')}"


@plan("fingerprint")
def _(d):
    digest = "sha2(text || '|v1', 256)" if type(d).__name__ == "Spark" else "sha256(text || '|v1')"
    return f"SELECT doc_id, {digest} AS fingerprint FROM {d.t('documents')}"


@plan("tokens_len2")
def _(d):
    return f"SELECT doc_id, count(*) AS kept FROM {d.words()} WHERE length(w) >= 2 GROUP BY doc_id"


@plan("preprocess_corpus")
def _(d):
    return f"SELECT doc_id, lang, {YEAR} AS year, {d.text(d.letters(), ' ')} AS tokens, CAST({d.size(d.letters())} AS BIGINT) AS token_count FROM {d.t('documents')} WHERE {d.size(d.letters())} > 0"


@plan("merge_keyword_lists")
def _(d):
    return f"SELECT source, {d.text(d.gathered('lang'), '|')} AS keywords FROM {d.t('documents')} GROUP BY source"


@plan("topic_label_string")
def _(d):
    top = f"SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r FROM {d.words()} GROUP BY lang, w"
    pick = lambda i: f"max(CASE WHEN r = {i} THEN w END)"
    return f"SELECT lang, {pick(1)} || ' / ' || {pick(2)} || ' / ' || {pick(3)} AS topic_label FROM ({top}) x GROUP BY lang"


@plan("group_matches")
def _(d):
    return f"SELECT doc_id, {d.text(d.gathered('w'), '|')} AS matched FROM {d.words()} WHERE w IN {_in(POS + NEG)} GROUP BY doc_id"


@plan("nonzero_docs")
def _(d):
    return f"SELECT doc_id FROM {d.words()} x SEMI JOIN (SELECT w AS v FROM {d.words()} GROUP BY w HAVING count(DISTINCT doc_id) >= 10) v ON x.w = v.v GROUP BY doc_id"


@plan("parse_ts")
def _(d):
    return f"SELECT event_id, CAST(TRY_CAST(substring(CAST(ts AS STRING), 1, 10) AS DATE) AS STRING) AS day, TRY_CAST(event_type AS DATE) IS NULL AS bad FROM {d.t('events')}"
