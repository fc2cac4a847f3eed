"""Rule classifiers over any table: quality, context, relevance, reasons to leave a row out.

The word lists are parameters; the defaults are the fixed ones of ``lexicons``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons
from ..functions.cleaning import other_letter, script_only, stripped, text_of
from ..functions.matching import any_hit, first_hit, least_gap, spans, unique_hits


def data_quality(media: Column | str, date: Column | str, text: Column | str, least: int = 50) -> Column:
    """The first of: missing_media, missing_date, missing_text, text_too_short; else valid."""
    media, date, text = map(stripped, (media, date, text))
    checks = ((media == "", "missing_media"), (date == "", "missing_date"), (text == "", "missing_text"), (F.length(text) < least, "text_too_short"))
    out = F.lit("valid")
    for wrong, name in reversed(checks):
        out = F.when(wrong, name).otherwise(out)
    return out


def keyword_context(text: Column | str, keyword: str = lexicons.AMBIGUOUS_KEYWORD, partner: Sequence[str] = lexicons.PARTNER, other: Sequence[str] = lexicons.NO_PARTNER, partner_first: bool = False) -> Column:
    """What an ambiguous keyword means: no_object, romantic, non_romantic or ambiguous. With
    contexts of both kinds, the kind asked for first decides."""
    text = text_of(text)
    kinds = [("non_romantic", other), ("romantic", partner)]
    out = F.lit("ambiguous")
    for name, terms in kinds if partner_first else reversed(kinds):
        out = F.when(any_hit(text, terms), name).otherwise(out)
    return F.when(~F.contains(text, F.lit(keyword)), "no_object").otherwise(out)


def article_relevance(title: Column | str, text: Column | str, keywords: Sequence[str] = lexicons.KEYWORDS, keyword: str = lexicons.AMBIGUOUS_KEYWORD, **contexts) -> Column:
    """relevance, keywords, title_keywords (joined by ;). A keyword in the title or two
    anywhere (one within another counts too) are highly relevant, one is for review; the
    ambiguous keyword counts only in the sense of a partner."""
    title, text = text_of(title), text_of(text)
    both = F.concat_ws(" ", title, text)
    romantic = keyword_context(both, keyword, **contexts) == "romantic"
    counted = lambda where: F.filter(unique_hits(where, keywords), lambda w: (w != keyword) | romantic)
    found, titled = counted(both), counted(title)
    level = F.when(F.size(titled) >= 1, "highly_relevant").when(F.size(found) >= 2, "highly_relevant").when(F.size(found) == 1, "manual_review").otherwise("not_relevant")
    return F.struct(level.alias("relevance"), F.array_join(found, ";").alias("keywords"), F.array_join(titled, ";").alias("title_keywords"))


POST_TERMS: Mapping[str, Sequence[str]] = {
    "strong": lexicons.STRONG, "weak": lexicons.WEAK, "context": lexicons.CONTEXT,
    "first_person": lexicons.FIRST_PERSON, "attitude": lexicons.ATTITUDE, "ambiguous": lexicons.AMBIGUOUS,
}


def post_relevance(df: DataFrame, body: str, terms: Mapping[str, Sequence[str]] = POST_TERMS, near: int = 20, script: str | None = "Han") -> DataFrame:
    """df with relevance_level, relevance_rule, the terms found (arrays), weak_context_min_gap
    and relevance_exclusion_reason. Terms are looked up in the characters of one script alone
    (``script``; None: the whole text), ambiguous ones in the whole text in any case; the first
    rule that holds decides."""
    letters = script_only(body, script) if script else text_of(body)
    marked = df.withColumn("_letters", letters)
    names = {k: "matched_ambiguous_patterns" if k == "ambiguous" else f"matched_{k}_terms" for k in terms}
    for kind, name in names.items():
        marked = marked.withColumn(name, unique_hits(text_of(body), terms[kind], True) if kind == "ambiguous" else unique_hits(F.col("_letters"), terms[kind]))
    gap = F.when((F.size(names["weak"]) > 0) & (F.size(names["context"]) > 0), least_gap(spans(F.col("_letters"), terms["weak"]), spans(F.col("_letters"), terms["context"])))
    marked = marked.withColumn("weak_context_min_gap", gap)
    n = {k: F.size(name) for k, name in names.items()}
    has = {k: c > 0 for k, c in n.items()}
    rules = [
        (has["strong"], "high_relevance", "A_strong_keyword", ""),
        (has["ambiguous"] & ~has["context"], "irrelevant", "F_fixed_ambiguous_expression", "fixed_ambiguity_without_strong_or_context"),
        (F.col("weak_context_min_gap") <= near, "high_relevance", "B_weak_near_context", ""),
        (has["weak"] & has["first_person"] & has["attitude"], "high_relevance", "C_personal_attitude", ""),
        (n["weak"] >= 2, "high_relevance", "D_multiple_weak_keywords", ""),
        (has["weak"] & has["context"], "borderline", "borderline_weak_context_far", f"weak_context_gap_over_{near}"),
        (has["weak"] & (has["first_person"] | has["attitude"]), "borderline", "borderline_partial_personal_evidence", "only_first_person_or_attitude"),
        (n["weak"] == 1, "irrelevant", "E_single_unsupported_weak_keyword", "single_weak_keyword_without_support"),
    ]
    verdict = lambda *x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("level", "rule", "reason"), x, strict=True)])
    out = verdict("irrelevant", "no_project_keyword", "no_project_keyword")
    for holds, *what in reversed(rules):
        out = F.when(holds, verdict(*what)).otherwise(out)
    marked = marked.withColumn("_verdict", out)
    columns = [F.col("_verdict.level").alias("relevance_level"), F.col("_verdict.rule").alias("relevance_rule"), *names.values(), "weak_context_min_gap"]
    return marked.select(*df.columns, *columns, F.col("_verdict.reason").alias("relevance_exclusion_reason"))


def cleaning_reasons(body: Column | str, keyword: Column | str, fiction: Sequence[str] = lexicons.FICTION, excluded: Sequence[str] = lexicons.EXCLUDED, names: Sequence[str] = (), script: str = "Han") -> Column:
    """Why a post is left out, reasons joined by '; ' in a fixed order; blank if it stays."""
    body, keyword = stripped(body), stripped(keyword)
    tagged = lambda tag, hit: F.when(hit != "", F.concat(F.lit(tag + ":"), hit))
    return F.concat_ws(
        "; ",
        F.when(body == "", "blank_body"),
        F.when((keyword != "") & ~F.contains(body, keyword), F.concat(F.lit("query_keyword_not_in_body:"), keyword)),
        tagged("fiction_term", first_hit(body, fiction, True)) if fiction else None,
        tagged("excluded_term", first_hit(body, excluded)) if excluded else None,
        tagged("celebrity_name", first_hit(body, names, True)) if names else F.lit(None).cast("string"),
        tagged("other_script", other_letter(body)),
        F.when((body != "") & (script_only(body, script) == ""), f"no_{script.lower()}_characters"),
    )


def acceptance(year: Column, first: int, last: int, text: Column | str, keywords: Sequence[str], least: int = 200, script: Column | None = None) -> Column:
    """The first of: outside_year, too_short, not_mainly_chinese (if a test is given),
    no_keyword; else retained."""
    out = F.when(any_hit(text_of(text), keywords), "retained").otherwise("no_keyword")
    if script is not None:
        out = F.when(~script, "not_mainly_chinese").otherwise(out)
    out = F.when(F.length(text_of(text)) < least, "too_short").otherwise(out)
    return F.when(year.isNull() | ~year.between(first, last), "outside_year").otherwise(out)
