"""The scalar functions as temporary SQL functions of a session, by name.

Each body is the SQL text of the function's own column expression, so SQL and DataFrames agree and the optimiser sees
through both. Joins against dimension tables (base domain, prefecture of a phone) stay DataFrame operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from leadmill.functions import names as N, text as T, urls as U

_S = "s STRING"
#: Name, arguments, function.
FUNCTIONS: list[tuple[str, str, Callable[..., Column]]] = [
    ("lead_digits", _S, T.digits),
    ("lead_match_key", _S, T.match_key),
    ("lead_halfwidth", _S, T.to_halfwidth),
    ("lead_fullwidth", _S, T.to_fullwidth),
    ("lead_normalize_company", _S, T.normalize_company),
    ("lead_expand_abbreviations", _S, T.expand_abbreviations),
    ("lead_strip_english_form", _S, T.strip_english_form),
    ("lead_name_core", _S, lambda s: T.name_core(s)),
    ("lead_legal_form", _S, T.legal_form),
    ("lead_normalize_phone", _S, T.normalize_phone),
    ("lead_is_valid_phone", _S, T.is_valid_phone),
    ("lead_is_freephone", _S, T.is_freephone),
    ("lead_is_fixed_line", _S, T.is_fixed_line),
    ("lead_is_garbage_phone", _S, T.is_garbage_phone),
    ("lead_clean_phone_text", _S, T.clean_phone_text),
    ("lead_extract_phones", _S, lambda s: T.extract_phones(s)),
    ("lead_extract_phone", _S, lambda s: T.extract_phone(s)),
    ("lead_phone_confidence", "source STRING, pref_match STRING", T.phone_confidence),
    ("lead_rank", "seen INT, sources ARRAY<STRING>", T.calc_rank),
    ("lead_demote", "rank STRING", T.demote_rank),
    ("lead_score_rank", "score INT", T.score_to_rank),
    ("lead_industry", _S, lambda s: T.classify_industry(s)),
    ("lead_garbage_reason", _S, T.garbage_name_reason),
    ("lead_has_entity_word", _S, lambda s: T.has_entity_word(s)),
    ("lead_has_label_leak", _S, T.has_label_leak),
    ("lead_needs_reextract", _S, T.needs_reextract),
    ("lead_is_japanese_company", _S, T.is_japanese_company),
    ("lead_is_english_only", _S, T.is_english_only),
    ("lead_needs_local_name", _S, T.needs_local_name),
    ("lead_cut_unit", _S, T.cut_unit),
    ("lead_strip_garbage", _S, T.strip_garbage),
    ("lead_unescape_entities", _S, T.unescape_entities),
    ("lead_representative", _S, T.representative),
    ("lead_keyword_head", _S, lambda s: T.keyword_head(s)),
    ("lead_company_spans", _S, T.company_spans),
    ("lead_is_address_token", _S, T.is_address_token),
    ("lead_normalize_name", _S, N.normalized_name),
    ("lead_sanitize_name", _S, N.sanitized_name),
    ("lead_is_valid_company", _S, N.is_valid_company),
    ("lead_is_valid_company_labelled", _S, N.is_valid_company_labelled),
    ("lead_is_http", _S, U.is_http),
    ("lead_host", _S, U.host),
    ("lead_normalize_url", _S, U.normalize_url),
    ("lead_drop_query", _S, U.drop_query),
    ("lead_is_test_url", _S, U.is_test_url),
    ("lead_is_article_url", _S, U.is_article_url),
    ("lead_unwrap_tracker", _S, lambda s: U.unwrap_tracker(s)),
    ("lead_resolve_link", "base STRING, href STRING", lambda base, href: U.resolve_link(base, href)),
]
_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`.])(<=>|<=|>=|==|!=|[=<>!+\-*/%]|and|or|not)\(")


def sql_text(column: Column) -> str:
    """SQL of a column; operators are called by their names as functions."""
    parts = _LITERAL.split(column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


def register_sql(spark: SparkSession) -> None:
    """Puts all functions into the session."""
    for name, args, f in FUNCTIONS:
        given = [a.split() for a in args.split(", ")]
        column = f(*[F.col(a) for a, _ in given])
        kind = spark.range(1).select(*[F.lit(None).cast(t).alias(a) for a, t in given]).select(column).schema[0].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {sql_text(column)}")
