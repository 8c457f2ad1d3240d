"""The operators as SQL functions of a session: ``register(spark)``, then SELECT word_tokenize(text) ..."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

from pyspark.sql import types as T

from loomtext.functions.arrow import _STRINGS, _distinct, _mapped
from loomtext.functions.stemmers import porter_word
from loomtext.functions.tokenizers import WORD_CLASS
from loomtext.kernels import logic, parsing, stems, strings, treebank

_LISTS = pa.list_(pa.string())
#: name -> expression over text
EXPRESSIONS = {
    "space_tokenize": "split(text, ' ', -1)",
    "tab_tokenize": "split(text, '\\t', -1)",
    "line_tokenize": "filter(split(text, '\\r?\\n', -1), x -> trim(x) <> '')",
    "wordpunct_tokenize": rf"regexp_extract_all(text, r'({WORD_CLASS}+|[^\p{{L}}\p{{M}}\p{{N}}_\s]+)', 1)",
    "words": f"regexp_extract_all(text, r'({WORD_CLASS}+)', 1)",
}


def _functions() -> dict:
    text, number, yes = (T.StringType(), pa.string()), (T.DoubleType(), pa.float64()), (T.BooleanType(), pa.bool_())
    lists = (_STRINGS, _LISTS)
    return {
        "treebank_tokenize": _mapped(lambda x: treebank.tokens(x), *lists),
        "word_tokenize": _mapped(lambda x: treebank.word_tokens(x, None, frozenset(), False), *lists),
        "sent_tokenize": _mapped(lambda x: treebank.sentences(x, None), *lists),
        "sexpr_tokenize": _mapped(lambda x: treebank.s_expressions(x, "()", False), *lists),
        "porter_stem": _distinct(lambda w: None if w is None else porter_word(w), *text),
        "lancaster_stem": _distinct(lambda w: None if w is None else stems.lancaster(w), *text),
        "snowball_stem": _distinct(lambda w: None if w is None else stems.snowball("english")(w), *text),
        "arlstem": _distinct(lambda w: None if w is None else stems.arlstem(w), *text),
        "jaro_similarity": _mapped(lambda x, y: strings.jaro(x, y), *number),
        "jaro_winkler_similarity": _mapped(lambda x, y: strings.jaro_winkler(x, y), *number),
        "tree_productions": _mapped(lambda x: parsing.productions(parsing.nodes(x)), *lists),
        "tableau_proves": _mapped(lambda x, y: logic.tableau(x, y), *yes),
    }


def register(spark: SparkSession) -> list[str]:
    """The names that were registered."""
    for name, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS ARRAY<STRING> RETURN {body}")
    functions = _functions()
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted([*EXPRESSIONS, *functions])


