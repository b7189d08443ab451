"""The dialect's names for the conditions that Spark raises under others."""

from __future__ import annotations

import re

# Spark's condition, or the start of one, and the dialect's.
_BY_CONDITION = {
    "REMAINDER_BY_ZERO": "DIVIDE_BY_ZERO",
    "DATATYPE_MISMATCH.IN_SUBQUERY_LENGTH_MISMATCH": "DATATYPE_MISMATCH.INVALID_IN_SUBQUERY",
    "DATETIME_FIELD_OUT_OF_BOUNDS.WITH_SUGGESTION": "DATETIME_FIELD_OUT_OF_BOUNDS",
    "EXPECT_TABLE_NOT_VIEW.NO_ALTERNATIVE": "EXPECT_TABLE_NOT_VIEW",
    "INSERT_COLUMN_ARITY_MISMATCH.NOT_ENOUGH_DATA_COLUMNS": "INSERT_COLUMN_ARITY_MISMATCH",
    "INSERT_COLUMN_ARITY_MISMATCH.TOO_MANY_DATA_COLUMNS": "INSERT_COLUMN_ARITY_MISMATCH",
    "INVALID_SQL_SYNTAX.FUNCTION_WITH_UNSUPPORTED_SYNTAX": "INVALID_DISTINCT",
    "INVALID_EXTRACT_FIELD": "INVALID_PARAMETER_VALUE.DATETIME_UNIT",
    "NUMERIC_VALUE_OUT_OF_RANGE.WITH_SUGGESTION": "NUMERIC_VALUE_OUT_OF_RANGE",
    "UNSUPPORTED_GENERATOR.NESTED_IN_EXPRESSIONS": "UNSUPPORTED_GENERATOR.NOT_GENERATOR",
    "UNSUPPORTED_GENERATOR.NOT_GENERATOR": "UNSUPPORTED_GENERATOR",
    "UNSUPPORTED_GENERATOR.OUTSIDE_SELECT": "UNSUPPORTED_GENERATOR",
    "INVALID_LAMBDA_FUNCTION_CALL.NON_HIGHER_ORDER_FUNCTION": "INVALID_LAMBDA_FUNCTION_CALL",
    "_LEGACY_ERROR_TEMP_1037": "MISSING_ORDER_BY_FOR_WINDOW",
    "_LEGACY_ERROR_TEMP_1034": "UNSUPPORTED_EXPR_FOR_WINDOW",
}
# Where the condition says too little, words of the message.
_BY_MESSAGE = (
    (r"[Ww]indow function \S+ requires window to be ordered|requires (?:a )?window .*order", "MISSING_ORDER_BY_FOR_WINDOW"),
    (r"not allowed to use (?:a )?window function", "UNSUPPORTED_EXPR_FOR_WINDOW"),
    (r"[Ii]llegal sequence boundaries", "INVALID_PARAMETER_VALUE.SEQUENCE_STEP"),
    (r"LambdaFunction|lambda function", "INVALID_LAMBDA_FUNCTION_CALL"),
)


class DialectError(Exception):
    """An error under the dialect's name; ``condition`` holds it."""

    def __init__(self, condition: str, message: str):
        super().__init__(f"[{condition}] {message}")
        self.condition = condition


def condition_of(error: BaseException) -> str:
    """The dialect's name of an error: from its condition, from a condition quoted in its text, or from its words."""
    if isinstance(error, DialectError):
        return error.condition
    own = getattr(error, "condition", None)
    got = getattr(error, "getCondition", None)
    name = own or (got() if got else None)
    message = str(error)
    if name is None:
        quoted = re.search(r"\[([A-Z_]+(?:\.[A-Z_]+)*)\]", message)
        name = quoted.group(1) if quoted else None
    if name in _BY_CONDITION:
        return _BY_CONDITION[name]
    if name is None or name.startswith(("_LEGACY", "INTERNAL_ERROR")):
        return next((c for rx, c in _BY_MESSAGE if re.search(rx, message)), name or "INTERNAL_ERROR")
    if name == "INVALID_TYPED_LITERAL" and "INTERVAL" in message:
        return "INVALID_INTERVAL_FORMAT"
    if name == "PARSE_SYNTAX_ERROR" and re.search(r"INTERVAL\s", message, re.I) and "interval" in message.lower():
        return "INVALID_INTERVAL_FORMAT"
    return name


def translated(error: BaseException) -> DialectError:
    return error if isinstance(error, DialectError) else DialectError(condition_of(error), str(error).splitlines()[0])
