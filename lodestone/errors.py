"""Exceptions and their messages (English and Korean)."""

from __future__ import annotations

from contextvars import ContextVar

_language: ContextVar[str] = ContextVar("language", default="en")

_TEXT: dict[str, tuple[str, str]] = {
    "path.unknown": ("'{0}' has no column or relation '{1}' (path '{2}')", "'{0}'에 '{1}' 열 또는 관계가 없습니다 (경로 '{2}')"),
    "path.relation": ("path '{0}' ends at a relation, not at a column", "경로 '{0}'가 열이 아닌 관계에서 끝납니다"),
    "field.unknown": ("unknown field '{0}' in {1}", "{1}에 없는 필드입니다: '{0}'"),
    "field.operator": ("field '{0}' does not allow {1}; allowed: {2}", "필드 '{0}'는 {1} 연산자를 허용하지 않습니다. 허용: {2}"),
    "field.sort": ("field '{0}' cannot be sorted by", "필드 '{0}'로 정렬할 수 없습니다"),
    "page.both": ("page and size go together", "page와 size는 함께 지정해야 합니다"),
    "page.negative": ("page must be 0 or more", "page는 0 이상이어야 합니다"),
    "page.size": ("size must be more than 0", "size는 0보다 커야 합니다"),
    "value.null": ("field '{0}': {1} needs a value", "필드 '{0}': {1}에는 값이 필요합니다"),
    "value.second": ("field '{0}': {1} needs a second value", "필드 '{0}': {1}에는 두 번째 값이 필요합니다"),
    "value.collection": ("field '{0}': {1} needs a list, got {2}", "필드 '{0}': {1}에는 목록이 필요합니다 ({2})"),
    "value.empty": ("field '{0}': the list is empty", "필드 '{0}': 목록이 비어 있습니다"),
    "value.type": ("field '{0}': {1} is no {2}", "필드 '{0}': {1}은(는) {2} 형식이 아닙니다"),
    "value.size": ("field '{0}': length must be between {1} and {2}", "필드 '{0}': 길이는 {1}에서 {2} 사이여야 합니다"),
    "value.pattern": ("field '{0}': value does not match {1}", "필드 '{0}': 값이 {1} 패턴과 다릅니다"),
    "value.range": ("field '{0}': value must be between {1} and {2}", "필드 '{0}': 값은 {1}에서 {2} 사이여야 합니다"),
    "value.digits": ("field '{0}': at most {1} whole and {2} fractional digits", "필드 '{0}': 정수 {1}자리, 소수 {2}자리까지 허용됩니다"),
    "value.rule": ("field '{0}': value has to be {1}", "필드 '{0}': 값이 {1} 조건을 만족해야 합니다"),
    "value.check": ("field '{0}': value is not allowed", "필드 '{0}': 허용되지 않는 값입니다"),
    "rule.unknown": ("field '{0}': unknown rule '{1}'; known: {2}", "필드 '{0}': 알 수 없는 규칙 '{1}'. 가능한 규칙: {2}"),
    "pattern.empty": ("{0} needs a pattern that is not empty", "{0}에는 비어 있지 않은 패턴이 필요합니다"),
    "pattern.type": ("field '{0}' is neither text nor JSON", "필드 '{0}'는 문자열이나 JSON이 아닙니다"),
    "compare.type": ("field '{0}' cannot be compared by order", "필드 '{0}'는 크기를 비교할 수 없습니다"),
    "group.empty": ("a group holds no condition", "조건이 없는 그룹입니다"),
    "json.invalid": ("not a valid JSON request: {0}", "올바른 JSON 요청이 아닙니다: {0}"),
    "json.conditions": ("'conditions' has to be an array", "'conditions'는 배열이어야 합니다"),
    "json.field": ("a condition lacks its field", "조건에 field가 없습니다"),
    "json.operator": ("a condition lacks its searchOperator", "조건에 searchOperator가 없습니다"),
    "operator.unknown": ("unknown operator '{0}'", "알 수 없는 연산자입니다: '{0}'"),
    "direction.unknown": ("unknown sort direction '{0}'", "알 수 없는 정렬 방향입니다: '{0}'"),
    "param.key": ("'{0}' is not of the form field.operator", "'{0}'는 field.operator 형식이 아닙니다"),
    "param.number": ("'{0}' has to be a whole number of 0 or more", "'{0}'는 0 이상의 정수여야 합니다"),
    "param.sort": ("'{0}' is not of the form field.asc or field.desc", "'{0}'는 field.asc 또는 field.desc 형식이 아닙니다"),
    "param.two": ("{0} takes exactly two values", "{0}에는 정확히 두 개의 값이 필요합니다"),
    "parse.failed": ("'{0}' is no {1}", "'{0}'은(는) {1} 형식이 아닙니다"),
    "parse.enum": ("'{0}' is none of {1}", "'{0}'은(는) {1} 중 하나가 아닙니다"),
    "view.columns": ("a projection needs columns, got {0}", "투영에는 열 목록이 필요합니다 ({0})"),
    "entity.unknown": ("no entity '{0}' is registered", "등록되지 않은 엔터티입니다: '{0}'"),
    "entity.key": ("entity '{0}' has no primary key", "엔터티 '{0}'에 기본 키가 없습니다"),
    "result.several": ("more than one row matches", "둘 이상의 행이 일치합니다"),
    "bucket.window": ("the window's start must be before its end", "구간의 시작은 끝보다 앞서야 합니다"),
    "bucket.count": ("buckets must number 1 to {0}", "버킷 수는 1에서 {0} 사이여야 합니다"),
    "update.column": ("'{0}' has no column '{1}'", "'{0}'에 '{1}' 열이 없습니다"),
}


def set_language(language: str) -> None:
    """'en' or 'ko' for this context; anything else means English."""
    _language.set("ko" if language.lower().startswith("ko") else "en")


def message(key: str, *args: object) -> str:
    return _TEXT[key][_language.get() == "ko"].format(*args)


class SearchError(Exception):
    """Base of all errors of the engine; ``key`` names the message."""

    def __init__(self, key: str, *args: object):
        self.key = key
        super().__init__(message(key, *args) if key in _TEXT else key)


class SearchConfigurationError(SearchError):
    """The catalog or a schema is wrong."""


class SearchValidationError(SearchError):
    """A request breaks a rule; ``problems`` lists all that were found."""

    def __init__(self, key: str, *args: object, problems: list[str] | None = None):
        super().__init__(key, *args)
        self.problems = problems or [str(self)]


class SearchOperationError(SearchError):
    """A terminal cannot give its result."""


class SearchJoinError(SearchError):
    """A dotted path does not lead to a column."""


class SearchParseError(SearchError):
    """A text is no value of the wanted type."""
