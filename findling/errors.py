"""Errors that describe a request's behaviour."""


class SearchError(Exception):
    """Base of all errors of this library; ``kind`` is its name in error bodies."""

    kind = "search_exception"

    def body(self) -> dict:
        return {"error": {"type": self.kind, "reason": str(self)}}


class ParsingError(SearchError):
    kind = "parsing_exception"


class IndexNotFound(SearchError):
    kind = "index_not_found_exception"


class IndexExists(SearchError):
    kind = "resource_already_exists_exception"


class IllegalArgument(SearchError):
    kind = "illegal_argument_exception"


class AmbiguousColumn(SearchError):
    kind = "ambiguous_column_reference_exception"


class GroupByText(SearchError):
    kind = "group_by_text_field_exception"


class SqlFailed(SearchError):
    kind = "sql_execution_exception"


class DocumentMissing(SearchError):
    kind = "document_missing_exception"


class StrictMapping(SearchError):
    kind = "strict_dynamic_mapping_exception"
