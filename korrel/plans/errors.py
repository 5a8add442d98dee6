"""Refusals, by name, with the exit code and the way out that a caller is shown."""

from __future__ import annotations

CONFIG, USAGE, SQL, REFUSED, NOT_GRANTED, LIMIT = 3, 2, 4, 5, 6, 7


class Refusal(Exception):
    """A query that isn't run (or not to its end). ``code`` groups refusals, ``fix`` says what to do instead."""

    code, fix = SQL, ""

    def __init__(self, detail: str = ""):
        super().__init__(f"{type(self).__name__}{': ' + detail if detail else ''}")
        self.detail = detail

    @property
    def name(self) -> str:
        return type(self).__name__


def _refusal(name: str, code: int, fix: str) -> type[Refusal]:
    return type(name, (Refusal,), {"code": code, "fix": fix, "__module__": __name__})


NoDatabase = _refusal("NoDatabase", CONFIG, "register a database first")
UnknownDatabase = _refusal("UnknownDatabase", CONFIG, "use one of the registered names")
DbNameRequired = _refusal("DbNameRequired", CONFIG, "several databases are registered: say which")
InvalidDbConfig = _refusal("InvalidDbConfig", CONFIG, "repair the rules or limits")
DatabaseUnavailable = _refusal("DatabaseUnavailable", CONFIG, "the tables can't be read")
EngineNotSupported = _refusal("EngineNotSupported", CONFIG, "read the source into a DataFrame first")
UnknownOp = _refusal("UnknownOp", USAGE, "use one of the listed operations")
UnknownFormat = _refusal("UnknownFormat", USAGE, "use json, csv or markdown")
MissingTable = _refusal("MissingTable", USAGE, "name a table")
MissingSql = _refusal("MissingSql", USAGE, "send one statement or command")
LimitOutOfRange = _refusal("LimitOutOfRange", USAGE, "limits are at least 1 and at most their ceiling")
EmptyStatement = _refusal("EmptyStatement", SQL, "send one statement")
MultipleStatements = _refusal("MultipleStatements", SQL, "send one statement at a time")
StatementNotRead = _refusal("StatementNotRead", REFUSED, "only SELECT, WITH, VALUES and TABLE are read; changes go through write")
StatementOnlyReads = _refusal("StatementOnlyReads", REFUSED, "run reading statements with query")
TableRefused = _refusal("TableRefused", REFUSED, "the rules keep this table out; tables() lists the others")
TableNotFound = _refusal("TableNotFound", SQL, "tables() lists what there is")
MaskedColumnUsed = _refusal("MaskedColumnUsed", REFUSED, "select a guarded column by itself; compute, filter, join and sort with others")
ActionDenied = _refusal("ActionDenied", REFUSED, "this kind of statement is never run")
FunctionDenied = _refusal("FunctionDenied", REFUSED, "use a listed function")
GuardedColumnInWrite = _refusal("GuardedColumnInWrite", REFUSED, "writes neither read nor set guarded columns")
DestructiveNotGranted = _refusal("DestructiveNotGranted", NOT_GRANTED, "nothing was changed; it needs a grant that allows destruction")
WriteNotGranted = _refusal("WriteNotGranted", NOT_GRANTED, "pass an active grant")
QueryTimeout = _refusal("QueryTimeout", LIMIT, "narrow the query or raise timeout_ms")
RateLimited = _refusal("RateLimited", LIMIT, "wait a minute or raise rate_per_minute")
SqlFailed = _refusal("SqlFailed", SQL, "mend the statement; describe() shows a table's columns")
CommandInvalid = _refusal("CommandInvalid", SQL, "send find, aggregate, distinct or countDocuments as one JSON object")
HiddenFieldUsed = _refusal("HiddenFieldUsed", REFUSED, "leave hidden fields out of filters, sorts and expressions")
MaskedFieldUsed = _refusal("MaskedFieldUsed", REFUSED, "masked fields are returned as they are or not at all")
OperatorDenied = _refusal("OperatorDenied", REFUSED, "use the listed stages and operators")
UnsupportedFrame = _refusal("UnsupportedFrame", SQL, "window frames are ROWS or RANGE, without EXCLUDE")
DepthOutOfRange = _refusal("DepthOutOfRange", USAGE, "depth is 1 to 4")
SubjectNotFound = _refusal("SubjectNotFound", SQL, "no definition has that name")
