"""Errors with their SQLSTATE codes."""


class EngineError(Exception):
    sqlstate = "XX000"


class SyntaxError_(EngineError):
    sqlstate = "42601"


class TransactionStateError(EngineError):
    sqlstate = "25000"


class UniqueViolation(EngineError):
    sqlstate = "23505"


class NotNullViolation(EngineError):
    sqlstate = "23502"


class PrivilegeError(EngineError):
    sqlstate = "42501"


class UndefinedTable(EngineError):
    sqlstate = "42P01"


class DuplicateTable(EngineError):
    sqlstate = "42P07"


class UndefinedColumn(EngineError):
    sqlstate = "42703"


class SerializationFailure(EngineError):
    sqlstate = "40001"


class TooLong(EngineError):
    sqlstate = "22001"


class InvalidText(EngineError):
    sqlstate = "22P02"


class UndefinedCatalog(EngineError):
    sqlstate = "3D000"


class DuplicateCatalog(EngineError):
    sqlstate = "42P04"
