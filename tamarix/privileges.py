"""Privileges of statements as sets of bits."""

from __future__ import annotations

import enum


class Privilege(enum.IntFlag):
    # The bits as clients store them.
    NONE = 0
    SET_SESSION_PARAMS = 1 << 6
    SELECT_ROWS = 1 << 12
    INSERT_ROWS = 1 << 13
    UPDATE_ROWS = 1 << 14 | SELECT_ROWS
    DELETE_ROWS = 1 << 15 | SELECT_ROWS
    ROWS_PRIVILEGES = SELECT_ROWS | INSERT_ROWS | UPDATE_ROWS | DELETE_ROWS
    READ_TABLE_SCHEMA = 1 << 28
    ALTER_TABLE = 1 << 29
    DROP_TABLE = 1 << 30
    CREATE_TABLE = 1 << 31
    TABLE_PRIVILEGES = CREATE_TABLE | DROP_TABLE | ALTER_TABLE | READ_TABLE_SCHEMA | ROWS_PRIVILEGES
    READ_ONLY = READ_TABLE_SCHEMA | SELECT_ROWS
    READ_SYSTEM_SCHEMA = 1 << 45
    ALTER_SYSTEM_SCHEMA = 1 << 46
    CREATE_DATABASE = 1 << 47
    SUPER_USER = 2**64 - 1


#: What each kind of statement needs; kinds that are not listed need everything.
REQUIRED = {
    "create table": Privilege.CREATE_TABLE,
    "create index": Privilege.CREATE_TABLE,
    "alter table": Privilege.ALTER_TABLE,
    "create external": Privilege.CREATE_TABLE,
    "create database": Privilege.CREATE_DATABASE,
    "drop table": Privilege.DROP_TABLE,
    "drop index": Privilege.DROP_TABLE,
    "explain": Privilege.READ_TABLE_SCHEMA,
    "insert": Privilege.INSERT_ROWS,
    "update": Privilege.UPDATE_ROWS,
    "delete": Privilege.DELETE_ROWS,
    "select": Privilege.SELECT_ROWS,
    "execute": Privilege.SELECT_ROWS,
    "copy": Privilege.SELECT_ROWS,
    "set": Privilege.SET_SESSION_PARAMS,
    "begin": Privilege.NONE,
    "commit": Privilege.NONE,
    "rollback": Privilege.NONE,
}


def allowed(have: int, kind: str) -> bool:
    need = REQUIRED.get(kind, Privilege.SUPER_USER)
    return have & need == need
