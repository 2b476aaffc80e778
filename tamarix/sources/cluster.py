"""A cluster: catalogs (databases) as folders under one root, and who may log in to which.

    cluster = Cluster(spark, root)
    cluster.create("sales")
    session = cluster.session("sales")
    session.execute("CREATE DATABASE other"); session.execute("EXECUTE list_catalog_users('sales')")
"""

from __future__ import annotations

import hashlib
import json
import re
import secrets

from pyspark.sql import DataFrame, SparkSession

from tamarix import errors
from tamarix.privileges import Privilege

from .store import Session, Store


class Cluster:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._top = Store(spark, f"{self.root}/users", "users")  # the users' versions, committed like tables
        self.fs = self._top.fs

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalogs/{name}")

    def catalogs(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalogs")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def create(self, name: str, exists_ok: bool = False) -> Store:
        if not re.fullmatch(r"\w+", name):
            raise errors.SyntaxError_(f"not a name: {name}")
        name = name.lower()
        if name in self.catalogs():
            if not exists_ok:
                raise errors.DuplicateCatalog(name)
        else:
            self.fs.mkdirs(self._folder(name))
        return self.store(name)

    def store(self, name: str) -> Store:
        if name.lower() not in self.catalogs():
            raise errors.UndefinedCatalog(name)
        return Store(self.spark, f"{self.root}/catalogs/{name.lower()}", name)

    def session(self, catalog: str, privileges: int = Privilege.SUPER_USER, user: str | None = None, acl=None) -> Session:
        session = self.store(catalog).session(privileges, user, acl, cluster=self)
        if privileges & Privilege.ALTER_SYSTEM_SCHEMA:
            session.procedures["set_catalog_user_credential"] = self.set_user
            session.procedures["list_catalog_users"] = self.users
        return session

    # Users: {catalog: {user: salted hash of the password}}

    def _read(self) -> dict:
        return self._top.version(self._top.latest())

    def set_user(self, catalog: str, user: str, password: str) -> str:
        """Set the password of a user, new or known; other users stay as they are."""
        if catalog.lower() not in self.catalogs():
            raise errors.UndefinedCatalog(catalog)
        salt = secrets.token_hex(16)
        made = f"{salt}${hashlib.scrypt(password.encode(), salt=salt.encode(), n=1 << 12, r=8, p=1).hex()}"
        while True:
            latest = self._top.latest()
            users = json.loads(json.dumps(self._top.version(latest)))
            users.setdefault(catalog.lower(), {})[user] = made
            if self._top.add_version(latest + 1, users):
                return user

    def users(self, catalog: str) -> DataFrame:
        """(catalog, user) of a catalog's users; passwords are never shown."""
        return self.spark.createDataFrame([(catalog.lower(), u) for u in sorted(self._read().get(catalog.lower(), {}))], "catalog string, user string")

    def may_enter(self, catalog: str, user: str, password: str) -> bool:
        salt, _, made = self._read().get(catalog.lower(), {}).get(user, "").partition("$")
        return bool(made) and secrets.compare_digest(made, hashlib.scrypt(password.encode(), salt=salt.encode(), n=1 << 12, r=8, p=1).hex())
