"""Flat object stores: key to bytes, conditional create, ordered listing."""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Ability of a file system to create an object only where there is none.
_CONDITIONAL = "fs.option.create.conditional.overwrite"
#: Schemes whose rename is a copy.
_COPYING = ("s3a", "s3", "s3n", "wasb", "oss", "cosn")


class NotFoundError(KeyError):
    """No object has that key."""


class PreconditionError(RuntimeError):
    """An object of that key exists already."""


@dataclass(frozen=True)
class ObjectInfo:
    key: str
    size: int
    etag: str


class ObjectStore(Protocol):
    def put(self, key: str, data: bytes, if_none_match: bool = False) -> ObjectInfo: ...
    def get(self, key: str) -> bytes: ...
    def get_range(self, key: str, offset: int, length: int) -> bytes: ...
    def head(self, key: str) -> ObjectInfo: ...
    def delete(self, key: str) -> None: ...
    def list(self, prefix: str = "") -> list[str]: ...
    def exists(self, key: str) -> bool: ...


def _etag(data: bytes) -> str:
    return hashlib.md5(data, usedforsecurity=False).hexdigest()


class MemoryStore:
    """Objects in this process; for tests."""

    def __init__(self) -> None:
        self._objects: dict[str, bytes] = {}
        self._lock = threading.Lock()

    def put(self, key: str, data: bytes, if_none_match: bool = False) -> ObjectInfo:
        with self._lock:
            if if_none_match and key in self._objects:
                raise PreconditionError(key)
            self._objects[key] = bytes(data)
        return ObjectInfo(key, len(data), _etag(data))

    def get(self, key: str) -> bytes:
        with self._lock:
            if key not in self._objects:
                raise NotFoundError(key)
            return self._objects[key]

    def get_range(self, key: str, offset: int, length: int) -> bytes:
        data = self.get(key)
        if offset < 0 or offset > len(data):
            raise ValueError(f"offset {offset} is beyond {key}")
        return data[offset : offset + length]

    def head(self, key: str) -> ObjectInfo:
        data = self.get(key)
        return ObjectInfo(key, len(data), _etag(data))

    def delete(self, key: str) -> None:
        with self._lock:
            self._objects.pop(key, None)

    def list(self, prefix: str = "") -> list[str]:
        with self._lock:
            return sorted(k for k in self._objects if k.startswith(prefix))

    def exists(self, key: str) -> bool:
        with self._lock:
            return key in self._objects


class HadoopStore:
    """Objects under a path of any file system that Spark can reach (local, HDFS, S3).

    A conditional create is exclusive, and readers see all of an object or nothing: by a hard link on a local disk; by
    the store's own conditional create where it has one (``fs.option.create.conditional.overwrite``); elsewhere by
    renaming a draft to a name that must be free, which file systems like HDFS do at once. Object stores
    that copy to rename and have no conditional create are refused.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        parsed = urlparse(self.root)
        self._local = parsed.path if parsed.scheme in ("", "file") else None
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def uri(self, key: str) -> str:
        return f"{self.root}/{key}" if key else self.root

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(key))

    def put(self, key: str, data: bytes, if_none_match: bool = False) -> ObjectInfo:
        if self._local is not None:
            self._put_local(os.path.join(self._local, key), data, if_none_match)
        elif if_none_match:
            self._put_new(key, data)
        else:
            self._fill(self._fs.create(self._path(key), True), data)
        return ObjectInfo(key, len(data), _etag(data))

    @staticmethod
    def _fill(out, data: bytes) -> None:
        out.write(bytearray(data))
        out.close()

    def _put_new(self, key: str, data: bytes) -> None:
        """Create an object that must not exist."""
        target = self._path(key)
        if self._fs.exists(target):
            raise PreconditionError(key)
        try:
            if self._fs.hasPathCapability(target, _CONDITIONAL):
                self._fill(self._fs.createFile(target).must(_CONDITIONAL, "true").overwrite(True).recursive().build(), data)
                return
            if self._fs.getScheme() in _COPYING:
                raise RuntimeError(f"{self._fs.getScheme()} has no conditional create here")
            draft = self._path(f"{key.rpartition('/')[0]}/.{uuid.uuid4().hex}.draft")
            self._fill(self._fs.create(draft, False), data)
            try:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
                gateway = self.spark.sparkContext._gateway
                context.rename(draft, target, gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            finally:
                self._fs.delete(draft, False)
        except Py4JJavaError as e:
            if any(sign in str(e.java_exception) for sign in ("AlreadyExists", "412", "recondition", "onflict")):
                raise PreconditionError(key) from e
            raise

    @staticmethod
    def _put_local(path: str, data: bytes, if_none_match: bool) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.draft"
        with open(draft, "xb") as f:
            f.write(data)
        try:
            if if_none_match:
                os.link(draft, path)  # fails if it exists; readers never see a part
            else:
                os.replace(draft, path)
        except FileExistsError:
            raise PreconditionError(path) from None
        finally:
            if os.path.exists(draft):
                os.remove(draft)

    def get(self, key: str) -> bytes:
        return self.get_range(key, 0, self.head(key).size)

    def get_range(self, key: str, offset: int, length: int) -> bytes:
        size = self.head(key).size
        if offset < 0 or offset > size:
            raise ValueError(f"offset {offset} is beyond {key}")
        stream = self._fs.open(self._path(key))
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(min(length, size - offset)))
        finally:
            stream.close()

    def head(self, key: str) -> ObjectInfo:
        if not self.exists(key):
            raise NotFoundError(key)
        status = self._fs.getFileStatus(self._path(key))
        return ObjectInfo(key, status.getLen(), f"{status.getModificationTime():x}-{status.getLen():x}")

    def delete(self, key: str) -> None:
        self._fs.delete(self._path(key), True)

    def list(self, prefix: str = "") -> list[str]:
        folder = prefix.rpartition("/")[0]
        if not self._fs.exists(self._path(folder)):
            return []
        found, base = [], self._fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        files = self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            key = files.next().getPath().toString().removeprefix(base)
            name = key.rpartition("/")[2]
            if key.startswith(prefix) and not (name.startswith(".") and name.endswith((".draft", ".crc"))):
                found.append(key)
        return sorted(found)

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(key))


def s3_options(endpoint: str = "", region: str = "", access_key: str = "", secret_key: str = "") -> dict[str, str]:
    """Session settings for S3 and compatible services; static credentials need both halves."""
    out = {"spark.hadoop.fs.s3a.endpoint.region": region or "auto"} if endpoint or region else {}
    if endpoint:
        out |= {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": "true"}
    if bool(access_key) != bool(secret_key):
        raise ValueError("an access key and a secret key go together")
    if access_key:
        out |= {"spark.hadoop.fs.s3a.access.key": access_key, "spark.hadoop.fs.s3a.secret.key": secret_key}
    return out


def r2_options(account: str, access_key: str, secret_key: str) -> dict[str, str]:
    """Session settings for an R2 account: region ``auto``, path style."""
    if not account:
        raise ValueError("an account is needed")
    return s3_options(f"https://{account}.r2.cloudflarestorage.com", "auto", access_key, secret_key)
