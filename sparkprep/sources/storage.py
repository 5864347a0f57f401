"""Object stores behind one small interface: local, in memory, HTTP, and whatever Hadoop file systems reach (s3a, hdfs, ...)."""

from __future__ import annotations

import os
import re
import threading
import urllib.error
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import SparkSession

from sparkprep.errors import InvalidConfig, NotFound, StorageError


class Storage(Protocol):
    def list(self, prefix: str) -> list[str]: ...
    def get(self, key: str) -> bytes: ...
    def put(self, key: str, data: bytes) -> None: ...
    def delete(self, key: str) -> None: ...
    def exists(self, key: str) -> bool: ...
    def size(self, key: str) -> int: ...


class LocalStorage:
    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _at(self, key: str) -> Path:
        path = (self.root / key).resolve()
        if not path.is_relative_to(self.root.resolve()):
            raise StorageError(f"{key} is outside the root")
        return path

    def list(self, prefix: str = "") -> list[str]:
        return sorted(k for p in self.root.rglob("*") if p.is_file() and (k := p.relative_to(self.root).as_posix()).startswith(prefix))

    def get(self, key: str) -> bytes:
        try:
            return self._at(key).read_bytes()
        except FileNotFoundError as e:
            raise NotFound(key) from e

    def put(self, key: str, data: bytes) -> None:
        path = self._at(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.part")
        part.write_bytes(data)
        os.replace(part, path)

    def delete(self, key: str) -> None:
        self._at(key).unlink(missing_ok=True)

    def exists(self, key: str) -> bool:
        return self._at(key).is_file()

    def size(self, key: str) -> int:
        if not self.exists(key):
            raise NotFound(key)
        return self._at(key).stat().st_size


class MemoryStorage:
    def __init__(self):
        self._data: dict[str, bytes] = {}
        self._lock = threading.Lock()

    def list(self, prefix: str = "") -> list[str]:
        return sorted(k for k in self._data if k.startswith(prefix))

    def get(self, key: str) -> bytes:
        if key not in self._data:
            raise NotFound(key)
        return self._data[key]

    def put(self, key: str, data: bytes) -> None:
        with self._lock:
            self._data[key] = bytes(data)

    def delete(self, key: str) -> None:
        with self._lock:
            self._data.pop(key, None)

    def exists(self, key: str) -> bool:
        return key in self._data

    def size(self, key: str) -> int:
        return len(self.get(key))

    def clear(self) -> None:
        self._data.clear()


class HadoopWriter:
    def __init__(self, stream):
        self._stream = stream

    def write(self, data: bytes) -> None:
        for at in range(0, len(data), 8 << 20):
            self._stream.write(bytearray(data[at : at + (8 << 20)]))


class HadoopStorage:
    """Keys below a URI that Spark's Hadoop file systems can open."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        base = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._base = self._fs.makeQualified(base).toString()

    def _at(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def list(self, prefix: str = "") -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        it, out = self._fs.listFiles(self._at(""), True), []
        while it.hasNext():
            key = it.next().getPath().toString()[len(self._base) :].lstrip("/")
            if key.startswith(prefix):
                out.append(key)
        return sorted(out)

    def glob(self, pattern: str) -> list[str]:
        """Names directly below the root; nothing further down is listed."""
        return sorted(x.getPath().getName() for x in self._fs.globStatus(self._at(pattern)) or ())

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise NotFound(key)
        stream = self._fs.open(self._at(key))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        with self.writer(key) as out:
            out.write(data)

    @contextmanager
    def writer(self, key: str) -> Iterator[HadoopWriter]:
        stream = self._fs.create(self._at(key), True)
        try:
            yield HadoopWriter(stream)
        finally:
            stream.close()

    def get_range(self, key: str, start: int, size: int) -> bytes:
        """Bytes from a place on."""
        if not self.exists(key):
            raise NotFound(key)
        stream, out = self._fs.open(self._at(key)), self._jvm.java.io.ByteArrayOutputStream()
        try:
            stream.seek(start)
            self._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
            return bytes(out.toByteArray())
        finally:
            stream.close()

    def delete(self, key: str, folder: bool = False) -> None:
        self._fs.delete(self._at(key), folder)

    def rename(self, old: str, new: str) -> None:
        """Give a key another name, at once; raise if that one is taken."""
        if self.exists(new) or not self._fs.rename(self._at(old), self._at(new)):
            raise StorageError(f"{old} can't be renamed to {new}")

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def size(self, key: str) -> int:
        if not self.exists(key):
            raise NotFound(key)
        return self._fs.getFileStatus(self._at(key)).getLen()


def qualified(path: str) -> str:
    return path if re.match(r"\w[\w+.-]*:", path) else f"file://{os.path.abspath(path)}"


def arrow_uri(spark: SparkSession, path: str) -> str:
    """The path as Arrow's file systems know it; mount tables are resolved, as far as the path exists."""
    where, rest = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(qualified(path)), ""
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while not store.exists(where) and where.getParent() is not None:
        where, rest = where.getParent(), f"/{quote(where.getName())}{rest}"
    found = store.resolvePath(where).toUri().toString().rstrip("/") + rest
    return re.sub(r"^s3a:", "s3:", re.sub(r"^file:/(?!/)", "file:///", found))


def s3_options(endpoint: str | None = None, access_key: str | None = None, secret_key: str | None = None, anonymous: bool = False) -> dict[str, str]:
    """Spark settings for an S3-compatible store; a custom endpoint is addressed by path."""
    out = {}
    if endpoint:
        out |= {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": "true"}
    if access_key is not None and secret_key is not None:
        out |= {"spark.hadoop.fs.s3a.access.key": access_key, "spark.hadoop.fs.s3a.secret.key": secret_key}
    elif anonymous:
        out["spark.hadoop.fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return out


class HttpClient:
    """One request; a fake of it serves tests."""

    def __init__(self, timeout: float = 30.0):
        self.timeout = timeout

    def request(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> tuple[int, dict[str, str], bytes]:
        ask = urllib.request.Request(url, data=body, headers=headers or {}, method=method)
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()
        except OSError as e:
            raise StorageError(f"{method} {url}: {e}") from e


class HttpStorage:
    """Read-only, with byte ranges where the server has them."""

    def __init__(self, base: str, client: HttpClient | None = None, token: str | None = None):
        self.base, self.client = base.rstrip("/"), client or HttpClient()
        self.headers = {"Authorization": f"Bearer {token}"} if token else {}

    def _ask(self, method: str, key: str, **headers: str) -> tuple[int, dict[str, str], bytes]:
        status, got, body = self.client.request(method, f"{self.base}/{key.lstrip('/')}", self.headers | headers)
        if status == 404:
            raise NotFound(key)
        if status >= 400:
            raise StorageError(f"{method} {key}: status {status}")
        return status, got, body

    def get(self, key: str) -> bytes:
        return self._ask("GET", key)[2]

    def get_range(self, key: str, start: int, end: int) -> bytes:
        """Bytes start to end, both included."""
        if end < start:
            raise InvalidConfig("an empty range")
        status, _, body = self._ask("GET", key, Range=f"bytes={start}-{end}")
        return body if status == 206 else body[start : end + 1]

    def supports_range(self, key: str) -> bool:
        return self._ask("HEAD", key)[1].get("accept-ranges", "none") == "bytes"

    def exists(self, key: str) -> bool:
        try:
            self._ask("HEAD", key)
        except NotFound:
            return False
        return True

    def size(self, key: str) -> int:
        length = self._ask("HEAD", key)[1].get("content-length")
        if length is None:
            raise StorageError(f"no length of {key}")
        return int(length)

    def list(self, prefix: str = "") -> list[str]:
        raise StorageError("HTTP has no listing")

    def put(self, key: str, data: bytes) -> None:
        raise StorageError("HTTP is read-only")

    def delete(self, key: str) -> None:
        raise StorageError("HTTP is read-only")


def open_storage(uri: str, spark: SparkSession | None = None) -> Storage:
    """By scheme: memory:, http(s):, a local path or file:, and everything else through Hadoop."""
    if uri.startswith("memory:"):
        return MemoryStorage()
    if uri.startswith(("http://", "https://")):
        return HttpStorage(uri)
    if "://" not in uri or uri.startswith("file://"):
        return LocalStorage(uri.removeprefix("file://"))
    if spark is None:
        raise InvalidConfig(f"a session is needed for {uri}")
    return HadoopStorage(spark, uri)
