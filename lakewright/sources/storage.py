"""Files of a table: Hadoop file systems, with plain file calls for local paths.

`put_if_absent` is the only operation that must be atomic. Locally a finished temporary file is hard-linked to its name,
so that a reader never sees part of it. Elsewhere Hadoop's create without overwrite is used where a file system is known to
decide it by itself, and a conditional write where it can be asked for one. Other file systems are refused for commits
unless spark.lakewright.atomicCreate names their schemes, separated by commas.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..errors import TableError

# Schemes whose create without overwrite is atomic, and those that can be asked for a conditional write (fixed values).
ATOMIC = frozenset({"file", "hdfs", "viewfs", "webhdfs", "swebhdfs", "abfs", "abfss", "gs"})
CONDITIONAL = frozenset({"s3a"})
_CONDITION = "fs.option.create.conditional.overwrite"
VOUCHED = "spark.lakewright.atomicCreate"


@dataclass(frozen=True)
class FileStatus:
    key: str
    size: int
    modified: int  # milliseconds


class Storage:
    """Keys are relative paths with `/`; they cannot leave the root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/") if root.rstrip("/") else root
        local = self.root.removeprefix("file://") if self.root.startswith("file:///") else self.root.removeprefix("file:")
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        self.local = local if self.root.startswith("file:") or ("://" not in self.root and default.startswith("file:")) else None
        if self.local is not None:
            self.local = os.path.abspath(self.local)

    @property
    def scheme(self) -> str:
        if self.local is not None:
            return "file"
        default = self.spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return (self.root if ":/" in self.root else default).split(":", 1)[0].lower()

    def _check(self, key: str) -> str:
        if not key or key.startswith("/") or "\\" in key or any(p in ("", ".", "..") for p in key.split("/")):
            raise ValueError(f"not a key: {key!r}")
        return key

    def uri(self, key: str) -> str:
        """What Spark reads."""
        self._check(key)
        return f"file://{self.local}/{key}" if self.local is not None else f"{self.root}/{key}"

    def key_of(self, uri: str) -> str:
        """The key of a path as `_metadata.file_path` gives it, which encodes it once more."""
        plain = unquote(uri)
        root = self.local if self.local is not None else self.root.split("://", 1)[-1]
        at = plain.find(f"{root}/")
        if at < 0:
            raise ValueError(f"{uri} is not below {self.root}")
        return plain[at + len(root) + 1 :]

    def _fs(self, key: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def read(self, key: str) -> bytes:
        self._check(key)
        if self.local is not None:
            with open(f"{self.local}/{key}", "rb") as f:
                return f.read()
        fs, path = self._fs(key)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_if_absent(self, key: str, data: bytes) -> bool:
        """Whether this call made the file."""
        self._check(key)
        if self.local is not None:
            target = f"{self.local}/{key}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
        scheme = self.scheme
        if scheme not in ATOMIC | CONDITIONAL and scheme not in self.spark.conf.get(VOUCHED, "").replace(" ", "").split(","):
            raise TableError(f"commits to {scheme}: are not known to be atomic; name it in {VOUCHED} if no two writers can both create a file")
        fs, path = self._fs(key)
        if fs.exists(path):
            return False
        try:
            if scheme in CONDITIONAL:
                stream = fs.createFile(path).recursive().overwrite(False).must(_CONDITION, "true").build()
            else:
                stream = fs.create(path, False)
            stream.write(data)
            stream.close()
        except Exception:
            if fs.exists(path):
                return self.read(key) == data  # told apart by the random names that every commit holds
            raise
        return True

    def write(self, key: str, data: bytes) -> None:
        self._check(key)
        if self.local is not None:
            target = f"{self.local}/{key}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "wb") as f:
                f.write(data)
            os.replace(temporary, target)
            return
        fs, path = self._fs(key)
        stream = fs.create(path, True)
        stream.write(data)
        stream.close()

    def exists(self, key: str) -> bool:
        self._check(key)
        if self.local is not None:
            return os.path.exists(f"{self.local}/{key}")
        fs, path = self._fs(key)
        return fs.exists(path)

    def names(self, directory: str, after: str = "") -> list[str]:
        """Names in a directory that sort after `after`; none where there is no directory."""
        self._check(directory)
        if self.local is not None:
            try:
                found = os.listdir(f"{self.local}/{directory}")
            except FileNotFoundError:
                return []
        else:
            fs, path = self._fs(directory)
            if not fs.exists(path):
                return []
            found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in found if n > after and not n.endswith((".tmp", ".crc")))

    def files(self, directory: str) -> list[FileStatus]:
        """All files below a directory."""
        self._check(directory)
        out = []
        if self.local is not None:
            for top, _, names in os.walk(f"{self.local}/{directory}"):
                for n in names:
                    full = os.path.join(top, n)
                    s = os.stat(full)
                    out.append(FileStatus(os.path.relpath(full, self.local), s.st_size, int(s.st_mtime * 1000)))
            return sorted(out, key=lambda f: f.key)
        fs, path = self._fs(directory)
        if not fs.exists(path):
            return []
        base = self._fs("")[0].makeQualified(self._fs("")[1]).toString()
        it = fs.listFiles(path, True)
        while it.hasNext():
            s = it.next()
            out.append(FileStatus(s.getPath().toString()[len(base) + 1 :], s.getLen(), s.getModificationTime()))
        return sorted(out, key=lambda f: f.key)

    def delete(self, key: str) -> bool:
        """Removes a file or a directory; whether there was one."""
        self._check(key)
        if self.local is not None:
            full = f"{self.local}/{key}"
            if os.path.isdir(full):
                shutil.rmtree(full, ignore_errors=True)
                return True
            try:
                os.unlink(full)
            except FileNotFoundError:
                return False
            for side in (f"{os.path.dirname(full)}/.{os.path.basename(full)}.crc",):
                if os.path.exists(side):
                    os.unlink(side)
            return True
        fs, path = self._fs(key)
        return fs.delete(path, True)

    def rename_if_absent(self, source: str, target: str) -> bool:
        """Moves a directory to a name that nothing has yet."""
        self._check(source), self._check(target)
        if self.local is not None:
            if os.path.exists(f"{self.local}/{target}"):
                return False
            try:
                os.rename(f"{self.local}/{source}", f"{self.local}/{target}")
            except OSError:
                return False
            return True
        fs, old = self._fs(source)
        _, new = self._fs(target)
        return not fs.exists(new) and fs.rename(old, new)
