"""A directory tree as a table: hidden files too, symbolic links and directories not."""

from __future__ import annotations

import base64
import os
import stat
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STAT = "path string, name string, size long, mtime timestamp, atime timestamp, ctime timestamp, mode int, uid int, gid int, dev long, inode long"


XATTR_ENTRIES, XATTR_NAME_BYTES = 4_096, 1 << 20


def xattrs(path: str, most: int) -> dict[str, str] | None:
    """Extended attributes in Base64, each cut to `most` bytes (0: whole); none where they cannot be read."""
    try:
        names = os.listxattr(path, follow_symlinks=False)
        if len(names) > XATTR_ENTRIES or sum(len(n) + 1 for n in names) > XATTR_NAME_BYTES:
            return None
        values = {n: os.getxattr(path, n, follow_symlinks=False) for n in names}
    except (OSError, AttributeError):
        return None
    return {n: base64.b64encode(v[:most] if most > 0 else v).decode() for n, v in values.items()} or None


def acl(path: str) -> str | None:
    """The text of getfacl where that tool exists; else none."""
    try:
        done = subprocess.run(["getfacl", "-cp", "--", path], capture_output=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace").strip() or None


def private_file(path: str):
    """A file for the owner alone, opened to be written anew; a link in its place or among its parents, or anything but a file, is refused."""
    full = os.path.abspath(path)
    above = os.path.dirname(full)
    if os.path.realpath(above) != above:
        raise PermissionError(f"a link leads to {path}")
    fd = os.open(full, os.O_WRONLY | os.O_CREAT | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0), 0o600)
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        os.close(fd)
        raise PermissionError(f"{path} is not a file")
    os.ftruncate(fd, 0)
    os.fchmod(fd, 0o600)
    return os.fdopen(fd, "wb")


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], content: bool, most: int, xattr_bytes: int | None = None, with_acl: bool = False) -> None:
        self.roots, self.content, self.most = roots, content, most
        self.xattr_bytes, self.with_acl = xattr_bytes, with_acl

    def partitions(self):
        """One for each root's own files, one for each directory below it."""
        out = []
        for root in self.roots:
            out.append(InputPartition((root, False)))
            try:
                out += [InputPartition((e.path, True)) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
            except OSError:
                pass
        return out

    def read(self, partition):
        import datetime

        top, deep = partition.value
        utc = lambda t: datetime.datetime.fromtimestamp(t, datetime.timezone.utc)
        todo = [top]
        while todo:
            here = todo.pop()
            try:
                entries = sorted(os.scandir(here), key=lambda e: e.name) if os.path.isdir(here) else []
                names = [(e.path, e.name) for e in entries] if entries or os.path.isdir(here) else [(here, os.path.basename(here))]
            except OSError:
                continue
            for path, name in names:
                try:
                    s = os.lstat(path)
                except OSError:
                    continue
                if stat.S_ISDIR(s.st_mode):
                    if deep:
                        todo.append(path)
                elif stat.S_ISREG(s.st_mode):
                    more = () if self.xattr_bytes is None else (xattrs(path, self.xattr_bytes),)
                    more += (acl(path),) if self.with_acl else ()
                    row = (path, name, s.st_size, utc(s.st_mtime), utc(s.st_atime), utc(s.st_ctime), s.st_mode, s.st_uid, s.st_gid, s.st_dev, s.st_ino, *more)
                    if not self.content:
                        yield row
                        continue
                    try:
                        with open(path, "rb") as f:
                            yield (*row, f.read() if self.most <= 0 else f.read(self.most))
                    except OSError:
                        yield (*row, None)


class TreeSource(DataSource):
    """Options: roots (separated by newlines), content and acl (true or false), max_bytes, xattr_bytes (unset: no such column)."""

    @classmethod
    def name(cls) -> str:
        return "graniteer_tree"

    def schema(self) -> str:
        o = self.options
        return STAT + (", xattrs map<string,string>" if "xattr_bytes" in o else "") + (", acl string" if o.get("acl") == "true" else "") + (", content binary" if o.get("content") == "true" else "")

    def reader(self, schema):
        o = self.options
        return TreeReader(o["roots"].split("\n"), o.get("content") == "true", int(o.get("max_bytes", "0")), int(o["xattr_bytes"]) if "xattr_bytes" in o else None, o.get("acl") == "true")


def tree(spark: SparkSession, roots: tuple[str, ...], content: bool = False, max_bytes: int = 0, xattr_bytes: int | None = None, acl: bool = False) -> DataFrame:
    """Regular files under all roots, in no order; a root given twice counts twice."""
    spark.dataSource.register(TreeSource)
    held = {"roots": "\n".join(roots), "content": str(content).lower(), "max_bytes": str(max_bytes), "acl": str(acl).lower()}
    held |= {} if xattr_bytes is None else {"xattr_bytes": str(xattr_bytes)}
    return spark.read.format("graniteer_tree").options(**held).load()


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def permissions(mode: Column) -> Column:
    return F.concat(F.lit("-"), *[F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)])


def base_columns(df: DataFrame) -> DataFrame:
    """What a file record says about a file itself."""
    hidden, read_only = F.col("name").startswith("."), F.col("mode").bitwiseAND(0o222) == 0
    return df.withColumns(
        {
            "mod_time": rfc3339(F.col("mtime")),
            "access_time": rfc3339(F.col("atime")),
            "change_time": rfc3339(F.col("ctime")),
            "attributes": F.array_compact(F.array(F.when(hidden, "hidden"), F.when(read_only, "read-only"))),
            "permissions": permissions(F.col("mode")),
            "owner": F.format_string("uid=%d, gid=%d", "uid", "gid"),
            "file_id": F.format_string("dev=%d,inode=%d", "dev", "inode"),
        }
    )
