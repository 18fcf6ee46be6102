"""A Python data source over file trees: one partition for each top-level entry.

spark.dataSource.register(FsTree); spark.read.format("fstree").option("path", root)
yields path, kind, mode, uid, gid, mtime_secs, mtime_nanos, size, nlink, dev,
ino, link_target, xattrs, acl, fcaps, quota_id (null: not asked of the kernel),
rdev, warning. Entries come in walk order within a partition; unreadable ones
raise, or with skipErrors become a row that has a path and a warning only. A root
that is a symlink to a directory is followed, its extras are not read. With the
option file the path is one file, a link or a device, called by its name or by
the option as; a directory is an error then. Files and directories have all
extras (capabilities: files only), devices, fifos and sockets attributes and
ACL, links none. Patterns in `exclude` (one a line) keep excluded
directories from being listed at all.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codecs, patterns

SCHEMA = "path string, kind string, mode long, uid long, gid long, mtime_secs long, mtime_nanos int, size long, nlink long, dev long, ino long, link_target string, xattrs array<struct<name:string,value:binary>>, acl struct<users:array<struct<id:bigint,perm:bigint>>,groups:array<struct<id:bigint,perm:bigint>>,group_obj:bigint,default:struct<user_obj:bigint,group_obj:bigint,other:bigint,mask:bigint>,default_users:array<struct<id:bigint,perm:bigint>>,default_groups:array<struct<id:bigint,perm:bigint>>>, fcaps binary, quota_id long, rdev array<bigint>, warning string"
_KINDS = ((stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "symlink"), (stat.S_ISBLK, "block"), (stat.S_ISCHR, "char"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"))


class Top(InputPartition):
    def __init__(self, name: str):
        self.name = name


class FsTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.skip = str(options.get("skipErrors", "false")).lower() == "true"
        self.one = str(options.get("file", "false")).lower() == "true"
        self.name = options.get("as") or os.path.basename(self.root.rstrip("/"))
        self.patterns = [patterns.parse(x) for x in options.get("exclude", "").split("\n") if x]

    def partitions(self):
        if self.one:
            return [Top(self.name)]
        return [Top(""), *(Top(n) for n in sorted(os.listdir(self.root), key=os.fsencode))]

    def gone(self, path: str, is_dir: bool) -> bool:
        hit = [p for p in self.patterns if p.matches(path, is_dir)]
        return bool(hit) and not hit[-1].include

    def row(self, path: str, st: os.stat_result):
        kind = next((k for test, k in _KINDS if test(st.st_mode)), None)
        if kind is None:
            raise OSError(f"unsupported file type: {path}")
        full = self.full(path)
        extras, acl, fcaps = [], None, None
        if kind != "symlink" and not (not path and os.path.islink(self.root)):
            every = sorted(os.listxattr(full, follow_symlinks=False))

            def value(name: str) -> bytes | None:
                return os.getxattr(full, name, follow_symlinks=False) if name in every else None

            extras = [(n, value(n)) for n in every if not n.startswith("system.") and n != "security.capability"]
            acl = codecs.acl_struct(value("system.posix_acl_access"), value("system.posix_acl_default"))
            fcaps = value("security.capability") if kind == "file" else None
        secs, nanos = divmod(st.st_mtime_ns, 10**9)
        link = os.readlink(full) if kind == "symlink" else None
        rdev = [os.major(st.st_rdev), os.minor(st.st_rdev)] if kind in ("block", "char") else None
        return path, kind, st.st_mode, st.st_uid, st.st_gid, secs, nanos, st.st_size if kind == "file" else 0, st.st_nlink, st.st_dev, st.st_ino, link, extras, acl, fcaps, None, rdev, None

    def full(self, path: str) -> str:
        return self.root if self.one or not path else os.path.join(self.root, path)

    def warned(self, path: str, error: OSError):
        return (path, *[None] * 16, f"{path}: {error.strerror or error}")

    def read(self, partition: Top):
        if not partition.name:
            yield self.row("", os.stat(self.root))
            return
        if self.one:
            st = os.lstat(self.root)
            if stat.S_ISDIR(st.st_mode):
                raise IsADirectoryError(self.root)
            yield self.row(partition.name, st)
            return
        todo = [partition.name]
        while todo:
            path = todo.pop()
            try:
                st = os.lstat(os.path.join(self.root, path))
                if self.gone(path, stat.S_ISDIR(st.st_mode)):
                    continue
                yield self.row(path, st)
                if stat.S_ISDIR(st.st_mode):
                    todo += [f"{path}/{n}" for n in sorted(os.listdir(os.path.join(self.root, path)), key=os.fsencode, reverse=True)]
            except OSError as error:
                if not self.skip:
                    raise
                yield self.warned(path, error)


class FsTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FsTreeReader:
        return FsTreeReader(self.options)
