"""Archives as bytes: one stream, or metadata and payload apart; written and read.

encode takes the nodes of one tree as dicts in any order (path '' is the root;
files with data, symlinks and hardlinks with link_target, devices with rdev).
decode yields rows; decode_many runs it over a DataFrame of archives.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import codecs as c

MARKER = 16
#: Rows, and bytes of their binary columns, that are handed on at once.
ROWS, BYTES = 1024, 4 << 20


def handed_on(rows: Iterable[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """rows in batches: a batch ends at ROWS, or with the row that reaches BYTES."""
    wide = [i for i, kind in enumerate(kinds) if pa.types.is_binary(kind)]
    part: list[tuple] = []
    held = 0
    for row in rows:
        part.append(row)
        for i in wide:
            held += len(row[i] or b"")
        if len(part) >= ROWS or held >= BYTES:
            done, part, held = part, [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)


def _children(nodes: list[dict]) -> dict[str, list[dict]]:
    below: dict[str, list[dict]] = {}
    for n in nodes:
        if n["path"]:
            below.setdefault(n["path"].rpartition("/")[0], []).append(n)
    for rows in below.values():
        rows.sort(key=lambda n: n["path"].rpartition("/")[2].encode())
    return below


#: The root's child that an archive keeps for the patterns it was made with.
RESERVED = ".pxarexclude-cli"


def encode(nodes: list[dict], version: int = 1, patterns: Sequence[str] = ()) -> tuple[bytes, bytes]:
    """The archive, and for version 2 its payload stream.

    The exclude patterns it was made with are told in it: in version 1 as a file
    that comes last in the root, in version 2 as the prelude. A node of that
    file's name in the root is left out in any case.
    """
    nodes = [n for n in nodes if n["path"] != RESERVED and not n["path"].startswith(RESERVED + "/")]
    below, by = _children(nodes), {n["path"]: n for n in nodes}
    out = bytearray(c.record(c.FORMAT_VERSION, struct.pack("<Q", 2)) if version == 2 else b"")
    text = "".join(f"{p}\n" for p in patterns)
    if text and version == 2:
        out += c.record(c.PRELUDE, json.dumps({"exclude-patterns": text}, separators=(",", ":"), ensure_ascii=False).encode())
    elif text:
        below.setdefault("", []).append({"path": RESERVED, "kind": "file", "mode": 0o100600, "uid": os.getuid(), "gid": os.getgid(), "mtime_secs": 0, "mtime_nanos": 0, "data": text.encode()})
    payload = bytearray(c.record(c.PAYLOAD_START) if version == 2 else b"")
    starts: dict[str, int] = {}

    def add(node: dict) -> int:
        """Writes a node; returns what its item's length has besides the bytes here."""
        path, start = node["path"], len(out)
        name = path.rpartition("/")[2].encode()
        if path:
            out.extend(c.record(c.FILENAME, name + b"\0"))
        if node["kind"] == "hardlink":
            target = node["link_target"]
            if target not in starts:
                raise c.FormatError(f"hardlink {path}: {target} does not come before it")
            out.extend(c.record(c.HARDLINK, struct.pack("<Q", start - starts[target]) + target.encode() + b"\0"))
            return 0
        entry = len(out)
        out.extend(c.metadata(node))
        kind = node["kind"]
        if kind == "directory":
            items = []
            for child in below.get(path, ()):
                at = len(out)
                extra = add(child)
                items.append((c.siphash24(child["path"].rpartition("/")[2].encode()), at, len(out) - at + extra))
            out.extend(c.goodbye(items, entry if path else 0, len(out)))
        elif kind == "file":
            data = node.get("data") or b""
            starts[path] = start
            if version == 2:
                out.extend(c.record(c.PAYLOAD_REF, struct.pack("<QQ", len(payload), len(data))))
                payload.extend(c.record(c.PAYLOAD, data))
                return len(data)
            out.extend(c.record(c.PAYLOAD, data))
        elif kind == "symlink":
            out.extend(c.record(c.SYMLINK, node["link_target"].encode() + b"\0"))
        elif kind in ("block", "char"):
            out.extend(c.record(c.DEVICE, struct.pack("<QQ", *node["rdev"])))
        return 0

    add(by[""])
    if version == 2:
        payload.extend(c.record(c.PAYLOAD_TAIL))
    return bytes(out), bytes(payload)


def told_patterns(meta: bytes) -> list[str]:
    """The exclude patterns an archive tells, from its prelude or its root's last child."""
    text = ""
    for _, kind, body in c.records(meta):
        if kind == c.PRELUDE:
            try:
                text = str(json.loads(body)["exclude-patterns"])
            except (ValueError, KeyError, TypeError):
                raise c.FormatError("a prelude without exclude patterns") from None
        if kind not in (c.FORMAT_VERSION, c.PRELUDE):
            break
    if not text:
        text = next((bytes(n["data"]).decode() for n in decode(meta) if n["path"] == RESERVED and n["data"] is not None), "")
    return [x for x in text.split("\n") if x]


_KINDS = {0o040000: "directory", 0o100000: "file", 0o120000: "symlink", 0o060000: "block", 0o020000: "char", 0o010000: "fifo", 0o140000: "socket"}


def decode(meta: bytes, payload: bytes | None = None) -> Iterator[dict]:
    """Rows of an archive in order: path, kind, stat, size, link_target, start, payload_offset, data."""
    stack: list[str] = []
    name: str | None = None
    node: dict | None = None
    first = True

    def path() -> str:
        return "/".join([*stack[1:], name]) if stack else ""

    def flush() -> Iterator[dict]:
        nonlocal node
        if node is not None:
            if node["kind"] == "directory":
                stack.append(node["path"].rpartition("/")[2])
            done, node = node, None
            yield done

    start = 0
    for at, kind, body in c.records(meta):
        if kind in (c.FORMAT_VERSION, c.PRELUDE) and first:
            continue
        if kind == c.FILENAME:
            yield from flush()
            if not stack:
                raise c.FormatError("entry after the root's end")
            name, start = _string(body), at
            if name in ("", ".", "..") or "/" in name:
                raise c.FormatError(f"invalid name {name!r}")
        elif kind == c.ENTRY:
            if len(body) != 40:
                raise c.FormatError("entry of a wrong length")
            if first:
                start, first = at, False
            mode, _, uid, gid, secs, nanos, _ = struct.unpack("<QQIIqII", body)
            if mode & 0o170000 not in _KINDS:
                raise c.FormatError(f"unknown file type in mode {mode:o}")
            node = {"path": path(), "kind": _KINDS[mode & 0o170000], "mode": mode, "uid": uid, "gid": gid, "mtime_secs": secs, "mtime_nanos": nanos, "size": None, "link_target": None, "start": start, "payload_offset": None, "data": None, "xattrs": [], "acl": None, "fcaps": None, "quota_id": None, "rdev": None}
        elif kind == c.HARDLINK:
            yield {"path": path(), "kind": "hardlink", "mode": None, "uid": None, "gid": None, "mtime_secs": None, "mtime_nanos": None, "size": None, "link_target": _string(body[8:]), "start": start, "payload_offset": start - struct.unpack_from("<Q", body)[0], "data": None, "xattrs": [], "acl": None, "fcaps": None, "quota_id": None, "rdev": None}
        elif kind == c.GOODBYE:
            yield from flush()
            if not stack:
                raise c.FormatError("directory end without a directory")
            stack.pop()
        elif node is None:
            raise c.FormatError(f"record {kind:x} outside an entry")
        elif kind == c.PAYLOAD:
            node["size"], node["data"] = len(body), body
        elif kind == c.PAYLOAD_REF:
            offset, size = struct.unpack("<QQ", body)
            node["size"], node["payload_offset"] = size, offset
            if payload is not None:
                if struct.unpack_from("<QQ", payload, offset) != (c.PAYLOAD, 16 + size) or struct.unpack_from("<Q", payload)[0] != c.PAYLOAD_START:
                    raise c.FormatError("payload reference does not fit the payload")
                node["data"] = payload[offset + 16 : offset + 16 + size]
        elif kind == c.SYMLINK:
            node["link_target"] = _string(body)
        elif kind == c.DEVICE:
            node["rdev"] = list(_numbers(body, 2))
        elif kind == c.XATTR:
            key, zero, value = body.partition(b"\0")
            if not zero:
                raise c.FormatError("attribute without the end of its name")
            node["xattrs"].append({"name": key.decode("utf-8", "surrogateescape"), "value": value})
        elif kind == c.FCAPS:
            node["fcaps"] = body
        elif kind == c.QUOTA:
            node["quota_id"] = _numbers(body, 1)[0]
        elif kind in _ACL_LISTS:
            who, perm = _numbers(body, 2)
            _acl(node)[_ACL_LISTS[kind]].append({"id": who, "perm": perm})
        elif kind == c.ACL_GROUP_OBJ:
            _acl(node)["group_obj"] = _numbers(body, 1)[0]
        elif kind == c.ACL_DEFAULT:
            user, group, other, mask = _numbers(body, 4)
            _acl(node)["default"] = {"user_obj": user, "group_obj": group, "other": other, "mask": None if mask == c.NO_MASK else mask}
        else:
            raise c.FormatError(f"unknown record type {kind:x}")
    if stack or node is not None:
        raise c.FormatError("archive ends inside a directory")


_ACL_LISTS = {c.ACL_USER: "users", c.ACL_GROUP: "groups", c.ACL_DEFAULT_USER: "default_users", c.ACL_DEFAULT_GROUP: "default_groups"}


def _numbers(body: bytes, n: int) -> tuple[int, ...]:
    if len(body) != 8 * n:
        raise c.FormatError("record of a wrong length")
    return struct.unpack(f"<{n}Q", body)


def _acl(node: dict) -> dict:
    if node["acl"] is None:
        node["acl"] = {"users": [], "groups": [], "group_obj": None, "default": None, "default_users": [], "default_groups": []}
    return node["acl"]


def _string(body: bytes) -> str:
    if body[-1:] != b"\0":
        raise c.FormatError("string without its end")
    return body[:-1].decode("utf-8", "surrogateescape")


NODES = "archive string, path string, kind string, mode long, uid long, gid long, mtime_secs long, mtime_nanos long, size long, link_target string, start long, payload_offset long, data binary, xattrs array<struct<name:string,value:binary>>, acl struct<users:array<struct<id:bigint,perm:bigint>>,groups:array<struct<id:bigint,perm:bigint>>,group_obj:bigint,default:struct<user_obj:bigint,group_obj:bigint,other:bigint,mask:bigint>,default_users:array<struct<id:bigint,perm:bigint>>,default_groups:array<struct<id:bigint,perm:bigint>>>, fcaps binary, quota_id long, rdev array<bigint>"


def decode_many(archives: DataFrame, metadata_only: bool = False) -> DataFrame:
    """NODES of archives (archive string, meta binary, payload binary); one archive is one sequence."""
    names = [x.split()[0] for x in NODES.split(", ")]
    entries = pa.list_(pa.struct([("id", pa.int64()), ("perm", pa.int64())]))
    default = pa.struct([(x, pa.int64()) for x in ("user_obj", "group_obj", "other", "mask")])
    acl = pa.struct([("users", entries), ("groups", entries), ("group_obj", pa.int64()), ("default", default), ("default_users", entries), ("default_groups", entries)])
    xattrs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.binary())]))
    kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.int64(), pa.binary(), xattrs, acl, pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, meta, payload in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                part: list[tuple] = []
                for n in decode(meta.as_py(), None if metadata_only else payload.as_py()):
                    part.append((name, *(None if metadata_only and k == "data" else n[k] for k in names[1:])))
                    if len(part) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), kinds)], names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), kinds)], names)

    return archives.select("archive", "meta", "payload").mapInArrow(run, NODES)
