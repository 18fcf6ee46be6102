"""Encoders and decoders of archive records, catalogs, indexes, blobs and frames."""

from __future__ import annotations

import hashlib
import hmac
import json
import struct
import zlib
from collections.abc import Iterator

import zstandard

# Record types of the archive format.
ENTRY = 0xD5956474E588ACEF
FILENAME = 0x16701121063917B3
SYMLINK = 0x27F971E7DBF5DC5F
DEVICE = 0x9FC9E906586D5CE9
XATTR = 0x0DAB0229B57DCD03
ACL_USER = 0x2CE8540A457D55B8
ACL_GROUP = 0x136E3ECEB04C03AB
ACL_GROUP_OBJ = 0x10868031E9582876
ACL_DEFAULT = 0xBBBB13415A6896F5
ACL_DEFAULT_USER = 0xC89357B40532CD1F
ACL_DEFAULT_GROUP = 0xF90A8A5816038FFE
FCAPS = 0x2DA9DD9DB5F7FB67
QUOTA = 0xE07540E82F7D1CBB
HARDLINK = 0x51269C8422BD7275
PAYLOAD = 0x28147A1B0B7C1A25
GOODBYE = 0x2FEC4FA642D5731D
GOODBYE_TAIL = 0xEF5EED5B753E1555
FORMAT_VERSION = 0x730F6C75DF16A40D
PRELUDE = 0xE309D79D9F7B771B
PAYLOAD_REF = 0x419D3D6BC4BA977E
PAYLOAD_START = 0x834C68C2194A4ED2
PAYLOAD_TAIL = 0x6C72B78B984C81B5
# The keys of the name hash.
NAME_KEYS = (0x83AC3F1CFBB450DB, 0xAA4F1B6879369FBD)
# Magic numbers of blobs, indexes and catalogs.
BLOB_PLAIN = bytes([66, 171, 56, 7, 190, 131, 112, 161])
BLOB_ZSTD = bytes([49, 185, 88, 66, 111, 182, 163, 127])
BLOB_ENCRYPTED = bytes([123, 103, 133, 190, 34, 45, 76, 240])
BLOB_ENCRYPTED_ZSTD = bytes([230, 89, 27, 191, 11, 191, 216, 11])
INDEX_MAGIC = bytes([28, 145, 78, 165, 25, 186, 179, 205])
CATALOG_MAGIC = bytes.fromhex("91fd60f9c46758d5")
NO_MASK = (1 << 64) - 1
#: The frame magic is ours; give another one to read other tools' streams.
FRAME_MAGIC = b"MORAINE1"
MOST_BODY, MOST_FRAME = 1 << 20, 1 << 31


class FormatError(ValueError):
    """Bytes that do not follow the format."""


def record(kind: int, body: bytes = b"", size: int | None = None) -> bytes:
    """A record: type, length with the header, body."""
    return struct.pack("<QQ", kind, 16 + (len(body) if size is None else size)) + body


def metadata(node: dict) -> bytes:
    """A node's entry and extras, in the order that change detection relies on."""
    out = [record(ENTRY, struct.pack("<QQIIqII", node["mode"], 0, node["uid"], node["gid"], node["mtime_secs"], node["mtime_nanos"], 0))]
    for x in node.get("xattrs") or ():
        out.append(record(XATTR, x["name"].encode() + b"\0" + bytes(x["value"])))
    acl = node.get("acl")
    if acl:
        pair = lambda kind, rows: [record(kind, struct.pack("<QQ", r["id"], r["perm"])) for r in rows or ()]
        out += pair(ACL_USER, acl.get("users")) + pair(ACL_GROUP, acl.get("groups"))
        if acl.get("group_obj") is not None:
            out.append(record(ACL_GROUP_OBJ, struct.pack("<Q", acl["group_obj"])))
        d = acl.get("default")
        if d is not None:
            mask = NO_MASK if d.get("mask") is None else d["mask"]
            out.append(record(ACL_DEFAULT, struct.pack("<QQQQ", d["user_obj"], d["group_obj"], d["other"], mask)))
        out += pair(ACL_DEFAULT_USER, acl.get("default_users")) + pair(ACL_DEFAULT_GROUP, acl.get("default_groups"))
    if node.get("fcaps"):
        out.append(record(FCAPS, bytes(node["fcaps"])))
    if node.get("quota_id"):
        out.append(record(QUOTA, struct.pack("<Q", node["quota_id"])))
    return b"".join(out)


def siphash24(data: bytes, k0: int = NAME_KEYS[0], k1: int = NAME_KEYS[1]) -> int:
    """SipHash-2-4 of bytes under a 128-bit key."""
    m = (1 << 64) - 1
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rounds(n: int) -> None:
        a, b, c, d = v
        turn = lambda x, r: ((x << r) | (x >> (64 - r))) & m
        for _ in range(n):
            a = (a + b) & m
            b = turn(b, 13) ^ a
            a = turn(a, 32)
            c = (c + d) & m
            d = turn(d, 16) ^ c
            a = (a + d) & m
            d = turn(d, 21) ^ a
            c = (c + b) & m
            b = turn(b, 17) ^ c
            c = turn(c, 32)
        v[:] = a, b, c, d

    whole = len(data) // 8 * 8
    words = [*struct.unpack(f"<{whole // 8}Q", data[:whole]), int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56]
    for w in words:
        v[3] ^= w
        rounds(2)
        v[0] ^= w
    v[2] ^= 255
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def bst_order(n: int) -> list[int]:
    """For each slot of a complete binary search tree in heap order, the rank that stands there."""
    out = [0] * n
    rank = 0
    stack: list[int] = []
    slot = 0
    while stack or slot < n:  # in-order walk of the slots
        while slot < n:
            stack.append(slot)
            slot = 2 * slot + 1
        slot = stack.pop()
        out[slot] = rank
        rank += 1
        slot = 2 * slot + 2
    return out


def goodbye(items: list[tuple[int, int, int]], entry_start: int, start: int) -> bytes:
    """A directory's table of (hash, start, length) items, with its tail."""
    ordered = sorted(items, key=lambda x: x[0])
    body = b"".join(struct.pack("<QQQ", h, start - at, size) for h, at, size in (ordered[k] for k in bst_order(len(ordered))))
    return record(GOODBYE, body + struct.pack("<QQQ", GOODBYE_TAIL, start - entry_start, 16 + 24 * (len(items) + 1)))


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(position, type, body) of each record; checks lengths."""
    at = 0
    while at < len(data):
        if at + 16 > len(data):
            raise FormatError("truncated header")
        kind, size = struct.unpack_from("<QQ", data, at)
        if size < 16 or at + size > len(data):
            raise FormatError(f"bad record length {size} at {at}")
        if kind != PAYLOAD and kind != GOODBYE and size - 16 > MOST_BODY:
            raise FormatError(f"record of {size} bytes at {at}")
        yield at, kind, data[at + 16 : at + size]
        at += size


# ---- catalogs


def varint(v: int) -> bytes:
    """Seven bits a byte, the low ones first."""
    out = bytearray()
    while v >= 128:
        out.append(128 | v & 127)
        v >>= 7
    out.append(v)
    return bytes(out)


def signed_varint(v: int) -> bytes:
    """As varint; a negative number is its magnitude with every byte marked, then 0."""
    if v >= 0:
        return varint(v)
    out = bytearray(varint(-v))
    out[-1] |= 128
    return bytes(out) + b"\0"


def read_varint(data: bytes, at: int = 0, signed: bool = False) -> tuple[int, int]:
    """A value and where it ends."""
    v = 0
    for i in range(11 if signed else 10):
        if at + i >= len(data):
            break
        b = data[at + i]
        if signed and b == 0:
            return -v, at + i + 1
        if b < 128:
            return v | b << 7 * i, at + i + 1
        v |= (b & 127) << 7 * i
    raise FormatError("invalid varint")


def encode_catalog(rows: list[tuple[str, str, int, int]]) -> bytes:
    """A catalog of (path, type letter, size, mtime) rows in walk order; directories may be implied."""
    children: dict[str, dict[str, tuple[str, int, int]]] = {"": {}}

    def directory(path: str) -> dict:
        if path not in children:
            up, _, name = path.rpartition("/")
            directory(up)[name] = ("d", 0, 0)
            children[path] = {}
        return children[path]

    for path, kind, size, mtime in rows:
        if kind == "d":
            directory(path)
        else:
            up, _, name = path.rpartition("/")
            if not name or "\0" in name:
                raise FormatError(f"invalid entry name {name!r}")
            directory(up)[name] = (kind, size, mtime)
    out = bytearray(CATALOG_MAGIC)
    starts: dict[str, int] = {}
    # a directory's table is written when it closes, after those of all directories in it
    closing: list[str] = []
    todo = [""]
    while todo:
        path = todo.pop()
        closing.append(path)
        todo += [f"{path}/{name}" if path else name for name, (kind, _, _) in children[path].items() if kind == "d"]
    for path in reversed(closing):
        start = len(out)
        own = children[path]
        table = bytearray(varint(len(own)))
        for name, (kind, size, mtime) in own.items():
            raw = name.encode()
            table += kind.encode() + varint(len(raw)) + raw
            if kind == "d":
                table += varint(start - starts[f"{path}/{name}" if path else name])
            elif kind == "f":
                table += varint(size) + signed_varint(mtime)
        starts[path] = start
        out += varint(len(table)) + table
    return bytes(out) + struct.pack("<Q", starts[""])


def decode_catalog(data: bytes, most_depth: int = 4096) -> list[tuple[str, str, int | None, int | None]]:
    """(path, type letter, size, mtime) of a catalog, depth first."""
    if data[:8] != CATALOG_MAGIC:
        raise FormatError("bad catalog magic")
    if len(data) < 16:
        raise FormatError("truncated catalog")
    out: list[tuple[str, str, int | None, int | None]] = []

    def read(start: int, prefix: str, depth: int) -> None:
        if depth > most_depth:
            raise FormatError("catalog too deep")
        if not 8 <= start < len(data) - 8:
            raise FormatError(f"table at {start} is outside")
        size, at = read_varint(data, start)
        end = at + size
        if end > len(data) - 8:
            raise FormatError("table beyond the end")
        n, at = read_varint(data, at)
        for _ in range(n):
            kind = chr(data[at])
            length, at = read_varint(data, at + 1)
            path, at = prefix + data[at : at + length].decode("utf-8", "surrogateescape"), at + length
            if kind == "d":
                back, at = read_varint(data, at)
                if back == 0 or back > start:
                    raise FormatError("directory does not lie before its parent")
                out.append((path, kind, None, None))
                read(start - back, path + "/", depth + 1)
            elif kind == "f":
                bytes_, at = read_varint(data, at)
                mtime, at = read_varint(data, at, signed=True)
                out.append((path, kind, bytes_, mtime))
            elif kind in "lhbcps":
                out.append((path, kind, None, None))
            else:
                raise FormatError(f"unknown entry type {kind!r}")
        if at != end:
            raise FormatError("table length does not fit its entries")

    read(struct.unpack("<Q", data[-8:])[0], "", 0)
    return out


# ---- indexes, blobs, frames


def render_index(entries: list[tuple[int, str]]) -> bytes:
    """An index file of (end offset, hex digest)."""
    return INDEX_MAGIC.ljust(4096, b"\0") + b"".join(struct.pack("<Q", end) + bytes.fromhex(d) for end, d in entries)


def parse_index(data: bytes) -> list[tuple[int, str]]:
    if len(data) < 4096:
        raise FormatError(f"index truncated: {len(data)} bytes")
    if data[:8] != INDEX_MAGIC:
        raise FormatError("bad index magic")
    if (len(data) - 4096) % 40:
        raise FormatError("index records truncated")
    return [(struct.unpack_from("<Q", data, at)[0], data[at + 8 : at + 40].hex()) for at in range(4096, len(data), 40)]


def index_checksum(entries: list[tuple[int, str]]) -> str:
    return hashlib.sha256(b"".join(struct.pack("<Q", end) + bytes.fromhex(d) for end, d in entries)).hexdigest()


def encode_blob(plain: bytes, compress: bool = True) -> bytes:
    """A framed blob; the compressed form only if it is smaller."""
    magic, body = BLOB_PLAIN, plain
    if compress:
        packed = zstandard.ZstdCompressor().compress(plain)
        if len(packed) < len(plain):
            magic, body = BLOB_ZSTD, packed
    return magic + struct.pack("<I", zlib.crc32(body)) + body


def decode_blob(framed: bytes, most: int = 1 << 30) -> bytes:
    if len(framed) < 12:
        raise FormatError("blob truncated")
    magic, crc, body = framed[:8], struct.unpack_from("<I", framed, 8)[0], framed[12:]
    if magic in (BLOB_ENCRYPTED, BLOB_ENCRYPTED_ZSTD):
        raise FormatError("blob is encrypted")
    if magic not in (BLOB_PLAIN, BLOB_ZSTD):
        raise FormatError("unknown blob magic")
    if zlib.crc32(body) != crc:
        raise FormatError("blob checksum mismatch")
    if magic == BLOB_PLAIN:
        return body
    try:
        return zstandard.ZstdDecompressor().decompress(body, max_output_size=most)
    except zstandard.ZstdError as e:
        raise FormatError(f"blob does not decompress: {e}") from None


Frame = tuple[str, bytes, list[tuple[str, int]]]


def encode_frames(frames: list[Frame], magic: bytes = FRAME_MAGIC) -> bytes:
    """Frames ('data', bytes, []) and ('inject', b'', [(hex digest, size)]); empty ones leave no trace."""
    out: list[bytes] = []
    for kind, data, inject in frames:
        body = data if kind == "data" else b"".join(bytes.fromhex(d) + struct.pack("<Q", n) for d, n in inject)
        if body:
            out += [b"" if out else magic, struct.pack("<BQ", kind != "data", len(body)), body]
    return b"".join(out)


def decode_frames(data: bytes, magic: bytes = FRAME_MAGIC) -> list[Frame]:
    """The frames of a stream; one that does not begin with the magic is a single data frame."""
    if not data.startswith(magic):
        return [("data", data, [])] if data else []
    out: list[Frame] = []
    at = len(magic)
    while at < len(data):
        if at + 9 > len(data):
            raise FormatError("truncated frame header")
        kind, size = struct.unpack_from("<BQ", data, at)
        body = data[at + 9 : at + 9 + size]
        if size > MOST_FRAME or len(body) < size:
            raise FormatError("truncated frame")
        at += 9 + size
        if kind == 0:
            out.append(("data", body, []))
        elif kind == 1:
            if size % 40:
                raise FormatError("inject frame of a wrong length")
            out.append(("inject", b"", [(body[k : k + 32].hex(), struct.unpack_from("<Q", body, k + 32)[0]) for k in range(0, size, 40)]))
        else:
            raise FormatError(f"unknown frame kind {kind}")
    return out


# ---- manifests and keys


def canonical_json(text: str | bytes) -> str:
    """Canonical form of a manifest: no signature, no unprotected part, sorted keys, no blanks."""
    tree = json.loads(text, parse_float=_no_float, parse_constant=_no_float)
    if not isinstance(tree, dict):
        raise FormatError("a manifest is an object")
    tree.pop("signature", None)
    tree.pop("unprotected", None)

    def check(x: object) -> object:
        if x is None:
            raise FormatError("null in a signed manifest")
        if isinstance(x, dict):
            return {k: check(v) for k, v in sorted(x.items(), key=lambda kv: kv[0].encode())}
        return [check(v) for v in x] if isinstance(x, list) else x

    return json.dumps(check(tree), separators=(",", ":"), ensure_ascii=False)


def _no_float(text: str) -> None:
    raise FormatError(f"non-integer number {text}")


def id_key(key: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", key, b"_id_key", 10, 32)


def sign(manifest: str | bytes, key: bytes) -> str:
    return hmac.new(id_key(key), canonical_json(manifest).encode(), hashlib.sha256).hexdigest()


def fingerprint(key: bytes, label: bytes) -> str:
    """Colon hex of a key's fingerprint."""
    raw = hashlib.sha256(hashlib.sha256(label).digest() + id_key(key)).hexdigest()
    return ":".join(raw[i : i + 2] for i in range(0, 64, 2))


# ---- POSIX ACL attributes

_TAGS = {1: "user_obj", 2: "user", 4: "group_obj", 8: "group", 16: "mask", 32: "other"}


def parse_posix_acl(data: bytes) -> list[tuple[str, int, int]]:
    """(tag, permissions, id) entries of an ACL attribute of version 2."""
    if len(data) < 4 or struct.unpack_from("<I", data)[0] != 2 or (len(data) - 4) % 8:
        raise FormatError("bad ACL attribute")
    out = []
    for at in range(4, len(data), 8):
        tag, perm, who = struct.unpack_from("<HHI", data, at)
        if tag not in _TAGS:
            raise FormatError(f"unknown ACL tag {tag}")
        out.append((_TAGS[tag], perm, who))
    return out


def acl_struct(access: bytes | None, default: bytes | None) -> dict | None:
    """The ACL record of a node: named entries by id; group_obj with a mask only; default always whole."""
    out: dict = {"users": [], "groups": [], "group_obj": None, "default": None, "default_users": [], "default_groups": []}
    for prefix, raw in (("", access), ("default_", default)):
        if not raw:
            continue
        entries = parse_posix_acl(raw)
        one = {t: p for t, p, _ in entries if t not in ("user", "group")}
        for tag in ("user", "group"):
            out[f"{prefix}{tag}s"] = sorted(({"id": i, "perm": p} for t, p, i in entries if t == tag), key=lambda x: x["id"])
        if prefix:
            out["default"] = {"user_obj": one.get("user_obj", 0), "group_obj": one.get("group_obj", 0), "other": one.get("other", 0), "mask": one.get("mask")}
        elif "mask" in one:
            out["group_obj"] = one.get("group_obj")
    return out if any(v for v in out.values()) or out["group_obj"] is not None else None


def encode_posix_acl(entries: list[tuple[str, int, int]]) -> bytes:
    tags = {v: k for k, v in _TAGS.items()}
    return struct.pack("<I", 2) + b"".join(struct.pack("<HHI", tags[t], p, i) for t, p, i in entries)
