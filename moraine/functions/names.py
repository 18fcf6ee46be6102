"""Names, paths and sizes of archive records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of archive records in bytes.
HEADER, ENTRY, DEVICE, MARKER, FORMAT_VERSION, PAYLOAD_REF = 16, 56, 32, 16, 24, 32
ACL_USER, ACL_GROUP, ACL_GROUP_OBJ, ACL_DEFAULT, QUOTA, GOODBYE_ITEM = 32, 32, 24, 48, 24, 24
# Base names that another system reserves.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def name_valid(name: Column) -> Column:
    """Not empty, no dot name, no slash, no NUL."""
    return (name != "") & ~name.isin(".", "..") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\0"))


def path_valid(path: Column) -> Column:
    return F.forall(F.split(path, "/"), name_valid)


def windows_name_valid(name: Column) -> Column:
    """Whether a name can be written on a system with reserved characters and names."""
    return ~name.rlike(r'[<>:"/\\|?*\x{0}-\x{1F}]') & ~name.rlike(r"[. ]\z") & (name != "") & ~F.upper(F.split(name, "\\.")[0]).isin(*RESERVED)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def join_path(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("/"), name))


def string_size(x: Column) -> Column:
    """A record of a header, bytes and NUL: file names and symlinks."""
    return HEADER + F.octet_length(x) + 1


def hardlink_size(target: Column) -> Column:
    return HEADER + 8 + F.octet_length(target) + 1


def goodbye_size(children: Column) -> Column:
    return HEADER + GOODBYE_ITEM * (children + 1)


def metadata_size(xattrs: Column, acl: Column, fcaps: Column, quota: Column) -> Column:
    """Bytes of a node's entry record and its extras."""
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)) if c is not None else F.lit(0)
    size = lambda c: F.greatest(count(c), F.lit(0)).cast("long")
    x = F.aggregate(F.coalesce(xattrs, F.array().cast("array<struct<name:string,value:binary>>")), zero, lambda s, a: s + HEADER + F.octet_length(a["name"]) + 1 + F.octet_length(a["value"]))
    a = size(acl["users"]) * ACL_USER + size(acl["groups"]) * ACL_GROUP + (size(acl["default_users"]) + size(acl["default_groups"])) * ACL_USER
    a = a + F.when(acl["group_obj"].isNotNull(), ACL_GROUP_OBJ).otherwise(0) + F.when(acl["default"].isNotNull(), ACL_DEFAULT).otherwise(0)
    f = F.when(F.octet_length(fcaps) > 0, HEADER + F.octet_length(fcaps)).otherwise(0)
    q = F.when(quota != 0, QUOTA).otherwise(0)
    return ENTRY + x + F.coalesce(a, zero) + F.coalesce(f, zero) + F.coalesce(q, zero)


def index_name(name: Column) -> Column:
    """Completed name of a one-stream index."""
    return F.when(F.endswith(name, F.lit(".didx")), name).when(F.endswith(name, F.lit(".pxar")), F.concat(name, F.lit(".didx"))).otherwise(F.concat(name, F.lit(".pxar.didx")))


def split_stem(name: Column) -> Column:
    """A name without its index and archive endings."""
    return F.regexp_replace(F.regexp_replace(name, r"\.didx\z", ""), r"\.(pxar|mpxar|ppxar)\z", "")


def json_escaped(text: Column) -> Column:
    """The inside of a JSON string: quote, backslash and control characters only."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return out


def prelude_json(patterns: Column) -> Column:
    """The prelude of an archive: its exclude patterns, one a line, as JSON."""
    return F.concat(F.lit('{"exclude-patterns":"'), json_escaped(patterns), F.lit('"}'))


def sized(data: Column, size: Column) -> Column:
    """Bytes cut or filled up with zeros to a declared size."""
    return F.rpad(data, size.cast("int"), F.lit(b"\0"))


def size_warning(actual: Column, size: Column) -> Column:
    """What to tell about content that differs from its declared size; a longer one is probed by one byte only."""
    return F.when(actual < size, F.concat(F.lit("size-changed "), actual)).when(actual > size, F.concat(F.lit("size-changed "), size + 1))


def snapshot_path(kind: Column, name: Column, seconds: Column) -> Column:
    """type/id/time of a snapshot, the time in UTC to the second."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.concat(kind, F.lit("/"), name, F.lit("/"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def comment(notes: Column) -> Column:
    """The first line of a snapshot's notes."""
    return F.split(notes, "\n")[0]


def blob_name(name: Column) -> Column:
    """A blob's completed name; null if it cannot be one: empty, with a slash or NUL, or reserved."""
    full = F.when(F.endswith(name, F.lit(".blob")), name).otherwise(F.concat(name, F.lit(".blob")))
    return F.when(name_valid(name) & ~full.isin("index.json.blob", "rsa-encrypted.key.blob"), full)


def colon_hex(digest: Column) -> Column:
    """A digest's hex digits in pairs with colons between."""
    return F.regexp_replace(F.regexp_replace(digest, "(..)", "$1:"), ":$", "")


def reserved_child(path: Column) -> Column:
    """Whether a node is the root's child whose name the archive keeps for itself."""
    return path == ".pxarexclude-cli"


def metadata_key(mode: Column, uid: Column, gid: Column, secs: Column, nanos: Column, xattrs: Column, acl: Column, fcaps: Column, quota: Column) -> Column:
    """A digest of all of a node's metadata, values and not sizes: equal if and only if nothing has changed."""
    x = F.array_join(F.transform(F.array_sort(xattrs), lambda a: F.concat(a["name"], F.lit("="), F.hex(a["value"]))), ",")

    def entries(field: str, mark: str) -> Column:
        return F.transform(acl[field], lambda e: F.concat(F.lit(mark), e["id"].cast("string"), F.lit(":"), e["perm"].cast("string")))

    one = F.array(F.concat(F.lit("o"), acl["group_obj"].cast("string")), F.concat(F.lit("d"), acl["default"].cast("string")))
    a = F.array_join(F.concat(entries("users", "u"), entries("groups", "g"), entries("default_users", "U"), entries("default_groups", "G"), one), ";")
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (mode, uid, gid, secs, nanos, x, a, F.hex(fcaps), quota)]
    return F.sha2(F.concat_ws("|", *parts), 256)
