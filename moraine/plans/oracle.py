"""The queries in DuckDB's SQL, from the definitions, to check the Spark results."""

from __future__ import annotations

from ..functions import patterns
from . import model as m
from . import queries as q

B, T0, SPAN = m.BLOCK, m.T0, q.SPAN


def docs(k: int) -> str:
    if k == 1:
        text, mtime, where = "coalesce(text, '')", f"{T0} + doc_id * 60", "true"
    else:
        text, mtime, where = "case when doc_id % 13 = 0 then coalesce(text, '') || ' changed' else coalesce(text, '') end", f"{T0} + doc_id * 60 + case when doc_id % 17 = 0 then 7 else 0 end", "doc_id % 29 <> 0"
    return f"""d{k} as (select doc_id, {text} as text, lang0 as lang, source0 || '/' || lang0 as dir, source0 || '/' || lang0 || '/d' || doc_id || '.txt' as path, {mtime} as mtime_secs
      from (select *, coalesce(source, 'none') as source0, coalesce(lang, 'none') as lang0 from documents) where {where})"""


def up(path: str) -> str:
    """Proper ancestors of a path but the root, as a list."""
    return f"list_transform(generate_series(1, len(string_split({path}, '/')) - 1), lambda i: array_to_string(string_split({path}, '/')[1:i], '/'))"


def parent(path: str) -> str:
    return f"array_to_string(string_split({path}, '/')[1:len(string_split({path}, '/')) - 1], '/')"


def base(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def nodes(k: int = 1) -> str:
    """CTEs that end with n<k>."""
    return f"""{docs(k)},
    i{k} as (select sha256(text) as h, min(doc_id) as ino, count(*) as nlink from d{k} group by 1),
    f{k} as (select path, 'file' as kind, (case when doc_id % 5 = 0 then 33152 else 33188 end)::bigint as mode, doc_id % 3 as uid, doc_id % 4 as gid, mtime_secs, strlen(text)::bigint as size, ino, nlink,
      sha256((case when doc_id % 5 = 0 then 33152 else 33188 end) || '|' || doc_id % 3 || '|' || doc_id % 4 || '|' || mtime_secs || '|' || case when {k} = 2 and doc_id % 31 = 0 then 5 else 0 end || '|'
        || case when doc_id % 7 = 0 then 'user.lang=' || hex(encode(case when {k} = 2 and doc_id % 35 = 0 then upper(lang) else lang end)) else '' end || '|'
        || case when doc_id % 11 = 0 then 'u1:' || case when {k} = 2 and doc_id % 33 = 0 then 6 else 4 end || ';o4' else '' end || '||0') as meta,
      56 + case when doc_id % 7 = 0 then 16 + 9 + 1 + strlen(lang) else 0 end + case when doc_id % 11 = 0 then 32 + 24 else 0 end as meta_size from d{k} join i{k} on h = sha256(text)),
    g{k} as (select distinct unnest(list_concat([''], {up('path')})) as path from f{k}),
    a{k} as (select * from f{k} union all select path, 'directory', 16877, 0, 0, {T0}, 0, -1, 1, null, 56 from g{k}),
    t{k} as (select ino, arg_min(path, string_split(path, '/')) as target from a{k} where kind = 'file' and nlink > 1 group by ino),
    n{k} as (select a.path, case when target <> a.path then 'hardlink' else kind end as kind, mode, uid, gid, mtime_secs, size, nlink, meta, meta_size, case when target <> a.path then target end as link_target
      from a{k} a left join t{k} on t{k}.ino = a.ino and kind = 'file' and nlink > 1)"""


NAME_BYTES = f"case when path = '' then 0 else 17 + strlen({base('path')}) end"


def opened(v: int) -> str:
    body = "32" if v == 2 else "16 + size"
    return f"({NAME_BYTES} + case when kind = 'hardlink' then 25 + strlen(link_target) else meta_size + case when kind = 'file' then {body} else 0 end end)::bigint"


def cuts(k: int = 1) -> str:
    """CTEs that end with cdc<k>: the chunks of a snapshot's texts, from the definition of the rolling hash.

    A value rotated by its age is the value rotated back by its place, then all turned
    to the place looked at, so the hash is one window of exclusive ors over the bytes.
    """
    mask, least, most = 2 * q.AVG - 1, q.AVG // 4, 4 * q.AVG
    turned = lambda x, by: f"((({x} << ({by})) | ({x} >> (32 - ({by})))) & 4294967295)"
    return f"""tab{k} as (select i as b, ('0x' || md5(i::varchar)[1:8])::ubigint as t from range(256) r(i)),
    by{k} as (select doc_id, unnest(l) as hx, unnest(range(len(l))) as i from (select doc_id, regexp_extract_all(hex(encode(text)), '..') as l from d{k} where text <> '')),
    g{k}x as (select doc_id, i, {turned('t', '(32 - i % 32) % 32')} as g from by{k} join tab{k} on b = ('0x' || hx)::ubigint),
    h{k} as (select doc_id, i, bit_xor(g) over (partition by doc_id order by i rows between 63 preceding and current row) as x from g{k}x),
    c{k} as (select doc_id, list(i + 1 order by i) as ends from h{k} where i >= 63 and ({turned('x', 'i % 32')} & {mask}) >= {mask - 2} group by 1),
    walk{k} as (select d.doc_id, strlen(text)::bigint as n, coalesce(ends, []) as ends, 0::bigint as seq, 0::bigint as a, 0::bigint as b from d{k} d left join c{k} using (doc_id) where text <> ''
      union all select doc_id, n, ends, seq + 1, b, least(b + {most}, coalesce(list_filter(ends, lambda e: e >= w.b + {least})[1], n), n)::bigint from walk{k} w where b < n),
    cdc{k} as (select 'd' || doc_id as stream_id, seq - 1 as seq, a as "offset", b as end_offset, b - a as size, sha256(unhex(substring(hex(encode(text)), (2 * a + 1)::bigint, (2 * (b - a))::bigint))) as digest from walk{k} join d{k} using (doc_id) where seq > 0)"""


def events(v: int, k: int = 1) -> str:
    lead = 24 if v == 2 else 0
    return f"""{nodes(k)},
    c as (select {parent('path')} as path, count(*) as n from n{k} where path <> '' group by 1),
    e as (select path, kind, size, link_target, 0 as phase, case when path = '' then []::varchar[] else list_transform(string_split(path, '/'), lambda x: '0' || x) end as key, {opened(v)} as bytes from n{k}
      union all select n.path, kind, size, link_target, 1, list_concat(case when n.path = '' then []::varchar[] else list_transform(string_split(n.path, '/'), lambda x: '0' || x) end, ['1']), (16 + 24 * (coalesce(c.n, 0) + 1))::bigint
      from n{k} n left join c on c.path = n.path where kind = 'directory'),
    p as (select *, ({lead} + coalesce(sum(bytes) over (order by key rows between unbounded preceding and 1 preceding), 0))::bigint as start from e)"""


def payload(k: int = 1) -> str:
    """CTE y<k>, after nodes(k)."""
    return f"""y{k} as (select path, meta, size,
      (16 + coalesce(sum(16 + size) over (order by string_split(path, '/') rows between unbounded preceding and 1 preceding), 0))::bigint as payload_offset from n{k} where kind = 'file')"""


def chunks(k: int = 1) -> str:
    """CTEs that end with c<k>; docs(k) first."""
    return f"""{docs(k)},
    x{k} as (select 'd' || doc_id as stream_id, hex(encode(text)) as h, strlen(text)::bigint as n, unnest(generate_series(0, (strlen(text) - 1) // {B})) as seq from d{k} where text <> ''),
    c{k} as (select stream_id, seq, seq * {B} as offset, least(n, seq * {B} + {B}) as end_offset, least(n, seq * {B} + {B}) - seq * {B} as size, sha256(unhex(substring(h, (2 * seq * {B} + 1)::int, 2 * {B}))) as digest from x{k})"""


def marked(source: str, known: str | None = None) -> str:
    first = f"select digest, min((stream_id, seq)) as at from {source} group by 1"
    anti = f" where digest not in (select digest from {known})" if known else ""
    return f"w as (select * from ({first}) {anti}), z as (select c.*, coalesce(w.at = (c.stream_id, c.seq), false) as is_new from {source} c left join w using (digest))"


SNAPS = """s as (select event_id, event_type as ns, (['host', 'vm', 'ct'])[user_id % 3 + 1] as type, 'u' || (user_id % 50) as id, epoch_us(ts) // 1000000 as time from events)"""
FILES = f"""{SNAPS}, mf as (select ns, type, id, time // 86400 as time, (['root.pxar.didx', 'root.mpxar.didx', 'root.ppxar.didx', 'conf.blob'])[event_id % 4 + 1] as filename, case when event_id % 5 = 0 then 'encrypt' else 'none' end as crypt_mode from s)"""
PAGES = r"""pg as (select page_id, path, case when page_id % 10 = 0 then 'directory' else 'file' end as kind from (select page_id, regexp_replace(regexp_replace(coalesce(url, ''), '^[a-z]+://', ''), '/+\z', '') as path from pages) where path <> '')"""
ASKED = "q as (select path from d1 union all select dir from d1 where lang = 'en' union all select path || '.missing' from d1)"
LE = "array_to_string(list_transform([15, 13, 11, 9, 7, 5, 3, 1], lambda i: substring(lpad(lower(to_hex(end_offset)), 16, '0'), i, 2)), '')"
RUNS = f"""{nodes(1)}, {payload(1)}, {nodes(2)}, {payload(2)},
    u as (select y2.path, y2.size, row_number() over (order by string_split(y2.path, '/')) - 1 as seq, coalesce(y1.meta = y2.meta and y1.size = y2.size, false) as unchanged,
      case when y1.meta = y2.meta and y1.size = y2.size then y1.payload_offset end as payload_offset from y2 left join y1 using (path)),
    v as (select *, lag(unchanged) over o as b, lag(payload_offset) over o as l from u window o as (order by seq)),
    r as (select path, size, seq, unchanged, payload_offset, sum(case when not unchanged or b is null or not b or payload_offset <= l then 1 else 0 end) over (order by seq rows unbounded preceding)::bigint as run_id from v)"""
COVER = f"""{RUNS},
    total as (select max(payload_offset + 16 + size) as n from y1),
    ch as (select unnest(generate_series(0, (n - 1) // {SPAN})) as k, n from total),
    pc as (select k * {SPAN} as start_offset, least(n, (k + 1) * {SPAN}) as end_offset from ch),
    rr as (select run_id, max(seq) as last_seq, min(payload_offset) as run_start, max(payload_offset + 16 + size) as run_end, sum(16 + size)::bigint as used, count(*) as n_files from r where unchanged group by 1),
    cv as (select rr.*, min(start_offset) as c_start, max(end_offset) as c_end, count(*) as n_chunks, max(end_offset) - min(start_offset) as total from rr join pc on start_offset < run_end and end_offset > run_start group by all),
    dc as (select *, total >= used and (total - used) / total <= 0.5 and c_end >= run_end as reuse, c_end >= run_end and not (total >= used and (total - used) / total <= 0.5) as rejected from cv)"""
PLAN = f"""{COVER},
    pl as (select path, seq, size, run_id, coalesce(reuse, false) and unchanged as reuse, case when reuse and unchanged then payload_offset - c_start end as rel,
      case when reuse and unchanged and seq = last_seq then total end as run_total from r left join dc using (run_id))"""


def pattern_sql(texts: list[str]) -> str:
    ps = patterns.parse_all(texts)
    return f"with {nodes()} select path, {patterns.excluded_sql(ps, 'path', "kind = 'directory'")} as excluded from n1 where path <> ''"


def prune_ctes() -> str:
    verdict = patterns.excluded_sql(patterns.parse_all(q.PRUNE), "path", "kind = 'directory'")
    return f"{nodes()}, vd as (select path, kind, path <> '' and {verdict} as gone from n1), an as (select path, unnest({up('path')}) as ancestor from n1 where path <> '')"


def scoped_ctes(source: str, outer: list[str]) -> str:
    """CTEs that end with left_, the rows of source that are left."""
    rows = [("", k - len(outer), x) for k, x in enumerate(outer)]
    rows += [("src0", 0, "d*2.txt"), ("src0", 1, "!d*22.txt"), ("src0/en", 0, "/src0/en/d1*.txt"), ("src1", 0, "fr/"), ("", 0, "*9.txt"), ("src1/en", 1, "!*9.txt")]
    parts = []
    for scope, line, text in rows:
        p = patterns.parse(text)
        inside = f"starts_with(path, '{scope}/')" if scope else "path <> ''"
        depth = len(scope.split("/")) if scope else 0
        parts.append(f"select path, {depth} as a, {line} as b, {str(not p.include).lower()} as gone from {source} where {inside} and {p.sql('path', "kind = 'directory'")}")
    return f"""{nodes()}, hit as ({' union all '.join(parts)}), vd as (select path from (select path, arg_max(gone, (a, b)) as gone from hit group by 1) where gone),
      an as (select path, unnest({up('path')}) as ancestor from {source} where path <> ''),
      left_ as (select * from {source} where path not in (select path from vd) and path not in (select path from an where ancestor in (select path from vd)))"""


def build() -> dict[str, str]:
    out = {k: pattern_sql(v) for k, v in q.PATTERN_LISTS.items()}
    out["tree_nodes"] = f"with {nodes()} select path, kind, mode, uid, gid, mtime_secs, size, nlink, link_target from n1"
    out["tree_ancestors"] = f"with {nodes()}, x as (select path, unnest({up('path')}) as ancestor from n1 where path <> '') select path, ancestor, (len(string_split(path, '/')) - len(string_split(ancestor, '/')))::int as distance from x"
    out["tree_totals"] = f"with {nodes()} select kind, count(*) as n, sum(size)::bigint as bytes from n1 group by 1"
    out["virtual_root"] = f"with {docs(1)}, {PAGES}, x as (select 'docs/' || path as path from d1 union all select 'pages/' || path from pg) select string_split(path, '/')[1] as root, count(*) as n, min(path) as first, max(path) as last from x group by 1"
    out["hardlink_targets"] = f"with {nodes()} select path, link_target from n1 where kind = 'hardlink'"
    out["duplicate_names"] = f"with {PAGES} select string_split(path, '/')[1] as parent, 'p' || (page_id % 7) as name, count(*) as n from pg group by 1, 2 having count(*) > 1"
    out["prune_subtree"] = f"with {prune_ctes()} select path from vd where not gone and path not in (select an.path from an join vd x on x.path = an.ancestor where x.gone)"
    out["on_exclude_audit"] = f"with {prune_ctes()} select path from vd where gone and path not in (select an.path from an join vd x on x.path = an.ancestor where x.gone)"
    out["scoped_exclude"] = f"with {scoped_ctes('n1', [])} select path from left_"
    out["scoped_exclude_hardlinks"] = f"""with {scoped_ctes('a1', q.OUTER)}, t as (select ino, arg_min(path, string_split(path, '/')) as target from left_ where kind = 'file' and nlink > 1 group by ino)
      select path, case when target <> path then 'hardlink' else kind end as kind, case when target <> path then target end as link_target from left_ left join t on t.ino = left_.ino and kind = 'file' and nlink > 1"""
    out["labelled_out"] = f"with {docs(1)} select path from d1 where doc_id not in (select doc_id from labels where toxic = 1)"
    out["covered_paths"] = f"with {docs(1)}, {ASKED}, z as (select distinct path from q) select path from z where path not in (select a.path from z a join z b on starts_with(a.path, b.path || '/'))"
    out["valid_names"] = rf"""with {PAGES}, x as (select page_id, {base('path')} as name, {parent('path')} as parent, len(string_split(path, '/'))::int as depth, string_split(path, '/') as cs from pg)
      select page_id, len(list_filter(cs, lambda c: c in ('', '.', '..') or contains(c, chr(0)))) = 0 as path_ok, name not in ('', '.', '..') as name_ok,
        not regexp_matches(name, '[<>:"/\\|?*\x00-\x1F]') and not regexp_matches(name, '[. ]\z') and name <> '' and not regexp_matches(upper(string_split(name, '.')[1]), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\z') as windows_ok, name, parent, depth from x"""
    out["index_names"] = r"""with x as (select p_partkey, replace(p_name, ' ', '_') || (['', '.pxar', '.didx', '.mpxar.didx', '.ppxar'])[p_partkey % 5 + 1] as n from part)
      select p_partkey, case when ends_with(n, '.didx') then n when ends_with(n, '.pxar') then n || '.didx' else n || '.pxar.didx' end as index_name, regexp_replace(regexp_replace(n, '\.didx\z', ''), '\.(pxar|mpxar|ppxar)\z', '') as stem from x"""
    out["metadata_sizes"] = f"with {nodes()} select path, meta_size::bigint as meta_size, {opened(1)} as v1_bytes, {opened(2)} as v2_bytes from n1"
    out["estimate_v1"] = f"with {events(1)} select sum(bytes)::bigint as archive_bytes from e"
    out["estimate_v2"] = f"with {events(2)} select (sum(bytes) + 24)::bigint as meta_bytes, (coalesce(sum(16 + size) filter (kind = 'file' and phase = 0), 0) + 32)::bigint as payload_bytes from e"
    out["v1_offsets"] = f"with {events(1)} select path, phase, start, bytes from p"
    out["v2_payload_refs"] = f"with {nodes()}, {payload()} select path, payload_offset, size from y1"
    out["dir_spans"] = f"with {events(2)} select path, min(start) as start, (max(start + bytes) - min(start) + max(case when kind = 'file' then size else 0 end))::bigint as length from p group by 1"
    out["hardlink_offsets"] = f"with {events(1)} select a.path, a.link_target, case when a.start > b.start then a.start - b.start end as distance from p a left join p b on b.path = a.link_target and b.phase = 0 where a.kind = 'hardlink' and a.phase = 0"
    out["subtree_sizes"] = f"with {nodes()}, x as (select size, unnest(list_concat([''], {up('path')})) as path from n1 where kind = 'file') select path, count(*) as n_files, sum(size)::bigint as bytes from x group by 1"
    out["wide_tree"] = "select 'o' || l_orderkey as path, count(*) as n_children, 16 + 24 * (count(*) + 1) as table_bytes, sum(17 + strlen('l' || l_linenumber) + 56)::bigint as open_bytes from lineitem group by 1"
    out["fixed_chunks"] = f"with {chunks()} select * from c1"
    out["dedup_intra"] = f"with {chunks()}, {marked('c1')} select stream_id, seq, digest, is_new from z"
    out["dedup_previous"] = f"with {chunks(1)}, {chunks(2)}, {marked('c2', 'c1')} select stream_id, seq, is_new from z"
    out["upload_stats"] = f"with {chunks(1)}, {chunks(2)}, {marked('c2', 'c1')} select stream_id, max(end_offset) as size, count(*) as chunk_count, count(*) filter (is_new) as new_chunks, coalesce(sum(size) filter (is_new), 0)::bigint as new_bytes, count(*) filter (not is_new) as reused_chunks from z group by 1"
    out["index_entries"] = f"with {chunks()} select stream_id, seq, lag(end_offset, 1, 0) over o as start, end_offset, end_offset > lag(end_offset, 1, 0) over o as ascending, digest from c1 window o as (partition by stream_id order by seq)"
    out["index_checksum"] = f"with {chunks()} select stream_id, sha256(unhex(string_agg({LE} || digest, '' order by seq))) as checksum, count(*) as n_entries, max(end_offset) as size from c1 group by 1"
    out["index_batches"] = f"with {chunks()} select stream_id, seq // 4 as batch, count(*) as n_entries, min(\"offset\") as first_offset, max(end_offset) as end_offset from c1 group by 1, 2"
    out["progress_running"] = f"with {chunks()} select stream_id, seq, sum(size) over (partition by stream_id order by seq rows unbounded preceding)::bigint as done_bytes, lead(seq) over (partition by stream_id order by seq) is null as done from c1"
    out["stored_chunks"] = f"with {chunks()} select count(*) as n_chunks, sum(size)::bigint as n_bytes from (select digest, max(size) as size from c1 group by 1)"
    out["known_set"] = f"with {chunks(1)}, {chunks(2)} select digest from c1 union select digest from c2"
    out["common_chunks"] = f"with {chunks(1)}, {chunks(2)} select distinct digest, size from c1 where digest in (select digest from c2)"
    out["inject_frames"] = f"with {chunks()} select stream_id, seq, \"offset\", end_offset, size, digest, seq % 2 = 0 as injected from c1"
    out["list_snapshots"] = f"with {SNAPS} select ns, type, count(distinct id) as n_groups, count(*) as n, max(time) as newest from s group by 1, 2"
    out["latest_snapshot"] = f"with {SNAPS} select ns, type, id, max(time) as time from s group by 1, 2, 3"
    out["previous_snapshot"] = f"with {SNAPS}, x as (select distinct ns, type, id, time from s) select ns, type, id, time, lag(time) over (partition by ns, type, id order by time) as prev_time from x"
    out["snapshot_as_of"] = f"""with {SNAPS}, a as (select distinct ns, type, id, time + event_id % 3600 as at from s), x as (select distinct ns, type, id, time from s)
      select a.ns, a.type, a.id, a.at, x.time as prev_time from a asof left join x on a.ns = x.ns and a.type = x.type and a.id = x.id and a.at > x.time"""
    out["list_groups"] = f"""with {FILES}, l as (select ns, type, id, max(time) as last_backup, count(distinct time) as n_snapshots from mf group by 1, 2, 3)
      select l.ns, l.type, l.id, last_backup, n_snapshots, (select string_agg(f, ',' order by f) from (select distinct filename as f from mf where mf.ns = l.ns and mf.type = l.type and mf.id = l.id and mf.time = l.last_backup)) as files from l"""
    out["format_resolution"] = f"""with {FILES} select ns, type, id, time, case when bool_or(filename = 'root.pxar.didx') then 'v1' when bool_or(filename = 'root.mpxar.didx') and bool_or(filename = 'root.ppxar.didx') then 'v2' else 'none' end as format, bool_or(crypt_mode = 'encrypt') as encrypted from mf group by 1, 2, 3, 4"""
    out["commit_conflicts"] = f"with {FILES} select ns, type, id, time, count(*) as n from mf group by 1, 2, 3, 4 having count(*) > 1"
    out["namespaces"] = f"with {SNAPS} select distinct 'click/' || type as ns from s where ns = 'click' union all select distinct ns from s"
    out["changed_files"] = f"with {RUNS} select path, unchanged, payload_offset from r"
    out["reuse_runs"] = f"with {RUNS} select path, seq, unchanged, run_id from r"
    out["run_coverage"] = f"with {COVER} select run_id, last_seq, run_start, run_end, used, n_files, c_start, c_end, n_chunks, total from cv"
    out["reuse_plan"] = f"with {PLAN} select * from pl"
    out["reuse_offsets"] = f"with {PLAN} select path, seq, reuse, (16 + coalesce(sum(case when not reuse then 16 + size else coalesce(run_total, 0) end) over (order by seq rows between unbounded preceding and 1 preceding), 0) + coalesce(rel, 0))::bigint as payload_offset from pl"
    out["reuse_stats"] = f"with {PLAN} select count(*) as files, count(*) filter (reuse) as reused_files, coalesce(sum(size) filter (reuse), 0)::bigint as reused_bytes, coalesce(sum(run_total), 0)::bigint as injected_bytes, (select count(*) filter (rejected) from dc) as rejected_runs from pl"
    out["threshold_sweep"] = f"""with {COVER}, g as (select cv.*, t.threshold from cv, (select unnest([0.05, 0.1, 0.25, 0.5, 0.9]::double[]) as threshold) t)
      select threshold, count(*) filter (ok) as reused_runs, coalesce(sum(n_files) filter (ok), 0)::bigint as reused_files from (select *, c_end >= run_end and total >= used and (total - used) / total <= threshold as ok from g) group by 1"""
    out["readdir_page"] = f"""with {nodes()}, x as (select {parent('path')} as parent, {base('path')} as name, kind from n1 where path <> ''), y as (select *, row_number() over (partition by parent order by name)::int as "at" from x) select parent, name, kind, "at" from y where "at" > 2 and "at" <= 7"""
    out["lookup_path"] = f"with {nodes()}, {ASKED} select z.path, kind, size from (select distinct path from q) z left join n1 using (path)"
    out["resolve_hardlink"] = f"with {nodes()} select a.path, a.link_target, null::varchar as problem, b.size from n1 a join n1 b on b.path = a.link_target where a.kind = 'hardlink'"
    out["resolve_symlink"] = f"""with {docs(1)} select dir || '/l' || doc_id as path, case when doc_id % 6 in (0, 1) then path end as resolved, case when doc_id % 6 in (0, 1) then 'file' end as kind from d1
      union all select dir || '/l' || doc_id || '.x', path, 'file' from d1 where doc_id % 6 = 1"""
    out["read_range"] = f"""with {chunks()}, rg as (select doc_id as range_id, 'd' || doc_id as stream_id, doc_id % 700 as a, doc_id % 700 + 900 as b from d1)
      select range_id, stream_id, seq, digest, greatest(a, "offset") - "offset" as chunk_from, least(b, end_offset) - greatest(a, "offset") as n_bytes from rg join c1 using (stream_id) where "offset" < b and end_offset > a"""
    out["restore_selection"] = f"with {nodes()}, {ASKED} select path, kind from n1 where exists (select 1 from q where n1.path = q.path or starts_with(n1.path, q.path || '/'))"
    out["tree_diff"] = f"""with {nodes(1)}, {nodes(2)} select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change
      from n1 a full join n2 b on a.path = b.path where a.path is null or b.path is null or (a.kind, a.size, a.mtime_secs) <> (b.kind, b.size, b.mtime_secs)"""
    out["verify_snapshot"] = f"""with {chunks()}, k as (select stream_id, count(*) as n, bool_and(not starts_with(digest, '7f')) as held from c1 group by 1)
      select 'listed' as "check", stream_id as subject, true as ok from k union all select 'checksum', stream_id, not ends_with(stream_id, '3') from k union all select 'size', stream_id, not ends_with(stream_id, '4') from k
      union all select 'ascending', stream_id, true from k union all select 'chunks', stream_id, held from k"""
    out["dangling_chunks"] = f"with {chunks()} select stream_id, seq, digest from c1 where starts_with(digest, '7')"
    out["tampered_chunks"] = f"""with {docs(1)}, x as (select case when doc_id % 8 = 0 then sha256('other') else sha256(text) end as digest, case when doc_id % 9 = 0 then 'size' when doc_id % 8 = 0 then 'digest' end as problem from d1)
      select digest, problem, count(*) as n from x where problem is not null group by 1, 2"""
    out["restore_order"] = f"""with {nodes()}, k as (select path, kind, case when path = '' then []::varchar[] else string_split(path, '/') end as key from n1)
      select path, row_number() over (order by key) - 1 as step, 1 as phase from k
      union all select path, (select count(*) from n1) + row_number() over (order by key desc) - 1, 2 from k where kind = 'directory'"""
    out["restore_copies"] = f"""with {nodes()}, q as (select path from n1 where kind = 'hardlink' union select dir from d1 where lang = 'de'),
      s as (select * from n1 where exists (select 1 from q where n1.path = q.path or starts_with(n1.path, q.path || '/'))), u as (select distinct unnest({up('path')}) as path from s)
      select s.path, case when s.kind = 'hardlink' then 'file' else s.kind end as kind, case when s.kind = 'hardlink' then t.size else s.size end as size, case when s.kind = 'hardlink' then t.mode else s.mode end as mode, case when s.kind = 'hardlink' then s.link_target end as source
      from s left join n1 t on t.path = s.link_target union all select path, 'directory', 0, {0o40755}, null from u where path not in (select path from s)"""
    out["listing_filter"] = f"with {SNAPS} select event_id, ns, time from s where type = 'vm' and id = 'u7'"
    out["newest_first"] = f"with {SNAPS} select event_id, row_number() over (partition by ns, type, id order by time desc, event_id)::int as place from s"
    out["listing_order"] = f"with {SNAPS}, x as (select distinct ns, type, id from s) select ns, type, id, row_number() over (partition by ns order by type, id)::int as place from x"
    out["unclosed_indexes"] = f"with {SNAPS}, x as (select s.*, e.value from s join events e using (event_id)) select ns, type, id, time, count(*) filter (value < 1) as n from x group by 1, 2, 3, 4 having count(*) filter (value < 1) > 0"
    out["authorised_chunks"] = f"""with {chunks()}, x as (select string_split(dir, '/')[1] as session, lang, digest from d1 join c1 on stream_id = 'd' || doc_id)
      select session, digest, bool_or(lang = 'en') as allowed from x group by 1, 2"""
    blob = "b as (select page_id, 'page' || page_id || '.blob' as filename, strlen(coalesce(html, ''))::bigint as size, sha256(coalesce(html, '')) as csum from pages)"
    out["blob_uploads"] = f"with {blob} select * from b"
    out["verify_blobs"] = f"""with {blob}, x as (select page_id, filename, case when page_id % 11 = 0 and page_id % 13 = 0 then null when page_id % 13 = 0 then 'missing' when page_id % 11 = 0 then 'unlisted'
      when page_id % 7 = 0 then 'size' when page_id % 5 = 0 then 'checksum' end as problem from b) select * from x where problem is not null"""
    out["manifest_identity"] = f"with {SNAPS} select event_id, not (event_id % 9 = 1 and type <> 'host' or event_id % 9 in (2, 3)) as same from s"
    canonical = """'{"backup-id":"' || id || '","backup-time":' || time || ',"backup-type":"' || type || '"}'"""

    def mac(text: str, key: bytes) -> str:
        inner, outer = ("".join(f"{b ^ x:02x}" for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C))
        return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode({text}))))))"

    out["manifest_signatures"] = f"""with {SNAPS}, x as (select event_id, event_id % 6 as k, {canonical} as c from s)
      select event_id, case k when 0 then null when 1 then {mac('c', b'other')} when 2 then {mac("c || ' '", q.KEY)} else {mac('c', q.KEY)} end as signature,
        case k when 0 then 'unsigned' when 1 then 'bad signature' when 2 then 'bad signature' when 3 then 'other key' else 'ok' end as verdict from x"""
    out["chunk_content"] = f"""with {docs(1)}, x as (select 'd' || doc_id as stream_id, 0 as seq, sha256(text) as digest, text from d1)
      select stream_id, seq, case digest[1] when '0' then 'missing' when '1' then 'size' else 'digest' end as problem from x where digest[1] in ('0', '1') or digest[1] = '2' and contains(text, 'e')"""
    out["estimate_check"] = " union all ".join(f"select * from (with {events(v)} select {v} as version, (sum(bytes) + {24 if v == 2 else 0})::bigint as estimate, max(start + bytes)::bigint as \"end\", sum(bytes) + {24 if v == 2 else 0} = max(start + bytes) as ok from p)" for v in (1, 2))
    places = f"{events(1)}, sp as (select path, min(start) as a, max(start + bytes) as b from p group by 1)"
    out["children_inside"] = f"with {places} select x.path, count(*) as n_children, bool_and(y.a > x.a and y.b < x.b) as ok from sp x join sp y on y.path <> '' and {parent('y.path')} = x.path group by 1"
    out["directory_items"] = f"with {places} select x.path, {base('y.path')} as name, (y.a - x.a)::bigint as start, (y.b - y.a)::bigint as length from sp x join sp y on y.path <> '' and {parent('y.path')} = x.path"
    out["root_composition"] = f"""with {nodes()}, {PAGES} select case when path = '' then 'docs' else 'docs/' || path end as path, kind, size from n1 union all select 'pages/' || path, kind, null from pg
      union all select 'item' || item_id, 'file', strlen(coalesce(text, ''))::bigint from benchmark"""
    out["stream_nodes"] = f"select 'p' || page_id as path, 'file' as kind, {0o100644}::bigint as mode, 0::bigint as uid, 0::bigint as gid, strlen(coalesce(html, ''))::bigint as size from pages"
    out["node_warnings"] = f"""with {PAGES}, x as (select case page_id % 9 when 0 then path || '/..' when 1 then path || repeat('x', 256) else path end as path, case when page_id % 8 = 0 then 'door' else kind end as kind from pg),
      w as (select case when kind = 'door' then 'unsupported kind door' when {base('path')} in ('', '.', '..') or contains({base('path')}, chr(0)) then 'bad name' when strlen({base('path')}) > 255 then 'long name' end as warning from x)
      select warning, count(*) as n from w where warning is not null group by 1"""
    esc = "replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    for code in range(32):
        short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}.get(code, f"u{code:04x}")
        if code:
            esc = f"replace({esc}, chr({code}), chr(92) || '{short}')"
    out["cdc_chunks"] = f"with recursive {docs(1)}, {cuts()} select * from cdc1"
    out["cdc_bounds_check"] = f"""with recursive {docs(1)}, {cuts()}, x as (select *, coalesce(lag(end_offset) over w, 0) = "offset" and end_offset > "offset" as tiles, lead(seq) over w is null as last from cdc1 window w as (partition by stream_id order by seq))
      select stream_id, bool_and(tiles) as tiles, bool_and((size >= {q.AVG // 4} or last) and size <= {q.AVG * 4}) as in_bounds, count(*) as n_chunks from x group by 1"""
    out["cdc_size_histogram"] = f"with recursive {docs(1)}, {cuts()} select (size // 256)::bigint as cell, count(*) as n, sum(size)::bigint as bytes from cdc1 group by 1"
    out["cdc_new_bytes"] = f"with recursive {docs(1)}, {docs(2)}, {cuts(1)}, {cuts(2)}, {marked('cdc2', 'cdc1')} select stream_id, max(end_offset) as size, count(*) as chunk_count, count(*) filter (is_new) as new_chunks, coalesce(sum(size) filter (is_new), 0)::bigint as new_bytes, count(*) filter (not is_new) as reused_chunks from z group by 1"
    # formats: what was written and read again is what the tables hold
    group = f"'a' || (doc_id // {q.GROUP})"
    for v in (1, 2):
        # 16 bytes lead a payload and each file's record in it; files come in the order of their paths' parts
        offset = f"(16 + coalesce(sum(16 + strlen(text)) over (partition by doc_id // {q.GROUP} order by string_split(path, '/') rows between unbounded preceding and 1 preceding), 0))::bigint" if v == 2 else "null::bigint"
        out[f"archive_v{v}_entries"] = f"""with {docs(1)} select {group} as archive, path, 'file' as kind, 33188::bigint as mode, (doc_id % 3)::bigint as uid, mtime_secs::bigint as mtime_secs, strlen(text)::bigint as size, {offset} as payload_offset, lang as attribute, sha256(text) as digest from d1
          union all select distinct a, p, 'directory', {0o40755}::bigint, 0::bigint, 0::bigint, null::bigint, null::bigint, null, null from (select {group} as a, unnest(list_concat([''], {up('path')})) as p from d1)"""
    out["catalog_entries"] = f"""with {docs(1)} select {group} as name, path, 'f' as letter, strlen(text)::bigint as size, mtime_secs::bigint as mtime from d1
      union all select distinct a, p, 'd', null::bigint, null::bigint from (select {group} as a, unnest({up('path')}) as p from d1)"""
    out["index_records"] = f"with {chunks()} select stream_id as name, seq, \"offset\" as start_offset, end_offset, digest from c1"
    out["frame_records"] = f"with {chunks()} select stream_id as name, seq, case seq % 2 when 0 then 'inject' else 'data' end as kind, digest, size from c1"
    out["blob_records"] = "select 'p' || page_id as name, strlen(coalesce(html, ''))::bigint as size, sha256(coalesce(html, '')) as digest from pages"
    out["archive_refs_resolve"] = f"with {docs(1)} select {group} as archive, count(*) as n_files, true as ok from d1 group by 1"
    out["preludes"] = f"""with {docs(1)} select doc_id, sha256('{{"exclude-patterns":"' || {esc} || '"}}') as digest from d1"""
    out["declared_sizes"] = f"""with {docs(1)}, x as (select doc_id, doc_id % 40 * 50 as size, strlen(text) as actual, hex(encode(text)) as h from d1)
      select doc_id, size, size as written, sha256(rpad(substring(h, 1, (2 * size)::int), (2 * size)::int, '0')) as digest, case when actual < size then 'size-changed ' || actual when actual > size then 'size-changed ' || (size + 1) end as warning from x"""
    out["snapshot_paths"] = f"with {SNAPS} select event_id, type || '/' || id || '/' || strftime(make_timestamp(time * 1000000), '%Y-%m-%dT%H:%M:%SZ') as path, ns as comment from s"
    out["blob_names"] = "select p_partkey, case p_partkey % 5 when 3 then p_name || '.blob' when 4 then p_name || '.blob' end as blob_name from part"
    out["fingerprints"] = f"with {docs(1)} select doc_id, regexp_replace(regexp_replace(sha256(sha256(path) || 'key'), '(..)', '\\1:', 'g'), ':$', '') as fingerprint, sha256(text || 'key') as keyed_digest from d1"
    out["reserved_children"] = f"with {docs(1)} select case when doc_id % 9 = 1 then dir || '/.pxarexclude-cli' else path end as path, count(*) as n from d1 where doc_id % 9 <> 0 group by 1"
    return out
