"""The queries as DuckDB SQL over the driver's tables, written independently of the operators."""

from __future__ import annotations

from ..operators.filters import METADATA_NAMES
from .queries import BIG, EXCLUDED, HEAD, ODD_FOLDERS, ODD_NAMES, RUN_DEST
from .views import DEST_SPECS, ODD_LINES

# Views, by name: (views it needs, body).
_VIEWS = {
    "fx_base": ((), """
select concat('shoot_', lpad(cast(l_suppkey as varchar), 3, '0'), '/',
              case when l_discount = 0.1 then '._' else '' end,
              'IMG_', lpad(cast(l_orderkey % 200 as varchar), 4, '0'), '_', cast(l_linenumber as varchar),
              case l_returnflag when 'A' then '.JPG' when 'N' then '.MP4' else '.ARW' end) as path,
       cast(l_partkey % 10 as bigint) * 100000 + cast(l_quantity as bigint) as size,
       cast(epoch(l_shipdate) as bigint) + l_linenumber * 3600 as mtime,
       l_partkey, l_quantity, l_linestatus, l_tax, l_shipdate
from lineitem"""),
    "fx_files_raw": (("fx_base",), """
select 'card' as label, path, size, mtime, l_partkey, l_shipdate from fx_base where l_linestatus = 'O'
union all
select 'backup_a', concat('copy/', lower(path)), size, mtime + (l_partkey % 7) - 3, l_partkey, l_shipdate
from fx_base where l_linestatus = 'O' and l_quantity <= 30
union all
select 'backup_b', concat('b/', path), size + case when l_tax = 0.08 then 1 else 0 end, mtime, l_partkey, l_shipdate
from fx_base where l_quantity > 25
union all
select 'mirror', path, size + case when l_tax = 0.08 then 1 else 0 end, mtime, l_partkey, l_shipdate
from fx_base where l_quantity < 45 and (l_linestatus = 'O' or l_tax = 0.06)"""),
    "fx_files": (("fx_files_raw",), """
select label, path, size, mtime, l_partkey, l_shipdate
from (select *, row_number() over (partition by label, path order by size, mtime, l_partkey, l_shipdate) as rn
      from fx_files_raw) x where rn = 1"""),
    "fx_exif": (("fx_files",), """
select label, path,
       case when l_partkey % 9 = 0 then null
            else mtime - 30 + case when label <> 'card' and l_partkey % 5 = 0 then 10 else 0 end end as taken_at,
       case when l_partkey % 11 = 0 then null
            when label = 'backup_b' and l_partkey % 13 = 0 then 'GoPro'
            when label = 'card' then 'SONY' else ' sony ' end as camera_make,
       case when l_partkey % 17 = 0 then null else 'ILCE-7M4' end as camera_model
from fx_files where lower(path) like '%.jpg' and l_partkey % 4 <> 0"""),
    "fx_scans": ((), """
select o_orderkey + 1 as id, concat('drive_', lpad(cast(o_custkey % 40 as varchar), 2, '0')) as label,
       concat('/Volumes/d', cast(o_custkey % 40 as varchar)) as root_path,
       case o_orderkey % 3 when 0 then 'hdd' when 1 then 'ssd' else 'unknown' end as drive_type,
       o_orderdate as started_at, case when o_orderstatus = 'P' then null else o_orderdate end as finished_at,
       o_custkey as file_count,
       case when o_orderpriority = '1-URGENT' then 'incremental' else 'full' end as scan_mode,
       case when o_orderpriority = '1-URGENT' then o_orderkey end as parent_scan_id
from orders"""),
    "fx_latest": (("fx_scans",), """
select * from (select *, row_number() over (partition by label order by started_at desc, id desc) as rn
               from fx_scans where finished_at is not null) x where rn = 1"""),
    "fx_audit_runs": ((), f"""
select o_orderkey + 1 as id, concat('drive_', lpad(cast(o_custkey % 40 as varchar), 2, '0')) as source_ident,
       'label' as source_kind,
       o_orderkey + 1 - case when o_orderkey % 50 = 0 then 1000000000 else 0 end as source_scan_id,
       case when o_custkey % 100 = 0 then 'oops' else '{DEST_SPECS}' end as dest_specs,
       o_custkey % 100 as total_files, o_custkey % 100 - (o_custkey % 100) % 7 as matched_count,
       (o_custkey % 100) % 7 as missing_count, o_orderkey % 5 as fifth, o_orderdate as ran_at
from orders"""),
    "fx_audit_missing": ((), """
select l_orderkey + 1 as run_id,
       concat('shoot_', cast(l_suppkey % 5 as varchar), '/p', cast(l_partkey % 20 as varchar), '.arw') as source_path,
       min(cast(l_quantity as bigint)) as size
from lineitem group by all"""),
    "fx_contents": ((), """
select doc_id, concat(source, '/', lang, '/doc_', cast(doc_id as varchar), '.txt') as path,
       cast(octet_length(encode(text)) as bigint) as size, text
from documents"""),
    "fx_lsl": (("fx_files",), """
select concat(lpad(cast(size as varchar), 9, ' '), ' ', cast(l_shipdate as varchar), '.000000000 ', path) as value
from fx_files where label = 'card'
union all select unnest([""" + ", ".join(f"'{line}'" for line in ODD_LINES) + "])"),
    # Audit: the card against both backups.
    "clean": (("fx_files",), """
select label, path, size, mtime, lower(split_part(path, '/', -1)) as bn
from fx_files where not starts_with(split_part(path, '/', -1), '._')"""),
    "src": (("clean",), "select * from clean where label = 'card'"),
    "dst": (("clean",), """
select case label when 'backup_a' then 0 else 1 end as ord, label as dest, path, size, mtime, bn
from clean where label in ('backup_a', 'backup_b')"""),
    "hits": (("src", "dst"), """
select path, size, dest, ord, dest_path from (
  select s.path, s.size, d.dest, d.ord, d.path as dest_path,
         row_number() over (partition by s.path, d.dest order by d.mtime, d.path) as rn
  from src s join dst d on s.size = d.size and s.bn = d.bn and abs(s.mtime - d.mtime) <= 2) x where rn = 1"""),
    "lost": (("src", "hits"), "select path, size from src anti join hits using (path)"),
    "pairs": (("hits", "fx_exif"), """
select h.path, h.dest, case
  when s.path is null or d.path is null then 'weak'
  when lower(trim(s.camera_make)) <> lower(trim(d.camera_make)) then 'conflict'
  when lower(trim(s.camera_model)) <> lower(trim(d.camera_model)) then 'conflict'
  when abs(s.taken_at - d.taken_at) > 5 then 'conflict'
  when s.taken_at is not null and d.taken_at is not null then 'strong' else 'weak' end as kind
from hits h left join fx_exif s on s.label = 'card' and s.path = h.path
left join fx_exif d on d.label = h.dest and d.path = h.dest_path"""),
    "proof": (("pairs",), """
select path, case when bool_or(kind = 'strong') then 'strong' when bool_and(kind = 'conflict') then 'conflict'
  else 'weak' end as kind from pairs group by path"""),
    "compared": (("fx_files",), f"""
select coalesce(a.path, b.path) as path, a.size as size_a, b.size as size_b,
       case when b.path is null then 'only_a' when a.path is null then 'only_b'
            when a.size = b.size then 'match' else 'differ' end as state
from (select * from fx_files where label = 'card') a full join (select * from fx_files where label = 'mirror') b
  on a.path = b.path
where coalesce(a.size, b.size) >= {BIG}"""),
    "prev": (("fx_audit_runs",), """
select id as run_id, lag(id) over (partition by source_ident order by ran_at, id) as previous_id from fx_audit_runs"""),
    "placed": (("fx_audit_runs", "fx_scans"), f"""
select r.id as run_id, case when dest_specs <> 'oops' then '{RUN_DEST}' end as dest_ident,
       s.root_path as source_root, case when dest_specs <> 'oops' then '{RUN_DEST}' end as dest_root,
       case when dest_specs = 'oops' then 'the run has no destination'
            when s.id is null then 'the source scan is gone' end as refusal
from fx_audit_runs r left join fx_scans s on s.id = r.source_scan_id"""),
    "planned": (("placed", "fx_audit_missing"), """
select m.run_id, m.source_path as path, m.size, concat(p.source_root, '/', m.source_path) as source_path,
       concat(p.dest_root, '/', m.source_path) as dest_path
from fx_audit_missing m join placed p on p.run_id = m.run_id where p.refusal is null"""),
    "wanted": (("fx_contents",), """
select path, size from fx_contents where size >= 1 and size in (
  select size from fx_contents where size >= 1 group by size having count(*) >= 2)"""),
    "todo": (("wanted", "fx_contents"), """
select * from wanted anti join (select path from fx_contents where doc_id % 3 = 0) using (path)"""),
    "prints": (("fx_contents",), f"""
select path, size, md5(text) as fingerprint, 0 as sample_size from fx_contents
union all
select path, size, md5(array_slice(encode(text), 1, {HEAD})), {HEAD} from fx_contents"""),
}


def _needed(names: tuple) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _VIEWS[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


#: Views that several others read: worked out once.
_ONCE = ("fx_files", "clean", "hits")


def _sql(needs: str, body: str) -> str:
    views = ",\n".join(f"{n} as {'materialized ' * (n in _ONCE)}({_VIEWS[n][1]})" for n in _needed(tuple(needs.split())))
    return f"with {views}\n{body}" if views else body


def _human(size: str) -> str:
    cases = [f"when {size} < 1024 then concat({size}, ' B')"]
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        scaled = f"{size}::double / {1024.0**power:.1f}"
        cases.append(f"when {scaled} < 1024 then concat(printf('%.1f', {scaled}), ' {unit}')")
    return f"case {' '.join(cases)} else concat(printf('%.1f', {size}::double / {1024.0**6:.1f}), ' EB') end"


def _folders(rows: str, key: str = "path") -> str:
    return f"""
select split_part({key}, '/', 1) as folder, count(*) as files, cast(sum(size) as bigint) as bytes,
       list_sort(list({key}))[1:5] as shown, cast(greatest(count(*) - 5, 0) as bigint) as more
from {rows} group by 1"""


def _rolled(rows: str) -> str:
    return f"select folder, files, bytes, array_to_string(shown, ', ') as sample, more from ({_folders(rows)}) x"


_TOTALS = """
select count(*) as total_files, cast(sum(size) as bigint) as total_bytes,
       count(*) filter (matched) as matched, count(*) filter (not matched) as missing,
       cast(coalesce(sum(size) filter (not matched), 0) as bigint) as missing_bytes,
       100.0::double * (count(*) filter (matched)) / count(*) as percent
from (select size, path in (select path from {hits}) as matched from {src})"""


def _near(window: int, mtime: bool = True) -> str:
    """Chosen destination per card file, for another window or without times."""
    near = f"and abs(s.mtime - d.mtime) <= {window}" if mtime else ""
    order = "d.mtime, d.path" if mtime else "d.path"
    return _sql("src dst", f"""
select path, dest, dest_path from (
  select s.path, d.dest, d.path as dest_path,
         row_number() over (partition by s.path, d.dest order by {order}) as rn
  from src s join dst d on s.size = d.size and s.bn = d.bn {near}) x where rn = 1""")


_SYSTEM = "'.Spotlight-V100', '.fseventsd', '.Trashes', '.TemporaryItems', 'System Volume Information', '$RECYCLE.BIN'"



def _texts(values: tuple) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _matched(files: str, kept: str = "true") -> str:
    """Chosen destination per card file, over other files (label, path, size, mtime); only rows that are ``kept`` take part."""
    return _sql("fx_files", f"""
, odd as ({files}),
keyed as (select label, path, size, coalesce(mtime, 0) as mt, lower(split_part(path, '/', -1)) as bn from odd where {kept}),
firsts as (select label, size, bn, mt, min(path) as path from keyed where label <> 'card' group by all)
select path, dest, dest_path from (
  select s.path, d.label as dest, d.path as dest_path, row_number() over (partition by s.path, d.label order by d.mt, d.path) as rn
  from keyed s join firsts d on s.size = d.size and s.bn = d.bn and abs(s.mt - d.mt) <= 2
  where s.label = 'card') x where rn = 1""").replace(")\n\n, odd as", "),\nodd as")


_UNIT = "case l_orderkey % 6 when 0 then '' when 1 then 'k' when 2 then 'M' when 3 then 'GB' when 4 then 'tb' else 'Z' end"

_PAIRS = f"""
select path_a, path_b, size, regexp_extract(path_a, '^(.*)/[^/]*$', 1) as folder_a,
       regexp_extract(path_b, '^(.*)/[^/]*$', 1) as folder_b, confidence from """


def _json(section: str, key: str, rows: str, *fields: str) -> str:
    body = ", ".join(f"'{f}', {f}" for f in fields)
    return f"select '{section}' as section, cast({key} as varchar) as key, cast(json_object({body}) as varchar) as body from ({rows}) x"


ORACLE = {
    "lsl_parse": _sql("fx_lsl", r"""
, parts as (select regexp_extract(value, '^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S.*)$', ['size', 'd', 't', 'path']) as p from fx_lsl)
select p.path as path, try_cast(p.size as bigint) as size,
       coalesce(epoch(try_cast(concat(p.d, ' ', p.t) as timestamp)), 0.0) as mtime
from parts where try_cast(p.size as bigint) is not null and not starts_with(split_part(p.path, '/', -1), '._')
  and split_part(p.path, '/', 1) <> '.Trashes'""").replace(")\n\n, parts", "),\nparts"),
    "files_dedup": _sql("fx_files", "select label, path, size, mtime from fx_files"),
    "nfc_paths": "select md5(nfc_normalize(raw)) as path_md5, md5(raw) as raw_md5 "
    "from (select concat(source, '/e', chr(769), '_', text) as raw from documents) x",
    "metadata_filter": _sql("fx_files", """
select label, path, size from fx_files where not starts_with(split_part(path, '/', -1), '._')"""),
    "system_dirs": _sql("fx_files", f"""
select * from (select label, concat(case l_partkey % 5 when 0 then '.Trashes/' when 1 then 'a/$RECYCLE.BIN/'
  when 2 then 'x.fseventsd/' else '' end, path) as path, size from fx_files) x
where not starts_with(split_part(path, '/', -1), '._')
  and not list_has_any(string_split(path, '/'), [{_SYSTEM}])"""),
    "min_size": _sql("fx_files", f"select label, path, size from fx_files where size >= {BIG}"),
    "exclude_regex": _sql("fx_files", f"""
select label, path, size from fx_files where not regexp_matches(path, '{EXCLUDED}')"""),
    "exclude_python": _sql("fx_files", """
select * from (select label, concat(path, case l_partkey % 3 when 0 then 'é' when 1 then chr(10) else '_É1' end) as path, size from fx_files) x
where not regexp_matches(path, '(000|111|222|333|444|555|666|777|888|999)_')
  and not regexp_matches(path, '_7\\.[mM][pP]4[\\p{L}\\p{N}_]+$')
  and not regexp_matches(path, '/[iI][mM][gG]_0*1[0-9]_[0-9a-zA-Z]\\.[aA][rR][wW]\\n?$')"""),
    "self_exclusion": _sql("fx_files", """
select * from (select label, path, concat('/Volumes/', label, '/', path) as abs_path from fx_files) x
where not starts_with(abs_path, '/Volumes/card/shoot_001/')"""),
    "match_keys": _sql("fx_files", """
select label, path, size, lower(split_part(path, '/', -1)) as bn, cast(trunc(mtime + 0.75) as bigint) as mt,
       regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, concat('/Volumes/x/', path) as abs_path from fx_files"""),
    "parse_size": f"""
select l_orderkey, concat(' ', cast(l_quantity / 4 as varchar), {_UNIT}, case when l_linenumber = 1 then ' ' else '' end) as text,
       case when l_orderkey % 6 < 5 then cast(trunc(l_quantity / 4 * 1024.0 ** (l_orderkey % 6)) as bigint) end as bytes
from lineitem""",
    "human_size": f"""
select l_orderkey, size, {_human('size')} as text
from (select l_orderkey, (l_partkey % 9000 + l_linenumber) * cast(1000.0 ** (l_orderkey % 6) as bigint) as size from lineitem) x""",
    "jpeg_filter": _sql("fx_files", "select label, path from fx_files where lower(path) like '%.jpg'"),
    "label_clean": _sql("fx_scans", "select id, concat(label, ' ', drive_type, 'x y') as label from fx_scans"),
    "exif_clean": _sql("fx_exif", """
select concat(label, '/', path) as path, case when camera_model is not null then taken_at end as taken_at,
       trim(camera_make) as camera_make, camera_model
from fx_exif where (camera_model is not null and taken_at is not null) or camera_make is not null or camera_model is not null"""),
    "audit_matches": _sql("hits", "select path, dest, dest_path from hits"),
    "audit_matches_legacy": _near(0, mtime=False),
    "audit_wide_window": _near(7200),
    "audit_missing": _sql("lost", "select path, size from lost"),
    "audit_totals": _sql("src hits", _TOTALS.format(hits="hits", src="src")),
    "audit_per_dest": _sql("hits", """
select n.dest, count(h.path) as matched
from (select unnest(['backup_a', 'backup_b', 'empty_drive']) as dest) n left join hits h on h.dest = n.dest group by 1"""),
    "audit_filtered": _sql("src hits", _TOTALS.format(
        hits="hits", src=f"src where size >= {BIG} and not regexp_matches(path, '{EXCLUDED}')")),
    "coverage": _sql("src hits", """
select s.size, s.bn, min(h.ord) as first_ord from src s left join hits h on h.path = s.path group by all"""),
    "audit_small_source": _sql("hits", "select path, dest, dest_path from hits where path like 'shoot_001/%'"),
    "audit_stored": _sql("hits", "select path, dest, dest_path from hits"),
    "audit_hot_key": _matched("""
select label, case when l_partkey % 3 = 0 then concat(case label when 'card' then 'c/' when 'backup_a' then 'a/' else 'b/' end,
                                                      md5(path), '/SAME.JPG') else path end as path,
       case when l_partkey % 3 = 0 then 7 else size end as size,
       case when l_partkey % 3 = 0 then 1600000000 + case label when 'card' then 0 when 'backup_a' then l_partkey % 11 - 5
                                                               else l_partkey % 2 + 3 end else mtime end as mtime
from fx_files where label in ('card', 'backup_a', 'backup_b')""", "not starts_with(split_part(path, '/', -1), '._')"),
    "audit_spellings": """
select concat(source, '/', chr(233), '_', doc_id, '.txt') as path, cast(n_chars as bigint) as size from documents d
where not exists (select 1 from documents o where o.doc_id % 4 <> 0 and o.doc_id = d.doc_id and o.n_chars = d.n_chars)""",
    "audit_odd_files": _matched(f"""
select distinct on (label, path) label, path, size, mtime from (
  select label, concat(case when l_partkey % 13 < {len(ODD_FOLDERS)} then concat([{_texts(ODD_FOLDERS)}][l_partkey % 13 + 1], '/') else '' end,
                       case when l_partkey % 29 < {len(ODD_NAMES)} then [{_texts(ODD_NAMES)}][l_partkey % 29 + 1]
                            else concat('f', l_partkey, '_3.mp4') end) as path,
         size, case when l_partkey % 5 <> 0 then mtime end as mtime
  from fx_files where label in ('card', 'backup_a', 'backup_b'))
order by label, path, size, mtime nulls first""", f"""
not list_has_any(string_split(path, '/'), [{_SYSTEM}]) and not starts_with(split_part(path, '/', -1), '._')
and split_part(path, '/', -1) not in ({_texts(METADATA_NAMES)})
and (label <> 'card' or not ends_with(path, '_3.mp4') or mtime is null)
and (label = 'backup_b' or not regexp_matches(path, 'f[0-9]*1_3'))"""),
    "missing_by_folder": _sql("lost", _rolled("lost")),
    "matched_by_folder": _sql("src hits", _rolled("(select * from src where path in (select path from hits))")),
    "match_locations": _sql("hits", """
select path, string_agg(concat(dest, ':', dest_path), '; ' order by ord) as found from hits group by path"""),
    "audit_json": _sql("src hits lost", "\nunion all\n".join([
        _json("totals", "total_files", f"select *, {_human('total_bytes')} as total_bytes_human, "
              f"{_human('missing_bytes')} as missing_bytes_human from ({_TOTALS.format(hits='hits', src='src')})",
              "total_files", "total_bytes", "matched", "missing", "missing_bytes", "percent",
              "total_bytes_human", "missing_bytes_human"),
        _json("dest", "dest", """select n.dest, n.kind, count(h.path) as matched
              from (select unnest(['backup_a', 'backup_b', 'empty_drive']) as dest, unnest(['path', 'path', 'label']) as kind) n
              left join hits h on h.dest = n.dest group by all""", "dest", "kind", "matched"),
        _json("folder", "folder", f"select folder, files, bytes, shown as sample, more, {_human('bytes')} as bytes_human "
              f"from ({_folders('lost')})", "folder", "files", "bytes", "sample", "more", "bytes_human"),
        _json("missing", "path", f"select *, {_human('size')} as size_human from lost", "path", "size", "size_human"),
    ])),
    "pair_evidence": _sql("pairs", "select path, dest, kind from pairs"),
    "evidence": _sql("proof", "select path, kind from proof"),
    "evidence_counts": _sql("proof", """
select n.kind, count(p.path) as files
from (select unnest(['strong', 'weak', 'conflict']) as kind) n left join proof p on p.kind = n.kind group by 1"""),
    "evidence_conflicts": _sql("proof", "select path from proof where kind = 'conflict'"),
    "compare_summary": _sql("compared", """
select count(*) filter (state = 'match') as "match", count(*) filter (state = 'differ') as differ,
       count(*) filter (state = 'only_a') as only_a, count(*) filter (state = 'only_b') as only_b from compared"""),
    "compare_differ": _sql("compared", "select path, size_a, size_b from compared where state = 'differ'"),
    "compare_top_differ": _sql("compared", """
select path, size_a, size_b from compared where state = 'differ' order by greatest(size_a, size_b) desc, path limit 10"""),
    "compare_only_a": _sql("compared", """
select path, size_a as size from compared where state = 'only_a' order by size_a desc, path limit 10"""),
    "compare_only_b": _sql("compared", """
select path, size_b as size from compared where state = 'only_b' order by size_b desc, path limit 10"""),
    "latest_scan": _sql("fx_latest", "select id, label, root_path from fx_latest where label = 'drive_07'"),
    "parent_scan": _sql("fx_scans", """
select label, id as parent_scan_id from (
  select label, id, row_number() over (partition by label order by started_at desc, id desc) as rn
  from fx_scans where finished_at is not null and scan_mode = 'full') x where rn = 1"""),
    "labels": _sql("fx_latest", """
select label, id as scan_id, root_path, drive_type, file_count, finished_at as scanned_at from fx_latest"""),
    "scan_status": _sql("fx_scans", """
select id, label, drive_type, scan_mode,
       case when parent_scan_id is null then '' else concat('incremental of #', parent_scan_id) end as note,
       file_count, case when finished_at is null then 'in-progress' else 'done' end as state, started_at from fx_scans"""),
    "audit_status": _sql("fx_audit_runs", """
select id, source_ident, case when dest_specs = 'oops' then 'oops' else 'backup_a, /mnt/b' end as destinations,
       matched_count as matched, total_files,
       case when total_files = 0 then 0.0::double else 100.0::double * matched_count / total_files end as percent,
       missing_count as missing, ran_at from fx_audit_runs"""),
    "audit_decoded": _sql("fx_audit_runs", """
select id, case when dest_specs <> 'oops' then '/mnt/b' end as second_dest,
       case when fifth = 0 then 0 else 1 end as n_counts, case when fifth <> 0 then matched_count end as on_backup_a
from fx_audit_runs"""),
    "audit_readback": _sql("fx_audit_missing", f"""
select source_path as path, size, {_human('size')} as size_human from fx_audit_missing where run_id = 1"""),
    "audit_diff": _sql("prev fx_audit_missing", """
select p.run_id, m.source_path, m.size, 'newly_missing' as change
from prev p join fx_audit_missing m on m.run_id = p.run_id
left join fx_audit_missing o on o.run_id = p.previous_id and o.source_path = m.source_path
where p.previous_id is not null and o.run_id is null
union all
select p.run_id, m.source_path, m.size, 'newly_covered'
from prev p join fx_audit_missing m on m.run_id = p.previous_id
left join fx_audit_missing o on o.run_id = p.run_id and o.source_path = m.source_path
where o.run_id is null"""),
    "hash_candidates": _sql("fx_files", """
, m as (select path, size from fx_files where label = 'mirror' and size >= 1000)
select path, size from m where size in (select size from m group by size having count(*) >= 2)""").replace(")\n\n, m as", "),\nm as"),
    "hash_candidates_stored": _sql("clean", """
, m as (select path, size from clean where label = 'mirror' and size >= 1000)
select path, size from m where size in (select size from m group by size having count(*) >= 2)""").replace(")\n\n, m as", "),\nm as"),
    "hash_resume": _sql("todo fx_contents", """
select path, size, md5(text) as fingerprint from fx_contents where path in (select path from todo)"""),
    "hash_summary": _sql("wanted todo", """
select (select count(*) from wanted) as candidates, (select count(*) from todo) as todo,
       (select cast(sum(least(size, 1000)) as bigint) from todo) as bytes_to_read,
       (select count(*) from wanted) - (select count(*) from todo) as skipped"""),
    "hash_latest": _sql("fx_contents", """
select path, 'md5' as algo, cast(0 as bigint) as sample_size, md5(text) as fingerprint from fx_contents where doc_id % 3 = 0"""),
    "fingerprint_md5": _sql("fx_contents", "select path, md5(text) as fingerprint from fx_contents"),
    "fingerprint_head": _sql("fx_contents", f"""
select path, md5(array_slice(encode(text), 1, {HEAD})) as fingerprint from fx_contents"""),
    "dup_pairs": _sql("prints", _PAIRS + """(
  select min(path) over (partition by fingerprint, sample_size) as path_a, path as path_b, size,
         case when sample_size > 0 then 'tentative' else 'certain' end as confidence from prints) x
where path_a < path_b"""),
    "dup_pairs_across": _sql("fx_contents", """
, both_sides as (select path, size, md5(text) as fingerprint, 0 as sample_size from fx_contents union all
  select path, size, md5(array_slice(encode(text), 1, 2)), 2 from fx_contents),
marked as (select *, case when path like 'src1%' then 'a' else 'b' end as side from both_sides)
select m.side, m.path, m.size, regexp_extract(m.path, '^(.*)/[^/]*$', 1) as folder,
       (select min(o.path) from marked o where o.fingerprint = m.fingerprint and o.sample_size = m.sample_size and o.side = 'a') as original,
       case m.sample_size when 0 then 'certain' else 'tentative' end as confidence
from marked m where exists (select 1 from marked o where o.fingerprint = m.fingerprint and o.sample_size = m.sample_size
                            and o.side <> m.side)""").replace(")\n\n, both_sides", "),\nboth_sides"),
    "copy_roots": _sql("placed", "select * from placed"),
    "copy_plan": _sql("planned", "select * from planned"),
    "copy_plan_totals": _sql("planned", "select count(*) as files, cast(sum(size) as bigint) as bytes from planned"),
    "copy_outcome": _sql("src hits", """
, outcomes as (
  select if(s.size % 2 = 0, 1, 2)::bigint as run_id, s.path, s.size,
         m.path is not null and (s.size % 2 = 0 or m.size % 3 = 0) as listed,
         coalesce(s.size = m.size or (m.l_partkey % 4 = 0 and s.size = m.size + 1), false) as fits
  from src s left join (select path, size, l_partkey from fx_files where label = 'mirror') m on m.path = s.path
  where s.path not in (select path from hits))
select run_id, path, size, if(listed and fits, 'succeeded', 'failed') as outcome,
       case when not listed then 'not on destination' when not fits then 'size differs on destination' end as reason
from outcomes""").replace(")\n\n, outcomes", "),\noutcomes"),
    "copy_json": _sql("planned", "\nunion all\n".join([
        _json("totals", "files", f"select *, {_human('bytes')} as bytes_human from "
              "(select count(*) as files, cast(sum(size) as bigint) as bytes from planned)", "files", "bytes", "bytes_human"),
        _json("planned", "path", f"select *, {_human('size')} as size_human from planned", "run_id", "path", "size", "size_human"),
    ])),
}
