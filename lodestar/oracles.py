"""SQL for DuckDB that says the same as the queries, over the test tables."""

from __future__ import annotations

from .functions.files import PHOTO_EXTENSIONS, RTF_EXTENSIONS, RUNNABLE_EXTENSIONS, TEXT_EXTENSIONS, ZIP_EXTENSIONS
from .plans.queryparse import BIG, IN_FOLDER, KIND_WORDS, LARGE, LITTLE, OVER, PAST, SMALL, STOP_WORDS, UNDER
from .queries import APPS, COUNTRIES, KIND_EXTENSIONS, MOUNTS, NOW, PLACES, REQUESTS, TYPOS


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def words(x: str) -> str:
    """Folding is enough for the letters of the test tables."""
    camel = f"regexp_replace(regexp_replace(replace(strip_accents({x}), 'ß', 'ss'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({camel}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


FILES = """
base as (select *, ['txt', 'md', 'pdf', 'csv', 'jpg'][(doc_id % 5 + 1)::int] ext, (1704067200 + doc_id * 3600)::double mtime from documents),
files as (
  select doc_id id, '/corpus/' || source || '/' || lang || '/' || source || '_' || lang || '_' || doc_id || '.' || ext path,
    source || '_' || lang || '_' || doc_id || '.' || ext as name, '/corpus/' || source || '/' || lang folder, ext,
    case ext when 'pdf' then 'pdf' when 'csv' then 'spreadsheet' when 'jpg' then 'image' else 'document' end kind,
    false is_dir, n_chars size, mtime, case when ext = 'jpg' then mtime - 30 * 86400 end taken, text content from base),
docs as (
  select id, name, folder, content, case when taken is null then '' else strftime(make_timestamp((taken * 1000000)::bigint), '%Y') || ' '
    || lower(monthname(make_timestamp((taken * 1000000)::bigint))) end extra from files)"""

POSTINGS = f"""{FILES},
tok as (
  select id, 'name' field, unnest({words('name')}) term from docs union all select id, 'folder', unnest({words('folder')}) from docs
  union all select id, 'content', unnest({tokens('content')}) from docs union all select id, 'extra', unnest({words('extra')}) from docs),
post as (select term, field, id, count(*) tf from tok group by all),
len as (select d.id, coalesce(t.n, 0) dl from docs d left join (select id, count(*) n from tok group by id) t using (id)),
weights(field, w) as (values ('name', 10.0), ('folder', 3.0), ('content', 1.0), ('extra', 3.0))"""


def _bm25(phrases: list[tuple[int, str, bool]], n_groups: int | None) -> str:
    """CTEs up to ranked(id, raw)."""
    rows = _values([(k, g, t, p) for k, (g, t, p) in enumerate(phrases)]).replace("True", "true").replace("False", "false")
    having = f" having count(distinct grp) = {n_groups}" if n_groups else ""
    return f"""with {POSTINGS},
phr(phrase, grp, txt, pre) as (values {rows}),
f as (
  select phrase, grp, id, sum(tf * w) f from post join phr on (case when pre then starts_with(term, txt) else term = txt end)
  join weights using (field) group by all),
total as (select count(*) n, avg(dl) mean from len),
df as (select phrase, count(*) k from f group by phrase),
idf as (select phrase, case when ln((n - k + 0.5) / (k + 0.5)) <= 0 then 1e-6 else ln((n - k + 0.5) / (k + 0.5)) end idf from df, total),
ranked as (
  select id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))) raw from f join idf using (phrase) join len using (id), total
  group by id{having})"""


def _best(phrases: list[tuple[int, str, bool]], n_groups: int | None, limit: int = 100) -> str:
    return f"{_bm25(phrases, n_groups)} select id, path, round(raw, 6) raw from ranked join files using (id) order by round(raw, 6), id limit {limit}"


def _group(g: int, *terms: str) -> list[tuple[int, str, bool]]:
    return [(g, terms[0], False), (g, terms[0], True), *[(g, t, False) for t in terms[1:]]]


_PART_WORDS = f"""pw as (
  select word, max(src) src from (select unnest({words('p_name')}) word, 1 src from part union all select unnest({words('p_type')}), 0 from part) group by word)"""

_GRAMS = """grams as (
  select gram, word, count(*) tf, length(word) - 2 n_grams from (select word, substr(word, k::int, 3) gram from (select word, unnest(range(1, length(word) - 1)) k from pw where length(word) >= 3)) group by all)"""

_TYPOS = f"typos(term) as (values {_values(TYPOS)})"



def _osa(pairs: str) -> str:
    """CTEs up to osa(term, word, distance), cell by cell; the built-in functions count other edits."""
    return f"""cells(term, word, k, d) as (
  select term, word, 0, []::bigint[] from {pairs}
  union all select term, word, k + 1, list_append(d, case when i = 0 then j when j = 0 then i else least(d[k + 1 - w] + 1, d[k] + 1,
      d[k - w] + case when term[i] = word[j] then 0 else 1 end,
      case when i > 1 and j > 1 and term[i] = word[j - 1] and term[i - 1] = word[j] then d[k - 1 - 2 * w] + 1 else 99 end) end)
  from (select *, k // (length(word) + 1) i, k % (length(word) + 1) j, length(word) + 1 w from cells where k < (length(term) + 1) * (length(word) + 1))),
osa as (select term, word, d[-1] distance from cells where k = (length(term) + 1) * (length(word) + 1))"""


_RELATED = f"""{FILES},
noise(w) as (values {_values("the and for with from that this new copy final old pdf jpg jpeg png txt doc docx xls xlsx zip img dsc file files untitled home".split())}),
listed as (select id, list_concat(list_concat({words('name')}, {words('folder')}), {words('substr(content, 1, 3000)')}) w from docs),
placed as (select id, unnest(w) word, generate_subscripts(w, 1) pos from listed),
firsts as (
  select id, word, min(pos) pos from placed where length(word) between 3 and 25 and not regexp_matches(word, '^[0-9]+$') and word not in (select w from noise) group by all),
read as (select id, word from firsts qualify row_number() over (partition by id order by pos) <= 60 and count(*) over (partition by id) >= 2),
total as (select count(distinct id) n from read),
df as (select word, count(*) df from read group by word),
usable as (select word, df from df, total where df >= 3 and df <= greatest(3, floor(0.2 * n))),
rare as (select id, word from read join usable using (word) qualify row_number() over (partition by id order by df, word) <= 15),
pairs as (select a.word a, b.word b, count(*) c from rare a join rare b on a.id = b.id and a.word < b.word group by all),
rated as (
  select a, b, c / (x.df + y.df - c) score from pairs join usable x on x.word = a join usable y on y.word = b, total
  where n >= 20 and c >= 3 and c < n and ln(c * n / (x.df * y.df)) / -ln(c / n) >= 0.3 and c / (x.df + y.df - c) >= 0.25),
both_ways as (select a word, b other, score from rated union all select b, a, score from rated),
related as (select word, other, score from both_ways qualify row_number() over (partition by word order by score desc, other desc) <= 8)"""

_CLICKS = "clicks as (select json_extract_string(props, '$.k') term, user_id::varchar path, epoch(ts) ts from events where event_type = 'click')"
_DECAY = f"power(0.5, greatest(0, ({NOW} - ts) / 86400.0) / 60)"

_SCANS = f"""{FILES},
stored as (select path, size, mtime from files where id % 10 <> 4),
scanned as (
  select path, case when id % 10 = 5 then size + 1 else size end size, case when id % 10 = 7 then mtime + 1e-7 else mtime end mtime from files where id % 10 <> 3)"""

_FILLER = "'state', 'of', 'county', 'region', 'province', 'district', 'municipality', 'governorate', 'city', 'the', 'and'"
_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1, power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2))))"

ORACLES = {
    "bm25_top": _best([(0, "the", False), (1, "was", False), (2, "eringble", False)], None, 20),
    "bm25_and": _best(_group(0, "that") + _group(1, "from"), 2),
    "bm25_or": _best(_group(0, "src3", "src4") + _group(1, "une"), None),
    "bm25_prefix": _best([(0, "einsch", True), (1, "src1", True)], None),
    "split_words_docs": f"select word, count(*) n, count(distinct doc_id) n_docs from (select doc_id, unnest({words('text')}) word from documents) group by word",
    "ext_kind_label": f"""with {FILES}
select id, ext, kind, case kind when 'pdf' then 'PDF' when 'spreadsheet' then 'Spreadsheet (csv)' when 'image' then 'Image (jpg)' else 'Document (' || ext || ')' end as label,
  case when size < 1024 then size || ' B' when size < 1048576 then printf('%.1f KB', size / 1024.0) else printf('%.1f MB', size / 1048576.0) end size_text,
  strftime(make_timestamp((mtime * 1000000)::bigint), '%Y-%m-%d %H:%M') time_text,
  array_to_string({words("case when folder = '/corpus/src1' or starts_with(folder, '/corpus/src1/') then substr(folder, 13) else folder end")}, ' ') folder_words from files""",
    "filter_kind_size_date": f"""with {FILES} select id, kind, size, coalesce(taken, mtime) dated from files
where kind in ('image', 'pdf') and size between 500 and 5000 and coalesce(taken, mtime) >= 1704139200 and coalesce(taken, mtime) < 1707307200""",
    "filter_folder_segment": f"with {FILES} select id, folder from files where folder like '%/fr' and folder like '%/src3/%'",
    "scope_path_range": f"with {FILES} select id, path from files where starts_with(path, '/corpus/src1/') or starts_with(path, '/corpus/src2/de/')",
    "newest_files": f"with {FILES} select id, coalesce(taken, mtime) dated from files where kind in ('image', 'document') order by 2 desc, 1 limit 50",
    "nearby_files": f"with {FILES} select id, path, mtime from files where folder = (select folder from files where id = 9) and id <> 9 order by mtime desc, id limit 200",
    "existing_folder_words": f"""with {FILES}, names as (select distinct lower(regexp_extract(folder, '[^/]*$')) w from files)
select word, lower(word) in (select w from names) as exists from (values ('DE'), ('fr'), ('src1'), ('downloads')) t(word)""",
    "scan_skips": f"""with {FILES} select id, name from files where id % 7 <> 0
and not (starts_with(path, '/corpus/src2/') or starts_with(path, '/corpus/src3/de/'))""",
    "to_extract": f"""with {FILES} select id, ext from files where id % 3 <> 0 and ext in ('txt', 'md', 'csv')
and (starts_with(path, '/corpus/src1/') or starts_with(path, '/corpus/src5/'))""",
    "root_folders": f"""with {FILES}, p as (select folder path from files union select regexp_replace(folder, '/[a-z]*$', '') from files where id % 10 < 3)
select path from p where not exists (select 1 from p q where starts_with(p.path, q.path || '/'))""",
    "vocab_build": f"""with {FILES},
named as (select unnest(list_concat(list_concat({words('name')}, {words('folder')}), {words('extra')})) word from docs),
inside as (select unnest(list_distinct(regexp_extract_all(lower(content), '\\p{{L}}{{4,20}}'))) w from docs),
texts as (select unnest({words('w')}) word from inside)
select word, max(src) src from (select word, 1 src from named union all select word, 0 from texts)
where not regexp_matches(word, '^[0-9]+$') and length(word) between 2 and 30 group by word""",
    "vocab_trigrams": f"with {_PART_WORDS}, {_GRAMS} select * from grams",
    "trigram_pieces": """select p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p_name) - 1), lambda k: substr(p_name, k::int, 3)))), '|') grams from part""",
    "edit_distances": f"""with recursive {_PART_WORDS}, {_TYPOS}, near as (select term, word from pw, typos where abs(length(word) - length(term)) <= 3), {_osa('near')}
select term, word, least(distance, 4)::int distance from osa""",
    "fuzzy_candidates": f"""with recursive {_PART_WORDS}, {_GRAMS}, {_TYPOS},
asked as (select distinct term, substr(term, k::int, 3) gram from (select term, unnest(range(1, length(term) - 1)) k from typos where length(term) >= 4)),
met as (select distinct term, word from asked join grams using (gram)),
{_osa('met')},
near as (select term, word, distance, src from osa join pw using (word))
select term, word, distance::int distance, src, place::int place from (
  select *, row_number() over (partition by term order by distance, src desc, abs(length(word) - length(term)), word) place
  from near where distance > 0 and distance <= case when length(term) <= 5 then 1 else 2 end) where place <= 4""",
    "related_pairs": f"with {_RELATED} select word, other, round(score, 6) score from related",
    "best_related": f"""with {_RELATED} select word term, other, round(score, 6) score, place::int place from (
  select *, row_number() over (partition by word order by score desc, other) place from related where score >= 0.25) where place <= 3""",
    "click_decay": f"with {_CLICKS} select path, round(sum({_DECAY}), 6) weight from clicks where term::int < 20 group by path",
    "click_memory": f"with {_CLICKS} select term, path, round(sum({_DECAY}), 6) weight from clicks group by term, path",
    "click_rename": f"""with {_CLICKS},
old1 as (select * from clicks where path = '1' and ts <= {NOW} - 864000), old3 as (select * from clicks where path = '3' and ts <= {NOW} - 432000),
log as (
  select * from clicks where path = '1' and ts > {NOW} - 864000 union all select * from clicks where path = '3' and ts > {NOW} - 432000
  union all select * from clicks where path = '2' and not (ts <= {NOW} - 864000 and term in (select term from old1))
  union all select term, '2', ts from old1 union all select term, 'new', ts from old3)
select term, path, round(sum({_DECAY}), 6) weight from log group by term, path""",
    "history_top": f"""with s as (select {words('text')}[1] q, (conv_id * 100 + turn)::double ts from conversations where role = 'user')
select q query, count(*) uses, max(ts) ts from s where starts_with(q, 'th') and q <> 'th' group by q order by 2 desc, 3 desc, 1 limit 4""",
    "parse_requests": f"""select p_partkey, p_size::bigint * 1048576 min_size, case when regexp_matches(p_name, '\\b(small|tiny)\\b') then 102400 end::bigint max_size, epoch(timestamp '2024-01-01') "after", epoch(timestamp '2024-02-01') "before",
  'downloads' folder_words, array_to_string(list_filter(string_split(p_name, ' '), lambda w: not list_contains(['small', 'tiny'], w)), ' ') terms from part""",
    "search_scored": f"""{_bm25(_group(0, 'src3') + _group(1, 'en'), 2)}, {_CLICKS},
w as (select '/corpus/src3/en/src3_en_' || path || '.txt' path, sum({_DECAY}) w from clicks group by 1),
s as (select r.*, f.*, f.folder like '%/en' en, 2 * ln(1 + coalesce(w.w, 0)) boost from ranked r join files f using (id) left join w on w.path = f.path)
select id, path, case kind when 'pdf' then 'PDF' when 'spreadsheet' then 'Spreadsheet (csv)' when 'image' then 'Image (jpg)' else 'Document (' || ext || ')' end as label,
  round(-raw * case when en then 1.0 else 0.9 end + case when en then 4.0 else 0.0 end + boost + 0.5 * exp(-greatest(0, {NOW} - coalesce(taken, mtime)) / 7776000), 6) score,
  'name has "src3"; ' || case when en then 'name has "en"; name starts with your search' else 'text inside the file matches "en"' end
  || case when boost > 0.3 then '; you opened this before after similar searches' else '' end reason from s""",
    "snapshot_diff": f"""with {_SCANS}
select coalesce(a.path, b.path) path, case when a.path is null then 'added' when b.path is null then 'removed'
  when a.size = b.size and abs(a.mtime - b.mtime) < 1e-6 then 'unchanged' else 'changed' end state from stored a full join scanned b on a.path = b.path""",
    "snapshot_apply": f"""with {_SCANS}
select b.path, b.size, b.mtime, case when a.size = b.size and abs(a.mtime - b.mtime) < 1e-6 then a.mtime end content_mtime from scanned b left join stored a using (path)
union all select path, size, mtime, mtime from stored where starts_with(path, '/corpus/src1/') and path not in (select path from scanned)""",
    "delete_subtree": f"with {FILES} select id, path from files where not starts_with(path, '/corpus/src1/') and not starts_with(path, '/corpus/src2/en/')",
    "upsert_latest": """with last as (select user_id::varchar path, arg_max(round(value, 6), event_id) as value, arg_max(event_type, event_id) kind from events group by 1)
select i::varchar path, 0.0::double as value from range(400) t(i) where i::varchar not in (select path from last)
union all select path, value from last where kind <> 'error'""",
    "event_latest": "select user_id::varchar path, case when arg_max(event_type, event_id) = 'error' then 'deleted' else 'changed' end kind, max(event_id) seq from events group by user_id",
    "stream_clicks": f"""with t as (select conv_id::varchar path, unnest(list_distinct({words('text')})) term from conversations where role = 'user')
select path, count(*) n, min(term) "first" from t group by path""",
    "event_windows": "select epoch(date_trunc('day', ts))::bigint as start, event_type, count(*) n, round(sum(value), 4) total from events group by all",
    "nearest_place": f"""with places(plat, plon, city, state, code) as (values {_values(PLACES)}), countries(code, country) as (values {_values(COUNTRIES)}),
off(k, p, dy, dx) as (select row_number() over (order by p, a, b) - 1, p, dy, dx from (select * from range(6) t(p), (values (0, -0.3), (1, 0.0), (2, 0.2)) y(a, dy), (values (0, -0.9), (1, 0.0), (2, 0.4)) x(b, dx)) where [13.405, 2.3522, 36.8172, 18.96, 13.06, 179.99][p + 1] + dx <= 180),
numbered as (select *, row_number() over () - 1 p from places),
photos as (
  select event_id id, event_id % 1800 / 10.0 - 90 lat, event_id * 7 % 3600 / 10.0 - 180 lon from events
  union all select -1 - k, plat + dy, plon + dx from off join numbered using (p)),
met as (select id, city, state, code, {_HAVERSINE} km, plat, plon from photos, places),
best as (select * from met where km <= 50 qualify row_number() over (partition by id order by km, plat desc, plon desc, city desc) = 1)
select id, city, coalesce(country, '') country, round(km, 4) km,
  array_to_string(list_sort(list_distinct(list_filter({words("replace(city, 'ø', 'o') || ' ' || state || ' ' || coalesce(country, '')")}, lambda w: not list_contains([{_FILLER}], w)))), ' ') words
from best left join countries using (code)""",
    "photo_words": f"with {FILES} select id, 'berlin ' || extra words from docs where extra <> ''",
    "html_clean": r"""with t as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') x from pages),
u as (select page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') x from t)
select page_id, trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g')) as text from u""",
    "mounts_skip": f"""with m(line) as (values {_values(MOUNTS)}),
p as (select replace(string_split(line, ' ')[5], '\\040', ' ') mount_point, string_split(string_split(line, ' - ')[2], ' ')[1] kind from m where line like '% - %')
select mount_point from p where mount_point <> '/' and kind in ('proc', 'sysfs', 'devtmpfs', 'tmpfs', 'squashfs', 'nfs4', 'fuse.sshfs')""",
    "mime_app_rank": f"""with e(id, name, rank, mime) as (values {_values([(a, n, r, m) for a, n, ms, r in APPS for m in ms])}),
won as (select * from e where rank = (select min(rank) from e x where x.id = e.id))
select id, name, min(case mime when 'text/markdown' then 0 else 1 end)::int as position from won where mime in ('text/markdown', 'text/plain') group by id, name""",
}
ORACLES["suggest_completions"] = f"with v as ({ORACLES['vocab_build']}) select word from v where starts_with(word, 'ein') order by length(word), word limit 5"


_KIND_OF = [(w, kind) for kind, names in KIND_WORDS.items() for w in names.split()]
_UNIT = "case left({x}, 1) when 'k' then 1024 when 'm' then 1048576 when 'g' then 1073741824 end"
#: (pattern, after, before) at NOW, 2024-02-01, a Thursday.
_DATES = (
    (r"\btoday\b", "2024-02-01", "2024-02-02"), (r"\byesterday\b", "2024-01-31", "2024-02-01"), (r"\bthis week\b", "2024-01-29", None), (r"\blast week\b", "2024-01-22", "2024-01-29"),
    (r"\bthis month\b", "2024-02-01", None), (r"\blast month\b", "2024-01-01", "2024-02-01"), (r"\bthis year\b", "2024-01-01", None), (r"\blast year\b", "2023-01-01", "2024-01-01"),
    (r"\brecent(?:ly)?\b", "2024-01-18", None),
)


def _when(value) -> str:
    return " ".join(f"when regexp_matches(s, '{p}') then {value(p, a, b)}" for p, a, b in _DATES)


def _size(s: str, pattern: str) -> str:
    return f"floor(try_cast(nullif(regexp_extract({s}, '{pattern}', 1), '') as double) * {_UNIT.format(x=f"regexp_extract({s}, '{pattern}', 2)")})::bigint"


_SECONDS = lambda d: "null" if d is None else f"epoch(timestamp '{d}')"

ORACLES["parse_conversations"] = f"""with t(id, x) as (
  select conv_id * 1000 + turn, text from conversations where role = 'user' union all select * from (values {_values([(-1 - k, t) for k, t in enumerate(REQUESTS)])})),
a as (select id, ' ' || lower(replace(strip_accents(coalesce(x, '')), 'ß', 'ss')) || ' ' s from t),
b as (select id, {_size('s', OVER)} lo, regexp_replace(s, '{OVER}', ' ') s from a),
c as (select id, lo, {_size('s', UNDER)} hi, regexp_replace(s, '{UNDER}', ' ') s from b),
d as (select id, hi, coalesce(lo, case when regexp_matches(s, '{BIG}') then {LARGE} end) lo, case when lo is null then regexp_replace(s, '{BIG}', ' ') else s end s from c),
e as (select id, lo, coalesce(hi, case when regexp_matches(s, '{LITTLE}') then {SMALL} end) hi, case when hi is null then regexp_replace(s, '{LITTLE}', ' ') else s end s from d),
f as (select id, lo, hi,
  case when regexp_matches(s, '{PAST}') then {NOW} - 86400 * regexp_extract(s, '{PAST}', 1)::double * case regexp_extract(s, '{PAST}', 2) when 'day' then 1 when 'week' then 7 when 'month' then 30 else 365 end
    {_when(lambda p, a, b: _SECONDS(a))} end "after",
  case when regexp_matches(s, '{PAST}') then null {_when(lambda p, a, b: _SECONDS(b))} end "before",
  case when regexp_matches(s, '{PAST}') then regexp_replace(s, '{PAST}', ' ') {_when(lambda p, a, b: f"regexp_replace(s, '{p}', ' ')")} else s end s from e),
g as (select * exclude (s), regexp_extract_all(s, '{IN_FOLDER}', 1) folders, regexp_replace(s, '{IN_FOLDER}', ' ', 'g') s from f),
h as (select *, {words(r"regexp_replace(s, '\bdownloaded\b', ' ')")} w from g),
kinds(word, kind) as (values {_values(_KIND_OF)}), stops(word) as (values {_values(sorted(STOP_WORDS))}),
u as (select id, unnest(w) word, generate_subscripts(w, 1) k from h),
firsts as (select id, word, min(k) k from u group by id, word),
terms as (select id, string_agg(word, ' ' order by k) terms from firsts where word not in (select word from kinds) and word not in (select word from stops) group by id),
of_kind as (select id, kind, min(k) k from firsts join kinds using (word) group by id, kind),
named as (select id, string_agg(kind, ' ' order by k) kinds from of_kind group by id)
select id, lo::bigint min_size, hi::bigint max_size, "after"::double "after", "before"::double "before",
  array_to_string(case when regexp_matches(s, '\\bdownloaded\\b') then list_append(folders, 'downloads') else folders end, ' ') folder_words,
  coalesce(kinds, '') kinds, coalesce(terms, '') terms from h left join terms using (id) left join named using (id)"""
ORACLES["event_subtrees"] = """with e as (
  select event_id seq, event_type = 'error' gone, '/f' || (user_id % 20) || case when event_type = 'error' then '' else '/g/u' || user_id end path from events),
last as (select path, max(seq) seq, arg_max(gone, seq) gone from e group by path),
cut as (select path, max(seq) cut_at from e where gone group by path)
select l.path, case when l.gone or coalesce(c.cut_at, -1) > l.seq then 'deleted' else 'changed' end kind, case when not l.gone and c.cut_at > l.seq then c.cut_at else l.seq end seq
from last l left join cut c on not l.gone and starts_with(l.path, c.path || '/')"""
ORACLES["event_distinct"] = "select conv_id::varchar path, count(*) n, sum(turn)::double total from (select distinct conv_id, turn, text from conversations where role = 'user') group by 1"
ORACLES["sorted_names"] = f"with {FILES} select id, name from files order by lower(name) desc, id limit 50"
ORACLES["runnable_kinds"] = f"""select ext, ext in ({", ".join(f"'{e}'" for e in RUNNABLE_EXTENSIONS)}) runs,
  ext in ({", ".join(f"'{e}'" for e in TEXT_EXTENSIONS + ZIP_EXTENSIONS + RTF_EXTENSIONS + PHOTO_EXTENSIONS)}) wanted
from (values {_values([e for names in KIND_EXTENSIONS.values() for e in names.split()] + ["desktop", "appimage", "deb", "", "exe"])}) t(ext)"""
ORACLES["app_names"] = f"""with e(id, name, rank) as (values {_values([(a, n, r) for a, n, _, r in APPS])})
select id, name from e where rank = (select min(rank) from e x where x.id = e.id) and contains(lower(name), 'edit')"""
ORACLES["suggestions"] = f"""with h as ({ORACLES["history_top"]}), v as ({ORACLES["vocab_build"]}),
c as (select word from v where starts_with(word, 'th') order by length(word), word limit 5),
s as (select query x, row_number() over (order by uses desc, ts desc, query) k from h union all select word, 100 + row_number() over (order by length(word), word) from c where word <> 'th'),
d as (select x, min(k) k from s where x <> 'th' group by x)
select (row_number() over (order by k) - 1)::int place, x as text from d order by k limit 8"""
ORACLES["exif_photos"] = """select * from (values (1, epoch(timestamp '2024-07-13 14:22:05'), 52.5::double, (13 + 24 / 60.0)::double), (2, epoch(timestamp '2023-12-24 10:00:00'), -1.25::double, -36.75::double),
  (3, null, null, null), (4, null, null, null)) t(id, taken, lat, lon)"""
ORACLES["file_texts"] = "select * from (values (1, 'kubernetes migration & roadmap'), (2, 'Hello bold w rld'), (3, 'plain text'), (4, ''), (5, ''), (6, ''), (7, '')) t(id, text)"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
