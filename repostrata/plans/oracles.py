"""ANSI SQL for the registered queries, over the same test tables.

Written from the definitions (windows, recursion, joins), not from the Spark plans.
"""

from repostrata.functions.distributions import (
    ACKLAM_BREAK, ACKLAM_MIDDLE, ACKLAM_TAIL, ROYSTON_LARGEST, ROYSTON_SECOND,
)
from repostrata.operators.stats import MOST_VALUES

COMMITS = """
commits as (
  select n_name as repo, o_orderkey as commit_hash, o_orderkey as seq, c_name as author_name,
    c_custkey as author_id, o_orderdate as committer_date,
    case when o_orderkey % 7 = 0 then null else (o_orderkey % 5) / cast(4 as double) end as dmm_unit_size,
    case when o_orderkey % 11 = 0 then null else (o_orderkey % 3) / cast(2 as double) end as dmm_unit_complexity,
    case when o_orderkey % 13 = 0 then null else (o_orderkey % 9) / cast(8 as double) end as dmm_unit_interfacing
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

CHANGES = COMMITS + """,
changes as (
  select c.repo, c.commit_hash, c.author_id, c.committer_date, l_partkey % 40 as path,
    cast(l_quantity as bigint) as added, cast(l_linenumber as bigint) as deleted
  from lineitem join commits c on l_orderkey = c.commit_hash)"""

STARS = """
stars as (select event_type as repo, date_trunc('hour', ts) as d, user_id as u from events)"""

LINT = """
messages as (
  select cast(l_suppkey % 10 as varchar) as repo, l_orderkey as commit_hash,
    cast(date '2020-01-01' + cast(l_orderkey % 365 as int) as timestamp) as d,
    'm' || (l_partkey % 50) as module,
    case l_returnflag when 'A' then 'convention' when 'N' then 'warning' else 'refactor' end as category,
    'R' || l_linenumber as msg_id, l_linenumber as line,
    case when l_linenumber = 1 then 'too-complex' else 'sym' || l_linenumber end as symbol,
    cast(l_quantity as int) as rating
  from lineitem)"""

SOURCES = """
sources as (
  select p_brand as repo, p_partkey % 20 as commit_hash,
    cast(date '2020-01-01' + cast(p_partkey % 20 as int) as timestamp) as d,
    (case p_partkey % 5 when 0 then 'src/a' when 1 then 'VENV/b' when 2 then 'src/.hid/c'
      when 3 then 'lib2/d' else 'src/venv/e' end) || p_partkey
      || (case when p_partkey % 6 = 0 then '.txt' else '.py' end) as path,
    p_partkey % 5 as place, p_partkey % 6 as suffix, p_partkey % 4 as kind
  from part),
kept as (select * from sources where suffix <> 0 and place not in (1, 2)),
counted as (
  select *, case kind when 0 then 5 when 2 then 3 else 0 end as test,
    case kind when 1 then 4 when 2 then 1 else 0 end as prod
  from kept)"""

META = """
meta as (
  select *, s_suppkey % 7 as total, s_suppkey % 3 as bytes from supplier)"""

LANGUAGES = """
languages as (
  select s_name as repo, l_returnflag || l_linestatus as language, cast(sum(l_quantity) as bigint) as size
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)"""

RENAMES = """
edges as (
  select cast(floor(p_partkey / 16) as bigint) as repo, p_partkey % 8 as old_path,
    (p_partkey + 1) % 8 as new_path, p_partkey as seq
  from part),
following as (
  select e.*, (select min(f.seq) from edges f where f.repo = e.repo and f.old_path = e.new_path and f.seq > e.seq) as next
  from edges e),
walk as (
  select repo, old_path, seq, new_path as final_path, next from following
  union all
  select w.repo, w.old_path, w.seq, f.new_path, f.next
  from walk w join following f on f.repo = w.repo and f.seq = w.next),
finals as (select repo, old_path, seq, final_path from walk where next is null)"""

METRICS = "(select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as \"column\", unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem)"


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",".join(ctes) + "\n"


def _latest(source: str) -> str:
    return f"""select repo, strftime(cast(day as timestamp), '%Y-%m-%d %H:%M:%S') as day, batch, value from (
  select user_id as repo, cast(ts as date) as day, event_id as batch, value,
    row_number() over (partition by user_id, cast(ts as date) order by event_id desc) as place
  from {source}) where place = 1"""


def _text(column: str, name: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {name}"


_URL = "regexp_replace(trim(url), '/$', '')"
_KB = "cast(floor(o_totalprice * 10) as bigint)"


def _size_text(kb: str) -> str:
    return (
        f"case when {kb} < 1024 then {kb} || ' KB'"
        f" when {kb} < 1048576 then printf('%.2f MB', {kb} / cast(1024 as double))"
        f" else printf('%.2f GB', {kb} / cast(1048576 as double)) end"
    )


_TOTALS = """
totals as (
  select c.repo, c.total_commits, coalesce(f.files_modified, 0) as files_modified,
    coalesce(f.lines_added, 0) as lines_added, coalesce(f.lines_deleted, 0) as lines_deleted
  from (select repo, count(*) as total_commits from commits group by repo) c
  left join (select repo, count(*) as files_modified, cast(sum(added) as bigint) as lines_added,
      cast(sum(deleted) as bigint) as lines_deleted from changes group by repo) f on f.repo = c.repo)"""

_AVERAGES = """lines_added / cast(total_commits as double) as average_lines_added_per_commit,
  lines_deleted / cast(total_commits as double) as average_lines_deleted_per_commit,
  files_modified / cast(total_commits as double) as average_files_modified_per_commit"""

_FIRST_SEEN = """
seen as (select repo, author_name, min(seq) as first_seq from commits group by 1, 2)"""

_LISTS = """
lists as (select repo, count(*) as developer_count from seen group by repo)"""

_DMM = """
dmm as (
  select repo, avg(nullif(dmm_unit_size, 0)) as average_dmm_method_lines_of_code,
    avg(nullif(dmm_unit_complexity, 0)) as average_dmm_method_cyclomatic_complexity,
    avg(nullif(dmm_unit_interfacing, 0)) as average_dmm_method_number_of_parameters
  from commits group by repo)"""


def _ownership(source: str, minor: float = 0.05) -> str:
    return f"""
authored as (select repo, path, author_id, sum(added + deleted) as n from {source} group by 1, 2, 3),
shares as (select *, n / sum(n) over (partition by repo, path) as share from authored),
owned as (
  select repo, path, max(share) * 100 as experience, count(*) as contributors,
    count(*) filter (where share < {minor}) as minor_contributors
  from shares group by 1, 2)"""


def _entropy(source: str) -> str:
    return f"""
spread as (
  select *, (added + deleted) / sum(added + deleted) over (partition by repo, commit_hash) as p from {source}),
entropies as (
  select repo, commit_hash, count(*) as files, cast(sum(added) as bigint) as added,
    cast(sum(deleted) as bigint) as deleted, sum(case when p > 0 then -p * log2(p) else 0 end) as entropy
  from spread group by 1, 2),
complexities as (
  select s.repo, s.path, sum(p * entropy) as complexity
  from spread s join entropies e on e.repo = s.repo and e.commit_hash = s.commit_hash group by 1, 2)"""


def _git(window: str, churn: str, extra: str) -> str:
    """The git table from per-file and per-commit definitions over one window."""
    return (
        _with(
            CHANGES,
            f"\nwin as (select * from changes where {window})",
            f"\nwin_commits as (select * from commits where {window})",
            _TOTALS, _FIRST_SEEN, _LISTS, _DMM, _ownership("win"), _entropy("win"),
            f"""
files as (
  select repo, path, sum(added) as added, sum(deleted) as removed, avg(added) as avg_added,
    sum({churn}) as churn_total, max({churn}) as churn_max, avg({churn}) as churn_avg
  from win group by 1, 2)""",
            """
file_means as (
  select f.repo, avg(f.added) as average_lines_added_to_files, avg(f.removed) as average_lines_deleted_from_files,
    avg(f.avg_added) as average_avg_lines_added_to_files, avg(o.experience) as average_contributor_experience,
    avg(o.contributors) as average_contributors, avg(o.minor_contributors) as average_minor_contributors,
    avg(f.churn_total) as average_code_churn_total, avg(f.churn_max) as average_code_churn_max,
    avg(f.churn_avg) as average_code_churn_avg, avg(c.complexity) as average_history_complexity
  from files f join owned o on o.repo = f.repo and o.path = f.path
  join complexities c on c.repo = f.repo and c.path = f.path group by f.repo)""",
            """
sets as (
  select c.repo, max(n) as change_set_max, avg(n) as change_set_avg
  from (select c.repo, c.commit_hash, count(w.path) as n from win_commits c
        left join win w on w.repo = c.repo and w.commit_hash = c.commit_hash group by 1, 2) c
  group by c.repo)""",
        )
        + f"""select t.repo, round(average_avg_lines_added_to_files, 9) as average_avg_lines_added_to_files,
  round(average_code_churn_avg, 9) as average_code_churn_avg, round(average_code_churn_max, 9) as average_code_churn_max,
  round(average_code_churn_total, 9) as average_code_churn_total,
  round(average_contributor_experience, 9) as average_contributor_experience,
  round(average_contributors, 9) as average_contributors,
  round(average_dmm_method_cyclomatic_complexity, 9) as average_dmm_method_cyclomatic_complexity,
  round(average_dmm_method_lines_of_code, 9) as average_dmm_method_lines_of_code,
  round(average_dmm_method_number_of_parameters, 9) as average_dmm_method_number_of_parameters,
  round(files_modified / cast(total_commits as double), 9) as average_files_modified_per_commit,
  round(average_history_complexity, 9) as average_history_complexity,
  round(lines_added / cast(total_commits as double), 9) as average_lines_added_per_commit,
  round(average_lines_added_to_files, 9) as average_lines_added_to_files,
  round(average_lines_deleted_from_files, 9) as average_lines_deleted_from_files,
  round(lines_deleted / cast(total_commits as double), 9) as average_lines_deleted_per_commit,
  round(average_minor_contributors, 9) as average_minor_contributors,
  round(change_set_avg, 9) as change_set_avg, change_set_max, developer_count,
  files_modified, lines_added, lines_deleted, total_commits{extra}
from totals t join lists using (repo) join dmm using (repo) join file_means using (repo) join sets using (repo)"""
    )


def _ranked(x: str, y: str) -> str:
    """Both columns as average ranks."""
    return f"""(
  select rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / cast(2 as double) as rx,
    rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / cast(2 as double) as ry
  from lineitem where {x} is not null and {y} is not null)"""


# Hunks of a generated patch: two when the part key is even, else one.
_HUNKS = "case when l_partkey % 2 = 0 then 2 else 1 end"

_GIT_EXTRA = f""",
  round((select avg(h) from (select quantile_cont({_HUNKS}, 0.5) as h from lineitem join commits on l_orderkey = commit_hash
    where repo = t.repo group by l_partkey % 40)), 9) as average_hunks,
  'https://git.example/acme/' || t.repo || '.git' as repo_url"""

_CHURN_ACROSS_RENAMES = (
    _with(RENAMES, """
moved as (
  select cast(floor(l_partkey / 16) as bigint) as repo, l_partkey % 8 as path,
    cast(floor(l_partkey / 16) * 16 + l_linenumber * 2 as bigint) as seq,
    cast(l_quantity as bigint) - l_linenumber as churn
  from lineitem),
upcoming as (
  select m.repo, m.path, m.seq, min(e.seq) as next from (select distinct repo, path, seq from moved) m
  left join edges e on e.repo = m.repo and e.old_path = m.path and e.seq > m.seq group by 1, 2, 3)""", recursive=True)
    + """select m.repo, coalesce(f.final_path, m.path) as path, cast(sum(churn) as bigint) as churn_total,
  max(churn) as churn_max, avg(churn) as churn_avg
from moved m join upcoming u on u.repo = m.repo and u.path = m.path and u.seq = m.seq
left join finals f on f.repo = u.repo and f.seq = u.next group by 1, 2"""
)


def _horner(coefficients: tuple, x: str) -> str:
    total = repr(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r})"
    return total


def _score(position: str) -> str:
    """Normal score of a 1-based position among ``n`` by the published approximation."""
    p = f"(({position} - 0.375) / (n + 0.25))"
    q, tail = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{_horner(ACKLAM_TAIL[0], tail)} / {_horner(ACKLAM_TAIL[1], tail)}"
    middle = f"{q} * {_horner(ACKLAM_MIDDLE[0], f'({q} * {q})')} / {_horner(ACKLAM_MIDDLE[1], f'({q} * {q})')}"
    return f"case when {p} < {ACKLAM_BREAK} then {outer} when {p} > 1 - {ACKLAM_BREAK} then -({outer}) else {middle} end"


def _power_sum(coefficients: tuple) -> str:
    return " + ".join(f"{c!r} / power(n, {k / 2})" for k, c in enumerate(coefficients))


# The Shapiro-Wilk statistic from all values in order, for more than five of them.
_TWO_METRICS = METRICS.replace(", 'l_discount', 'l_tax'", "").replace(", l_discount, l_tax", "")
_NORMALITY = f"""with metrics as {_TWO_METRICS},
placed as (select "column", value, row_number() over (partition by "column" order by value) as i,
  count(*) over (partition by "column") as n from metrics),
scored as (select *, {_score("i")} as m from placed),
sums as (select "column", n, sum(m * m) as mm, sum(m * value) as mv, var_pop(value) * n as spread,
  max(m) as top, max(m) filter (where i = n - 1) as second,
  max(value) - min(value) as gap1,
  max(value) filter (where i = n - 1) - max(value) filter (where i = 2) as gap2
  from scored group by 1, 2),
weights as (select *, top / sqrt(mm) + {_power_sum(ROYSTON_LARGEST)} as a1,
  second / sqrt(mm) + {_power_sum(ROYSTON_SECOND)} as a2 from sums)
select "column", n, round(power(a1 * gap1 + a2 * gap2 + (mv - top * gap1 - second * gap2)
  / sqrt((mm - 2 * top * top - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / spread, 6) as statistic
from weights"""

_CORRELATION_REPORT = """with ranked as (
  select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 as x,
    rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2 as y from orders),
found as (select count(*) as n, corr(x, y) as r from ranked)
select 'Spearman' as method, n, round(r, 6) as coefficient,
  case when abs(r) > 0.7 then 'strong' when abs(r) > 0.3 then 'moderate' when abs(r) > 0.1 then 'weak' else 'no' end as strength,
  case when r > 0 then 'positive' when r < 0 then 'negative' else 'none' end as direction
from found"""

_DESCRIBE_APPROXIMATELY = f"""select "column", count(*) as count, true as p25_close, true as p50_close, true as p75_close
from {METRICS} group by 1"""


ORACLES = {
    "url_keys": f"""select page_id, {_URL} as clean, list_last(string_split(rtrim({_URL}, '/'), '/')) as name,
  list_last(string_split(rtrim({_URL}, '/'), '/')) || 'hub' as legacy_name,
  list_extract(string_split(rtrim({_URL}, '/'), '/'), -2) as owner,
  '/srv/repos/' || list_last(string_split(rtrim({_URL}, '/'), '/')) as repo_path, {_URL} as relative
from pages""",
    "url_list": "select url as repo_url from pages",
    "size_format": f"""select o_orderkey, {_KB} as kb, {_KB} / cast(1024 as double) as mb,
  {_size_text(_KB)} as text, {_size_text('o_custkey')} as small_text from orders""",
    "path_filters": _with(SOURCES) + """select path, cast(suffix <> 0 as bigint) as is_python,
  cast(place = 1 as bigint) as denied_root, cast(place in (1, 4) as bigint) as denied_any,
  cast(place = 2 as bigint) as prefixed, cast(place = 2 as bigint) as lint_ignored from sources""",
    "python_sources": _with(SOURCES) + "select repo, count(*) as files from kept group by repo",
    "commit_files": _with(CHANGES) + """select c.repo, count(*) as rows,
  count(*) filter (where f.path is null) as commits_without_files
from commits c left join changes f on f.repo = c.repo and f.commit_hash = c.commit_hash group by c.repo""",
    "repo_totals": _with(CHANGES, _TOTALS) + f"select *, {_AVERAGES} from totals",
    "developers": _with(COMMITS, _FIRST_SEEN) + """select repo, author_name,
  row_number() over (partition by repo order by first_seq, author_name) as position from seen""",
    "developer_lists": _with(COMMITS, _FIRST_SEEN) + """select repo, place // 7 as part,
  string_agg(author_name, '|' order by place) as developers
from (select *, row_number() over (partition by repo order by first_seq, author_name) - 1 as place from seen)
group by 1, 2""",
    "dmm_means": _with(COMMITS, _DMM) + "select * from dmm",
    "dmm_means_with_zero": _with(COMMITS) + """select repo, avg(dmm_unit_size) as average_dmm_method_lines_of_code,
  avg(dmm_unit_complexity) as average_dmm_method_cyclomatic_complexity,
  avg(dmm_unit_interfacing) as average_dmm_method_number_of_parameters from commits group by repo""",
    "file_lines": _with(CHANGES) + """select repo, path, cast(sum(added) as bigint) as added,
  cast(sum(deleted) as bigint) as removed, avg(added) as avg_added from changes group by 1, 2""",
    "file_churn": _with(CHANGES) + """select repo, path, cast(sum(added - deleted) as bigint) as churn_total,
  max(added - deleted) as churn_max, avg(added - deleted) as churn_avg from changes group by 1, 2""",
    "file_churn_sum": _with(CHANGES) + """select repo, path, cast(sum(added + deleted) as bigint) as churn_total,
  max(added + deleted) as churn_max, avg(added + deleted) as churn_avg from changes group by 1, 2""",
    "change_set": _with(CHANGES) + """select repo, max(n) as change_set_max, avg(n) as change_set_avg from (
  select c.repo, c.commit_hash, count(f.path) as n from commits c
  left join changes f on f.repo = c.repo and f.commit_hash = c.commit_hash group by 1, 2) group by repo""",
    "ownership_per_file": _with(CHANGES, _ownership("changes")) + "select * from owned",
    "ownership_means": _with(CHANGES, _ownership("changes", 0.01)) + """select repo,
  round(avg(experience), 9) as average_contributor_experience, round(avg(contributors), 9) as average_contributors,
  round(avg(minor_contributors), 9) as average_minor_contributors from owned group by repo""",
    "patch_stats": f"""select l_orderkey as commit_hash, l_partkey as path, l_linenumber as line_no,
  cast(l_quantity as bigint) as added, cast(l_linenumber as bigint) as deleted, cast({_HUNKS} as bigint) as hunks
from lineitem""",
    "hunks_from_patch": f"""select cast(l_suppkey % 10 as varchar) as repo, l_partkey as path,
  quantile_cont({_HUNKS}, 0.5) as hunks from lineitem group by 1, 2""",
    "hunk_means": f"""select repo, round(avg(hunks), 9) as average_hunks from (
  select cast(l_suppkey % 10 as varchar) as repo, l_partkey as path, quantile_cont({_HUNKS}, 0.5) as hunks
  from lineitem group by 1, 2) group by repo""",
    "commit_entropy": _with(CHANGES, _entropy("changes")) + """select repo, commit_hash, files, added, deleted,
  round(entropy, 9) as entropy from entropies""",
    "history_complexity": _with(CHANGES, _entropy("changes")) + """select repo, path,
  round(complexity, 9) as complexity from complexities""",
    "rename_identity": _with(RENAMES, recursive=True) + "select * from finals",
    "churn_across_renames": _CHURN_ACROSS_RENAMES,
    "churn_with_tied_renames": _CHURN_ACROSS_RENAMES,
    "git_table": _git("true", "added - deleted", _GIT_EXTRA),
    "git_table_window": _git(
        "committer_date between timestamp '1996-01-01' and timestamp '2000-06-30'", "added + deleted", ""
    ),
    "lint_rollup": _with(LINT) + """select repo, commit_hash, module, category, msg_id,
  cast(grouping(module, category, msg_id) as bigint) as level, count(*) as messages
from messages group by grouping sets ((repo, commit_hash, module, category, msg_id),
  (repo, commit_hash, module, category), (repo, commit_hash, module), (repo, commit_hash))""",
    "mccabe": _with(LINT) + """select repo, commit_hash,
  coalesce(avg(case when line = 1 then rating end), 0) as avg_mccabe_complexity from messages group by 1, 2""",
    "lint_long": _with(LINT) + """select repo, key, cast(count(*) as double) as value from (
  select repo, msg_id || '.' || symbol as key from messages where line <> 7
  union all select repo, category from messages
  union all select repo, 'statement' from messages
  union all select repo, 'node_count.function' from messages) group by 1, 2""",
    "lint_unknown_symbols": _with(LINT) + "select distinct symbol from messages where line = 7",
    "lint_wide": _with(LINT) + f"""select repo, {_text('d', 'date')}, commit_hash, cast(null as double) as info,
  cast(nullif(count(*) filter (where category = 'refactor'), 0) as double) as refactor,
  cast(nullif(count(*) filter (where category = 'convention'), 0) as double) as convention,
  cast(nullif(count(*) filter (where category = 'warning'), 0) as double) as warning,
  cast(null as double) as error, cast(null as double) as fatal, cast(null as double) as global_note,
  coalesce(avg(case when line = 1 then rating end), 0) as avg_mccabe_complexity,
  cast(null as double) as percent_duplicated_lines, cast(null as double) as nb_duplicated_lines,
  cast(count(*) as double) as statement, cast(count(*) as double) as node_count_function,
  cast(nullif(count(*) filter (where line = 1), 0) as double) as R1_too_complex,
  cast(nullif(count(*) filter (where line = 2), 0) as double) as R2_sym2,
  cast(nullif(count(*) filter (where line = 3), 0) as double) as R3_sym3,
  cast(nullif(count(*) filter (where line = 4), 0) as double) as R4_sym4,
  cast(nullif(count(*) filter (where line = 5), 0) as double) as R5_sym5,
  cast(nullif(count(*) filter (where line = 6), 0) as double) as R6_sym6
from messages group by repo, d, commit_hash""",
    "test_statements": _with(SOURCES) + """select repo, commit_hash, path, cast(kind <> 3 as bigint) as parsed,
  case kind when 0 then 'unittest' when 2 then 'pytest' else '' end as imports,
  case kind when 0 then 'T' else '' end as unittest_classes,
  case kind when 0 then 'test_a' when 2 then 'test_b' else '' end as pytest_functions,
  cast(prod as bigint) as production_statements, cast(test as bigint) as test_statements from counted""",
    "test_ratio": _with(SOURCES) + """select repo, commit_hash, cast(sum(test) as bigint) as test_statements,
  cast(sum(prod) as bigint) as production_statements,
  coalesce(sum(test) / nullif(cast(sum(test) + sum(prod) as double), 0), 0) as test_to_code_ratio
from counted group by 1, 2""",
    "test_table": _with(SOURCES) + f"""select repo, commit_hash, {_text('d', 'date')},
  cast(sum(case when kind = 0 then 1 else 0 end) as bigint) as test_classes,
  coalesce(string_agg(distinct case kind when 0 then 'unittest' when 2 then 'pytest' end, ','
    order by case kind when 0 then 'unittest' when 2 then 'pytest' end), '') as test_frameworks,
  cast(sum(case when kind in (0, 2) then 1 else 0 end) as bigint) as test_functions,
  coalesce(sum(test) / nullif(cast(sum(test) + sum(prod) as double), 0), 0) as test_to_code_ratio
from counted group by repo, commit_hash, d""",
    "star_numbers": _with(STARS) + f"""select repo, {_text('d', 'starred_at')}, u as user_login,
  row_number() over (partition by repo order by d, u) as star_number from stars""",
    "star_documents": _with(STARS) + f"""select distinct repo, {_text('d', 'starred_at')}, u as user_login from stars""",
    "stars_long": _with(STARS) + f"""select repo, {_text('d', 'date')},
  cast(sum(n) over (partition by repo order by d) as bigint) as stargazers_count
from (select repo, d, count(*) as n from stars group by 1, 2)""",
    "stars_grid": _with(STARS) + f"""select r.repo, {_text('d.d', 'date')},
  cast(sum(coalesce(n, 0)) over (partition by r.repo order by d.d) as bigint) as stargazers_count
from (select distinct d from stars) d cross join (select distinct repo from stars) r
left join (select repo, d, count(*) as n from stars group by 1, 2) c on c.repo = r.repo and c.d = d.d""",
    "stars_wide": _with(STARS) + f"""select {_text('d', 'date')},
  cast(sum(click) over (order by d) as bigint) as click, cast(sum(error) over (order by d) as bigint) as error,
  cast(sum(purchase) over (order by d) as bigint) as purchase, cast(sum(signup) over (order by d) as bigint) as signup,
  cast(sum("view") over (order by d) as bigint) as "view"
from (select d, count(*) filter (where repo = 'click') as click, count(*) filter (where repo = 'error') as error,
  count(*) filter (where repo = 'purchase') as purchase, count(*) filter (where repo = 'signup') as signup,
  count(*) filter (where repo = 'view') as "view" from stars group by d)""",
    "metadata_table": _with(META) + """select s_name as repo,
  case when s_suppkey % 5 <> 0 then '2020-01-01 00:00:00' end as "createdAt",
  case when s_suppkey % 4 <> 0 then s_name end as description,
  s_suppkey * 10 / cast(1024 as double) as "diskUsage", s_suppkey % 17 as "stargazerCount",
  cast(null as bigint) as "forkCount",
  case when total > 0 then '[{"name":"Python","percent":' || round_even(bytes / cast(total as double) * 100, 1) || '}]'
    else '[]' end as languages,
  case when s_suppkey % 3 <> 0 then 'MIT' end as license_name, '/acme/' || s_name as "resourcePath" from meta""",
    "metadata_flat": _with(META) + """select s_name as repo, key, value from (
  select s_name, 'createdAt' as key, case when s_suppkey % 5 = 0 then '"bad"' else '"2020-01-01T00:00:00Z"' end as value from meta
  union all select s_name, 'diskUsage', cast(s_suppkey * 10 as varchar) from meta
  union all select s_name, 'description', case when s_suppkey % 4 = 0 then '""' else '"' || s_name || '"' end from meta
  union all select s_name, 'licenseInfo', 'null' from meta where s_suppkey % 3 = 0
  union all select s_name, 'licenseInfo.name', '"MIT"' from meta where s_suppkey % 3 <> 0
  union all select s_name, 'languages.totalSize', cast(total as varchar) from meta
  union all select s_name, 'languages.edges', '[{"node":{"name":"Python"},"size":' || bytes || '}]' from meta
  union all select s_name, 'resourcePath', '"/acme/' || s_name || '"' from meta
  union all select s_name, 'stargazerCount', cast(s_suppkey % 17 as varchar) from meta)""",
    "language_shares": _with(LANGUAGES) + """select repo, place, language, size,
  round_even(size / cast(total as double) * 100, 1) as percent from (
  select *, row_number() over (partition by repo order by size desc, language) as place,
    sum(size) over (partition by repo) as total from languages) where place <= 3""",
    "upsert_last": _latest("events"),
    "upsert_merge": _latest("events"),
    "upsert_table": _latest("events"),
    "stream_upsert": _latest("events"),
    "new_repositories": """select distinct o_orderkey as repo from orders
where not exists (select 1 from customer where c_custkey = o_orderkey)""",
    "csv_round_trip": _with(CHANGES) + r"""select repo, path, cast(sum(added) as bigint) as added,
  cast(sum(deleted) as bigint) as removed, avg(added) as avg_added, nullif(path, 0) as none,
  repo || ':' || chr(10) || '"line, two"\' || path as note, '["' || repo || '","a \"b\", ' || path || '"]' as list
from changes group by 1, 2""",
    "json_round_trip": "select s_name as repo, s_suppkey * 10 as disk_usage from supplier",
    "keyed_json": "select s_name as repo, s_suppkey * 10 as disk_usage, '/acme/' || s_name as path from supplier",
    "raw_store": _with(LINT) + """select repo as repository_name, commit_hash as hash,
  count(*) as messages from messages group by 1, 2""",
    "raw_lint_totals": _with(LINT) + """select repo, commit_hash, module, category, msg_id,
  grouping(module, category, msg_id) as level, count(*) as messages from messages
group by grouping sets ((repo, commit_hash, module, category, msg_id), (repo, commit_hash, module, category),
  (repo, commit_hash, module))""",
    "raw_lint_messages": _with(LINT) + f"""select repo, commit_hash, {_text('d', 'committer_date')}, module, category,
  msg_id, symbol, case when line = 1 then 'f is too complex. The McCabe rating is ' || rating else 'msg' end as msg,
  'src/' || module || '.py' as path from messages""",
    "raw_classified_files": _with(SOURCES) + """select repo, commit_hash, path,
  case kind when 0 then 'unittest' when 2 then 'pytest' else '' end as imports,
  case kind when 0 then 'T' else '' end as unittest_classes,
  case kind when 0 then 'test_a' when 2 then 'test_b' else '' end as pytest_functions,
  cast(prod as bigint) as production_statements, cast(test as bigint) as test_statements
from counted where kind <> 3""",
    "raw_git_table": f"""select repo, total_commits, developer_count, lines_added, change_set_max,
  average_history_complexity, average_contributor_experience from ({_git('true', 'added - deleted', '')})""",
    "raw_star_events": _with(STARS) + f"""select distinct repo, {_text('d', 'starred_at')}, u as user_login from stars""",
    "document_updates": """select cast(o_orderkey as varchar) as repo,
  case when o_orderkey % 100 = 7 then 'changed' else o_orderstatus end as status,
  case when o_orderkey % 100 <> 7 then o_custkey end as customer,
  case when o_orderkey % 100 = 7 then o_orderkey end as key from orders
union all select 'new' || o_orderkey, 'changed', null, o_orderkey from orders where o_orderkey % 1000 = 1""",
    "stream_replay": """select repo, strftime(cast(day as timestamp), '%Y-%m-%d %H:%M:%S') as day, batch, value from (
  select user_id as repo, cast(ts as date) as day, event_id as batch, value,
    row_number() over (partition by user_id, cast(ts as date) order by event_id % 4 desc, event_id desc) as place
  from events) where place = 1""",
    "growing_table": _latest("events"),
    "describe_metric": f"""select "column", count(*) as count, round(avg(value), 6) as mean,
  round(stddev_samp(value), 6) as std, min(value) as min, round(quantile_cont(value, 0.25), 6) as p25,
  round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75, max(value) as max
from {METRICS} group by 1""",
    "boxplot_stats": f"""with metrics as {METRICS},
boxes as (
  select "column", quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
    quantile_cont(value, 0.75) as q3 from metrics group by 1),
placed as (
  select m."column", q1, median, q3, value,
    value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
  from metrics m join boxes b on b."column" = m."column")
select "column", round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  min(value) filter (where inside) as whisker_low, max(value) filter (where inside) as whisker_high,
  count(*) filter (where not inside) as outliers from placed group by "column", q1, median, q3""",
    "average_rank": """select value, n, before + (n + 1) / cast(2 as double) as rank from (
  select l_quantity as value, count(*) as n, sum(count(*)) over (order by l_quantity) - count(*) as before
  from lineitem group by l_quantity)""",
    "git_meta_join": _with(LANGUAGES) + """select s_name as repo, cast(sum(size) as bigint) as size,
  s_suppkey % 17 as "stargazerCount" from languages join supplier on s_name = repo group by s_name, s_suppkey""",
    "first_rows": _with(LANGUAGES) + """select s_name as repo, cast(sum(size) as bigint) as size,
  s_suppkey % 17 as "stargazerCount" from languages join supplier on s_name = repo
group by s_name, s_suppkey order by s_name limit 5""",
    "pearson": """select count(*) as n, round(corr(l_quantity, l_extendedprice), 9) as coefficient from lineitem
where l_quantity is not null and l_extendedprice is not null""",
    "spearman": f"""select count(*) as n, round(corr(rx, ry), 9) as coefficient
from {_ranked('l_quantity', 'l_extendedprice')}""",
    "correlation_words": f"""select n, round(r, 9) as coefficient,
  case when abs(r) > 0.7 then 'strong' when abs(r) > 0.3 then 'moderate' when abs(r) > 0.1 then 'weak' else 'no' end as strength,
  case when r > 0 then 'positive' when r < 0 then 'negative' else 'none' end as direction
from (select count(*) as n, corr(rx, ry) as r from {_ranked('l_quantity', 'l_discount')})""",
    # Prose is no Python: only blank lines, lone words and what stands behind a # would parse.
    "unparsable_sources": """select source as repo, doc_id as commit_hash, 'src/d' || doc_id || '.py' as path from documents
where len(list_filter(string_split(text, chr(10)),
  lambda line: not regexp_matches(regexp_replace(line, '#.*', ''), '^([\\pL_][\\pL\\pN_]*)?\\s*$'))) > 0""",
    "normality": _NORMALITY,
    "normality_sampled": _NORMALITY.replace(_TWO_METRICS, f"""(select "column", value from (
  select *, row_number() over (partition by "column" order by hash, value) as place from (
    select unnest(['l_quantity', 'l_extendedprice']) as "column", unnest([l_quantity, l_extendedprice]) as value,
      md5(l_orderkey || '|' || l_linenumber) as hash from lineitem)) where place <= {MOST_VALUES})"""),
    "describe_batches": f"""select "column", count(*) as count, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std,
  round(min(value), 4) as min, round(max(value), 4) as max, true as p25_close, true as p50_close, true as p75_close
from {METRICS} group by 1""",
    "stars_stream": _with(STARS) + f"""select repo, {_text('d', 'date')},
  cast(sum(n) over (partition by repo order by d) as bigint) as stargazers_count
from (select repo, d, count(*) as n from stars group by 1, 2)""",
    "correlation_report": _CORRELATION_REPORT,
    "describe_approximately": _DESCRIBE_APPROXIMATELY,
    "outputs_upsert": _with(STARS) + f"""select repo, {_text('d', 'date')},
  cast(sum(n) over (partition by repo order by d) + case when repo = 'click' then 0 else 1 end as bigint) as stargazers_count
from (select repo, d, count(*) as n from stars group by 1, 2)""",
    "analyze_all": _with(COMMITS, STARS, LINT, _FIRST_SEEN) + """select 'git' as result, count(distinct repo) as rows,
  cast(count(*) as double) as total from commits
union all select 'git_developers', count(*), sum(place) from (
  select row_number() over (partition by repo order by first_seq, author_name) as place from seen)
union all select 'star_growth', count(*), sum(n) from (
  select sum(n) over (partition by repo order by d) as n from (select repo, d, count(*) as n from stars group by 1, 2))
union all select 'lint_rows', (select count(*) from (select distinct repo, d, commit_hash from messages)) * 3
  + (select count(*) from (select distinct repo, d, commit_hash, category from messages))
  + (select count(*) from (select distinct repo, d, commit_hash, symbol from messages where line <> 7)),
  (select count(*) * 3 + count(*) filter (where line <> 7) from messages)""",
}
