"""DuckDB SQL for the corpus queries that SQL can express."""

from repostrata.llm import rules

# Words of a text: A-Z lowered, runs of digits, letters and non-ASCII characters.
_BENCH_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_DECONTAMINATE = f"""
with d as (select row_number() over () r, doc_id, {_BENCH_WORDS} w from documents),
b as (select item_id, {_BENCH_WORDS} w from benchmark),
items as (select distinct item_id, least(13, len(w)) k, w[i:i + 12] win
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) i from b where len(w) > 0)),
sizes as (select distinct k from items),
found as (select r, i, items.k, item_id
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k) p
  join items on items.k = p.k and items.win = p.w[p.i:p.i + p.k - 1]),
hits as (select r, count(distinct i + o) n from (select r, i, unnest(range(0, k)) o from found) group by r),
ids as (select r, count(*) n, string_agg(id, ',' order by id) s
  from (select distinct r, item_id::varchar id from found) group by r)
select doc_id, len(w)::bigint n_words, coalesce(hits.n, 0)::bigint n_hit, coalesce(ids.n, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256,
  coalesce(hits.n, 0) > 0 and 20 * coalesce(hits.n, 0) >= len(w) contaminated
from d left join hits using (r) left join ids using (r)
"""

_CELLS = [(name, i, cut) for name, (_, _, cuts) in rules.RULES.items() for i, cut in enumerate(cuts)]
_SIGN = {name: ">" if large else "<" for name, (_, large, _) in rules.RULES.items()}
_TESTS = f"({len(_CELLS)} * (select count(*) from counted))"


def _tail(k: str, p: float) -> str:
    """Binomial probability of at most ``k`` successes in ``n``, term by term."""
    term = f"exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p}) + (n - j) * ln(1 - {p}))"
    return f"list_sum([{term} for j in range(0, {k} + 1)])"


def _cutoff(name: str) -> str:
    share = rules.ALPHA / len(rules.RULES)
    cases = [
        f"when k_{r}_{i} < n * {share} and {_tail(f'k_{r}_{i}', share)} <= {rules.DELTA} / {_TESTS} then {cut!r}"
        for r, i, cut in _CELLS
        if r == name
    ]
    return f"case {' '.join(cases)} end c_{name}"


_QUALITY_RULES = f"""
with d as (select row_number() over () r, doc_id, lang, coalesce(text, '') t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
wins as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] win
  from (select r, w, unnest(range(1, len(w) - 1)) i from d where len(w) >= 3)),
twice as (select r, i from wins qualify count(*) over (partition by r, win) > 1),
reps as (select r, count(distinct i + o) n from (select r, i, unnest([0, 1, 2]) o from twice) group by r),
dups as (select r, count(*) - count(distinct line) n
  from (select r, unnest(string_split(t, chr(10))) line from d)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
base as (select d.r, doc_id, coalesce(lang, '') stratum, len(w)::bigint n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(dups.n, 0)::bigint n_dup_lines, coalesce(reps.n, 0)::bigint n_repeat_words
  from d left join reps using (r) left join dups using (r)),
judged as (select *, n_words < {rules.MIN_WORDS}
  or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words base_failed from base),
good as (select distinct * exclude (r) from judged where not base_failed
  and doc_id in (select doc_id from labels where quality = 1 and doc_id is not null)),
counted as (select stratum, count(*) n,
  {", ".join(f"count(*) filter (where {rules.RULES[r][0]} {_SIGN[r]} {c!r}) k_{r}_{i}" for r, i, c in _CELLS)}
  from good group by stratum),
cutoffs as (select stratum, {", ".join(_cutoff(name) for name in rules.RULES)} from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(
    f"coalesce(n_words > 0 and {sql} {_SIGN[name]} c_{name}, false)" for name, (sql, _, _) in rules.RULES.items())}) kept
from judged left join cutoffs using (stratum)
"""

_SEARCH = f"""
with d as (select row_number() over () r, doc_id, {_BENCH_WORDS} w from documents),
docs as (select r, doc_id, len(w) n from d where len(w) > 0),
tf as (select r, term, count(*) tf from (select r, unnest(w) term from d) group by all),
df as (select term, count(*) df from tf group by term),
total as (select count(*) n_docs, sum(n) n_terms from docs),
asked as (select distinct item_id, unnest({_BENCH_WORDS}) term from benchmark),
weighted as (select item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint w
  from asked join df using (term), total),
scored as (select item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint score
  from weighted join tf using (term) join docs using (r), total group by all)
select item_id, place::int rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) place
  from scored where score > 0) where place <= 10
"""


def _assigned(number: int) -> str:
    """Entry and distance of each part for codebook ``number``, packed as distance * 64 + entry."""
    return f"""a{number} as (select r, part, min(dist * 64 + entry) best
  from (select r, part, entry, sum((v - c) * (v - c)) dist from comps join book{number} using (part, pos) group by all)
  group by all)"""


def _moved(number: int) -> str:
    """Codebook ``number`` from the assignment before it, rounded down."""
    return f"""s{number} as (select part, best % 64 entry, pos, sum(v) s, count(*) n
  from comps join a{number - 1} using (r, part) group by all),
book{number} as (select part, entry, pos,
    coalesce(case when s >= 0 or s % n = 0 then s // n else s // n - 1 end, c)::bigint c
  from book{number - 1} left join s{number} using (part, entry, pos))"""


_CODES = f"""
with k as (select row_number() over (order by vec_id, embedding) r, vec_id, label, embedding e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
size as (select max(len(e)) // 16 d from k),
comps as (select r, (i - 1) // d part, (i - 1) % d pos, floor(256 * e[i]::double)::bigint v
  from (select r, e, unnest(range(1, len(e) + 1)) i from k), size),
book0 as (select part, r - 1 entry, pos, v c from comps where r <= 64),
{_assigned(0)}, {_moved(1)}, {_assigned(1)}, {_moved(2)}, {_assigned(2)},
coded as (select r, string_agg(printf('%02x', (best % 64)::int), '' order by part) code, sum(best // 64)::bigint error
  from a2 group by r),
labels as (select label, sum(error)::bigint label_error from k join coded using (r) group by label)
select vec_id, code, error, label_error,
  (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) from book2) codebooks_sha256
from k join coded using (r) join labels on k.label is not distinct from labels.label
"""

ORACLES: dict[str, str] = {
    "op9_decontaminate": _DECONTAMINATE,
    "op10_quality_rules": _QUALITY_RULES,
    "op11_search": _SEARCH,
    "op12_codes": _CODES,
}
