"""SQL for the queries that SQL can say, in DuckDB's dialect."""

from __future__ import annotations

from . import chat, decontam, divergence, host_quality, importance

_WORD4 = r"[^\x20\x09-\x0D]+"
_H = host_quality



def _joined(n: int) -> str:
    """n words from this one on, joined by spaces; null if there are fewer."""
    return " || ' ' || ".join(["x", *[f"lead(x, {k}) over o" for k in range(1, n)]])


OP4 = f"""
with w as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD4}') as w from documents),
g as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
s as (select doc_id, i, s from (select doc_id, i, {_joined(_H.WINDOW)} as s from g window o as (partition by doc_id order by i)) where s is not null),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from s) where c > 1),
p as (select doc_id, count(distinct i + k) as n from r, (select unnest(range({_H.WINDOW})) as k) group by doc_id),
m as (select doc_id, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD4}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD4}')))) as n_dup_lines,
    coalesce(p.n, 0) as n_repeat_words from w left join p using (doc_id)),
b as (select *, n_words < {_H.MIN_WORDS} or 100 * n_repeat_words > {_H.MAX_REPEAT_PERCENT} * n_words as base_failed from m),
h as (select source, count(*)::double as n, count(*) filter (where base_failed)::double as x from b group by source),
a as (select sum(n) as n, sum(x) as x, sum(n * n) as nn, sum(x * x / n) as xx, count(*) as k, sum(x) / sum(n) as mean from h),
q as (select mean, ((xx / n - mean * mean) / nullif(mean * (1 - mean), 0) - (k - 1) / n) / nullif(1 - nn / (n * n), 0) as rho from a),
z as (select mean, coalesce(greatest({_H.PRIOR_LEAST}, least({_H.PRIOR_MOST}, 1 / greatest(rho, 1e-9) - 1)), {_H.PRIOR_LEAST}) as weight from q),
v as (select source, (x + mean * weight) / (n + weight) as rate, n + weight as total from h, z),
d as (select source, coalesce(rate - {_H.Z} * sqrt(rate * (1 - rate) / (total + 1)) > {_H.HOST_LIMIT}, false) as rejected from v)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not rejected as kept
from b join d on b.source is not distinct from d.source
"""

_WORDS5 = f"regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '{decontam.WORD}')"


def _listed(n: int) -> str:
    return "[" + ", ".join(["x", *[f"lead(x, {k}) over o" for k in range(1, n)]]) + "]"


OP5 = f"""
with i as (select item_id, {_WORDS5} as w from benchmark), d as (select doc_id, {_WORDS5} as w from documents),
e as (select distinct least(len(w), {decontam.WINDOW}) as n from i where len(w) > 0),
iw as (select item_id, least(len(w), {decontam.WINDOW}) as n, unnest(w) as x, generate_subscripts(w, 1) as k from i),
b as (select distinct item_id, n, array_to_string(a[1:n], ' ') as s from (select item_id, n, {_listed(decontam.WINDOW)} as a from iw window o as (partition by item_id order by k)) where a[n] is not null),
dw as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as k from d),
x as (select doc_id, k, n, array_to_string(a[1:n], ' ') as s from (select doc_id, k, {_listed(decontam.WINDOW)} as a from dw window o as (partition by doc_id order by k)), e where a[n] is not null),
h as (select doc_id, k, x.n, item_id from x join b using (n, s)),
p as (select doc_id, count(distinct k + j) as n_hit from (select distinct doc_id, k, n from h), lateral (select unnest(range(n)) as j) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""

def _crc_table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


_I = importance
_WORDS11 = f"regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '{decontam.WORD}')"
_BYTES = "list_transform(range(strlen(x)), lambda i: ('0x' || substring(hex(encode(x)), 2 * i + 1, 2))::bigint)"
OP11 = f"""
with w as (select doc_id, 0 as side, {_WORDS11} as w from documents union all select item_id, 1, {_WORDS11} from benchmark),
g as (select doc_id, side, unnest(w) as x, generate_subscripts(w, 1) as i from w),
f as (select doc_id, side, x from g union all select * from (select doc_id, side, x || ' ' || lead(x) over o as x from g window o as (partition by doc_id, side order by i)) where x is not null
  union all select * from (select doc_id, side, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o as x from g window o as (partition by doc_id, side order by i)) where x is not null),
c as (select doc_id, side, x, count(*) as n from f group by all),
h as (select x, xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES}), lambda c, b: xor(c >> 8, list_extract({_crc_table()}, xor(c, b) % 256 + 1))), 4294967295) % {_I.BUCKETS} as b from (select distinct x from c)),
t as (select b, coalesce(sum(n) filter (where side = 0), 0)::double as s, coalesce(sum(n) filter (where side = 1), 0)::double as t from c join h using (x) group by b),
a as (select sum(s) as s, sum(t) as t from t),
k as (select b, floor(1000 * ln((t.t + 1) * (a.s + {_I.BUCKETS}) / ((t.s + 1) * (a.t + {_I.BUCKETS}))))::bigint as gain from t, a),
d as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from c join h using (x) join k using (b) where side = 0 group by doc_id),
u as (select w.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substring(sha256('{_I.SEED}:' || w.doc_id), 1, 8))::bigint as h from w left join d using (doc_id) where side = 0),
v as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from u),
r as (select *, case when n_words >= {_I.MIN_WORDS} then row_number() over (partition by n_words >= {_I.MIN_WORDS} order by score desc, doc_id) end as r from v)
select doc_id, n_features, weight, score, case when r <= (select {_I.PERCENT} * count(r) // 100 from r) then r end as rank from r
"""

_D = divergence
_P = f"1 + {_D.SCALE} * ({{n}} + 1)::hugeint // ({{total}} + v)"
OP12 = f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '{_D.TERM}') as w from documents),
g as (select distinct lang, source from d),
o as (select doc_id, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as whole from o group by lang, term having count(distinct doc_id) >= {_D.MIN_DOCS}),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
v as (select lang, count(*) as v, sum(whole) as lang_n from k group by lang),
t as (select lang, source, sum(n) as group_n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(n, 0) as n, {_P.format(n="coalesce(n, 0)", total="coalesce(group_n, 0)")} as p, {_P.format(n="whole", total="lang_n")} as q
  from g join k using (lang) join v using (lang) left join t using (lang, source) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
e as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from e)
select * from r where part = 'pair' or rank <= {_D.TOP}
"""

ORACLE_SQL = {"op4_host_quality": OP4, "op5_decontamination": OP5, "op6_chat": chat.ORACLE, "op11_importance": OP11, "op12_divergence": OP12}
