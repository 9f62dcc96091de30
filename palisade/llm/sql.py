"""The same results in SQL, for the queries that it can express."""

from __future__ import annotations

from . import mixing, suffix_dedup


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- op1: shares by filling up, and prefixes in the order of a hash --------------------

def _share(nodes: str, parent: list[str], name: str, out: str) -> str:
    """CTEs that give each child of ``nodes`` (parent, name, weight, capacity, budget) its quota."""
    by = f"partition by {', '.join(parent)}" if parent else ""
    on = ", ".join([*parent, "late"])
    keys = ", ".join([*parent, name])
    return f"""
 {out}_a as (select *, coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0)::hugeint as filled, (sum(weight) over ({by}) - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0))::hugeint as heft from {nodes} where weight > 0 and capacity > 0 window w as ({by} order by capacity / weight, {name})),
 {out}_b as (select *, greatest(budget - filled, 0)::hugeint as rest from {out}_a),
 {out}_c as (select *, max(case when capacity * heft <= rest * weight then 0 else 1 end) over ({by} order by capacity / weight, {name} rows between unbounded preceding and current row) = 1 as late from {out}_b),
 {out}_d as (select * replace (first_value(rest) over w as rest, first_value(heft) over w as heft) from {out}_c window w as (partition by {on} order by capacity / weight, {name})),
 {out}_e as (select *, case when late then rest * weight // heft else capacity::hugeint end as part from {out}_d),
 {out} as (select {keys}, (part + case when late and row_number() over (partition by {on} order by {name}) <= rest - sum(part) over (partition by {on}) then 1 else 0 end)::bigint as budget from {out}_e)"""


def op1() -> str:
    domains = "[" + ", ".join(map(_text, mixing.DOMAINS)) + "]"
    weight = lambda d, c: "case " + " ".join(f"when {c} = {_text(k)} then {v}" for k, v in d.items()) + " else 1 end"
    return rf"""with d as (select doc_id, coalesce(doc_id::varchar, '') as name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens, coalesce({domains}[try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') as int) % 4 + 1], 'other') as domain, coalesce(lang, '(null)') as lang, coalesce(source, '(null)') as source from documents),
 t as (select domain, lang, source, sum(tokens)::bigint as tokens from d group by all), f as (select * from t where tokens > 0),
 r as (select least(sum(tokens) * {mixing.EPOCHS}, floor((select sum(tokens) from t) * {mixing.SHARE}::double)::bigint) as budget from f),
 n1 as (select domain, {weight(mixing.DOMAIN_WEIGHTS, 'domain')} as weight, sum(tokens) * {mixing.EPOCHS} as capacity, any_value(r.budget) as budget from f, r group by domain),{_share('n1', [], 'domain', 'q1')},
 n2 as (select domain, lang, {weight(mixing.LANGUAGE_WEIGHTS, 'lang')} as weight, sum(tokens) * {mixing.EPOCHS} as capacity, any_value(q1.budget) as budget from f join q1 using (domain) group by domain, lang),{_share('n2', ['domain'], 'lang', 'q2')},
 n3 as (select domain, lang, source, 1 as weight, tokens * {mixing.EPOCHS} as capacity, q2.budget from f join q2 using (domain, lang)),{_share('n3', ['domain', 'lang'], 'source', 'q3')},
 x as (select d.*, q3.budget as quota, q3.budget // t.tokens as whole, q3.budget % t.tokens as rest from d join q3 using (domain, lang, source) join t using (domain, lang, source) where q3.budget > 0),
 y as (select *, md5('{mixing.SEED}:' || whole || ':' || name) as ord from x),
 z as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by ord, name rows between unbounded preceding and 1 preceding), 0) as before from y),
 e as (select *, whole + case when tokens > 0 and before < rest then 1 else 0 end as times from z)
 select doc_id, domain, lang, source, tokens as n_tokens, quota, unnest(range(times))::int as epoch from e where times > 0"""


# --- op4: all distances -------------------------------------------------------------------

OP4 = """with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 s as (select a.vec_id as query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda p, x: p + x)) as score from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 100 = 0),
 r as (select *, (row_number() over (partition by query_id order by score, vec_id))::int as rank from s) select query_id, rank, vec_id, score from r where rank <= 10"""

# --- op6: all pairs that share a shingle, and their closure ----------------------------------

OP6 = r"""with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as w, text from documents),
 g as (select doc_id, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [chr(1) || coalesce(text, '')] end as g from w),
 u as (select doc_id, unnest(g) as s from g), c as (select doc_id, s, count(*) as n from u group by all), t as (select doc_id, sum(n) as n from c group by 1),
 p as (select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as common from c a join c b on a.s = b.s and a.doc_id < b.doc_id group by all),
 l as (select a, b from p join t x on x.doc_id = a join t y on y.doc_id = b where common >= 0.8::double * (x.n + y.n - common)), e as (select a, b from l union all select b, a from l),
 m as (select a as doc_id, b as other from e union select m.doc_id, e.b from m join e on e.a = m.other),
 k as (select doc_id, min(other) as other from m group by 1)
 select d.doc_id, least(d.doc_id, coalesce(k.other, d.doc_id)) as class_id, d.doc_id = least(d.doc_id, coalesce(k.other, d.doc_id)) as kept from documents d left join k using (doc_id)"""

# --- op9: all windows of 400 bytes --------------------------------------------------------------

OP9 = f"""with d as (select doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, ''))::bigint as n from documents),
 w as (select doc_id, i, md5(substr(h, (2 * i + 1)::bigint, {2 * suffix_dedup.LENGTH})) as x from (select doc_id, h, unnest(range(n - {suffix_dedup.LENGTH - 1})) as i from d where n >= {suffix_dedup.LENGTH})),
 r as (select x from w group by x having count(*) > 1), s as (select doc_id, i, i + {suffix_dedup.LENGTH} as e from w semi join r using (x)),
 b as (select *, case when i <= lag(e) over (partition by doc_id order by i) then 0 else 1 end as fresh from s), g as (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as k from b),
 m as (select doc_id, k, min(i) as a, max(e) as z from g group by all),
 o as (select doc_id, k, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from m),
 c as (select o.doc_id, count(*) as n_spans, sum(z - a)::bigint as n_removed, string_agg(substr(h, (2 * before + 1)::bigint, (2 * (a - before))::bigint), '' order by a) || substr(any_value(h), (2 * max(z) + 1)::bigint, any_value(2 * n)) as kept from o join d using (doc_id) group by o.doc_id)
 select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join c using (doc_id)"""

ORACLE_SQL = {"op1_mixing": op1(), "op4_nearest": OP4, "op6_near_dup": OP6, "op9_suffix_dedup": OP9}
