"""DuckDB SQL for the queries that SQL can express over whole tables.

XXH64, byte-pair merges, trained models and spans in code points have no SQL form; those queries are tested against brute
force, the libraries' own results, exact round trips or held-out accuracy.
"""

_NEAR_EMBEDDINGS = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x != 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id != b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
reach as (select vec_id as s, vec_id as t from v union select r.s, l.b from reach r join links l on r.t = l.a),
low as (select s, min(t) as c from reach group by 1),
deg as (select a, count(*) as n from links group by 1)
select v.vec_id, coalesce(deg.n, 0) as n_links, low.c as component_id, v.vec_id = low.c as kept
from v join low on v.vec_id = low.s left join deg on v.vec_id = deg.a
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
items as (select item_id, w, least(10, len(w)) as m from b where len(w) > 0),
windows as (select item_id, m, array_to_string(w[k:k + m - 1], ' ') as t from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as k from items)),
sizes as (select distinct m from windows),
grams as (select doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') as t from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d cross join sizes where len(w) >= m)),
found as (select g.doc_id, g.k, g.m, i.item_id from grams g join windows i on g.m = i.m and g.t = i.t),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + m)) as p from found) group by 1),
ids as (select doc_id, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from found group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(ids.n, 0) as n_items, sha256(coalesce(ids.s, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join ids on d.doc_id = ids.doc_id
"""



def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    data = f"list_transform(range(strlen({text})), lambda i: cast('0x' || substr(hex({text}), 2 * i + 1, 2) as bigint))"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({data}, lambda c, b: {bits}, cast(4294967295 as bigint)), 4294967295)"


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPELLING = f"""
with recursive runs as (select doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
counted as (select coalesce(cast(doc_id as varchar), '') || ':' || run as s, run, count(*) as n from runs where length(run) >= 6 group by 1, 2),
hashed as (select run, n, {_crc32("s")} as h from counted),
meant as (select case when h % 199 = 0 then left(run, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed),
w as (select word, cast(sum(n) as bigint) as n from meant where length(word) >= 6 group by 1 having sum(n) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as k from w),
gaps as (select word, n, k, left(word, k - 1) as a, substr(word, k + 1) as b from places),
pairs as (select x.word as p, y.word as q, y.n as m from gaps x join gaps y on x.k = y.k and x.a = y.a and x.b = y.b and x.word != y.word
  union select x.word, y.word, y.n from gaps x join w y on x.a || x.b = y.word
  union select y.word, x.word, x.n from gaps x join w y on x.a || x.b = y.word),
near as (select p, count(*) as n_near, max(m) as top from pairs group by 1),
best as (select p, min(q) as q from pairs join near using (p) where m = top group by 1),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then q end as form, case when top >= 5 * n then top end as form_n from w left join near on w.word = near.p left join best on w.word = best.p),
walk as (select word, word as place, 0 as d from known union all select walk.word, known.form, d + 1 from walk join known on walk.place = known.word where known.form is not null),
roots as (select word, arg_max(place, d) as root from walk group by 1)
select known.word, form, root, n, n_near, form_n from known join roots using (word)
"""

_PREFIX_TRIE = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i,
  [coalesce(role, ''), coalesce(text, '')] as x from conversations where conv_id is not null),
named as (select distinct c, cast(c as varchar) as s from t), ids as (select c, {_crc32("s")} % 9 as h from named),
turns as (select ids.c, 0 as part, i, x from ids join t on t.c = ids.c - ids.c % 5 and t.i < h union all select ids.c, 1, i, x from ids join t on t.c = ids.c and t.i >= h),
seqs as (select c, list(x order by part, i) as s from turns group by 1),
members as (select ids.c, coalesce(s, []) as s, unnest(range(0, len(coalesce(s, [])) + 1)) as d from ids left join seqs using (c)),
nodes as (select s[1:d] as p, d, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (len(s) = d), '') as ends from members group by 1, 2),
sized as (select *, case when d = 0 then 0 else (n_convs - 1) * strlen(p[d][2]) end as saved from nodes),
children as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1),
counted as (select sized.*, coalesce(children.n, 0) as n_children from sized left join children on sized.p = children.p),
under as (select p[1:k] as p, sum(saved) as saved, sum(cast(n_children = 0 as int)) as leaves from (select *, unnest(range(0, d + 1)) as k from counted) group by 1)
select x.conv_id, x.d as depth, y.conv_id as parent_conv_id, x.n_convs, x.n_children, cast(under.leaves as bigint) as n_leaves, cast(under.saved as bigint) as saved_tokens, sha256(x.ends) as ends_sha256
from counted x join under on x.p = under.p left join nodes y on x.d > 0 and y.p = x.p[1:x.d - 1]
"""

SQL: dict[str, str] = {"op1_near_embeddings": _NEAR_EMBEDDINGS, "op3_decontamination": _DECONTAMINATION, "op12_prefix_trie": _PREFIX_TRIE, "op13_spelling": _SPELLING}
