"""DuckDB SQL for the queries that SQL can express, by brute force over whole tables.

Each follows the contract of its query and none of its method: no anchors,
suffixes, signatures or graphs, but all windows, all pairs with a common
shingle, all vectors.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Hits (doc_id, k), ascending windows of {length} units from k, as maximal runs
#: (doc_id, a, b): units a to b - 1 are covered.
_RUNS = """
    marked as (
        select doc_id, k, coalesce(k > lag(k) over w + {length}, true) as opens from hits window w as (partition by doc_id order by k)
    ),
    numbered as (select doc_id, k, sum(opens::int) over (partition by doc_id order by k rows unbounded preceding) as run from marked),
    runs as (select doc_id, run, min(k) as a, max(k) + {length} as b from numbered group by doc_id, run)"""

SUBSTRING_DEDUP = f"""
with d as materialized (select doc_id, {_WORDS} as words from documents),
    windows as (
        select doc_id, k, md5_number(array_to_string(words[k + 1 : k + 50], ' ')) as string
        from (select doc_id, words, unnest(range(len(words) - 49)) as k from d where len(words) >= 50)
    ),
    firsts as (select string, min(doc_id) as first from windows group by string),
    hits as (select doc_id, k from windows join firsts using (string) where first < doc_id),
    {_RUNS.format(length=50)},
    gone as (select distinct doc_id, unnest(range(a, b)) as p from runs),
    placed as (select doc_id, unnest(words) as word, unnest(range(len(words))) as p from d),
    kept as (select doc_id, string_agg(word, ' ' order by p) as body, count(*) as n from placed anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256
from d left join kept using (doc_id)
"""

# Places are places of bytes, as slices of blobs are; what is kept is put together as hexadecimal digits.
SUFFIX_DEDUP = f"""
with d as materialized (select doc_id, encode(coalesce(text, '')) as bytes, strlen(coalesce(text, '')) as n from documents),
    windows as (
        select doc_id, k, md5_number(bytes[k + 1 : k + 400]) as string
        from (select doc_id, bytes, unnest(range(n - 399)) as k from d where n >= 400)
    ),
    hits as (select doc_id, k from (select doc_id, k, count(*) over (partition by string) as places from windows) where places > 1),
    {_RUNS.format(length=400)},
    rests as (
        select doc_id, coalesce(lag(b) over w, 0) as a, a as b from runs window w as (partition by doc_id order by a)
        union all select doc_id, max(b), max(n) from runs join d using (doc_id) group by doc_id
    ),
    kept as (select doc_id, string_agg(hex(bytes[x.a + 1 : x.b]), '' order by x.a) as digits from rests x join d using (doc_id) where x.a < x.b group by doc_id),
    cut as (select doc_id, sum(b - a) as gone, count(*) as spans from runs group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
    sha256(case when spans is null then bytes else unhex(coalesce(digits, '')) end) as kept_sha256
from d left join cut using (doc_id) left join kept using (doc_id)
"""

# The probability Jaccard is at least as costly as the square of a pair's shingles, so it is computed only where
# shingles are repeated and the sum of the smaller shares, which bounds it, reaches the threshold.
NEAR_DUPLICATES = f"""
with recursive d as materialized (select doc_id, array_to_string(words, ' ') as body, words from (select doc_id, {_WORDS} as words from documents)),
    nodes as materialized (select min(doc_id) as node, body, any_value(words) as words from d where body <> '' group by body),
    spread as (select node, array_to_string(words[k + 1 : k + 5], ' ') as s from (select node, words, unnest(range(greatest(len(words) - 4, 1))) as k from nodes)),
    shingles as materialized (select node, s, 1 + ln(count(*)) as weight from spread group by node, s),
    sizes as materialized (select node, count(*) as n, sum(weight) as total, max(weight) > 1 as repeated from shingles group by node),
    shared as (
        select x.node as a, y.node as b, count(*) as both_have, sum(least(x.weight / p.total, y.weight / q.total)) as bound
        from shingles x join shingles y on x.s = y.s and x.node < y.node join sizes p on p.node = x.node join sizes q on q.node = y.node
        group by x.node, y.node
    ),
    judged as materialized (
        select a, b, both_have / (p.n + q.n - both_have)::double as plain, (p.repeated or q.repeated) and bound >= 0.8 - 1e-9 as weigh
        from shared join sizes p on p.node = a join sizes q on q.node = b
    ),
    weighed as materialized (
        select a, b, s, sum(x) as x, sum(y) as y
        from (
            select a, b, s, weight as x, 0.0 as y from judged join shingles on node = a where weigh and plain < 0.8
            union all select a, b, s, 0.0, weight from judged join shingles on node = b where weigh and plain < 0.8
        )
        group by a, b, s
    ),
    likely as (
        select a, b from (
            select i.a, i.b, i.s, 1 / sum(greatest(j.x / i.x, j.y / i.y)) as part
            from weighed i join weighed j on i.a = j.a and i.b = j.b where i.x > 0 and i.y > 0 group by i.a, i.b, i.s
        ) group by a, b having sum(part) >= 0.8
    ),
    links as materialized (select a, b from judged where plain >= 0.8 union all select a, b from likely),
    edges as materialized (select a as here, b as there from links union all select b, a from links),
    reach as (select node as label, node from nodes union select label, there from reach join edges on here = node),
    labels as (select node, min(label) as label from reach group by node),
    classed as (select d.doc_id, coalesce(label, d.doc_id) as class_id from d left join nodes on nodes.body = d.body left join labels on labels.node = nodes.node)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as keep from classed
"""

NEAREST_NEIGHBOURS = """
with v as materialized (
    select vec_id, embedding::double[] as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
),
    scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x) as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
    ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored)
select * from ranked where rank <= 20
"""

ORACLE_SQL = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op6_nearest_neighbours": NEAREST_NEIGHBOURS,
    "op8_suffix_array_dedup": SUFFIX_DEDUP,
    "op10_minhash_near_dedup": NEAR_DUPLICATES,
}
