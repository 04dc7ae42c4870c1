"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations


def clusters_sql(clusters: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, salt: int = 3) -> str:
    """Integer clustering, every round a pair of materialised steps: all distances, then floors of means."""
    finite = "len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    steps = [
        f"""kept as materialized (select row_number() over () as n, vec_id, cast(embedding as double[]) as v
  from embeddings where len(embedding) = {dimension} and {finite})""",
        f"""cells as materialized (select n, i, cast(floor({scale} * v[i]) as bigint) as x
  from kept, unnest(range(1, {dimension + 1})) as t(i))""",
        f"""starts as (select n, row_number() over (order by sha256('{salt}:' || vec_id), v) - 1 as c from kept
  where vec_id is not null qualify c < {clusters})""",
        "means0 as materialized (select c, i, x as m from starts join cells using (n))",
    ]

    def nearest(r: int) -> str:
        return f"""near{r} as materialized (select n, min(struct_pack(d := d, c := c)) as best from (
  select n, c, sum((x - m) * (x - m)) as d from cells join means{r} using (i) group by n, c) group by n)"""

    for r in range(rounds):
        steps += [
            nearest(r),
            f"""sums{r} as (select best.c as c, i, sum(x) as s, count(*) as k from near{r} join cells using (n) group by all)""",
            f"""means{r + 1} as materialized (select c, i,
  coalesce(cast((s - ((s % k) + k) % k) // k as bigint), m) as m from means{r} left join sums{r} using (c, i))""",
        ]
    steps.append(nearest(rounds))
    steps.append(f"shas as (select c, sha256(string_agg(cast(m as varchar), ',' order by i)) as sha from means{rounds} group by c)")
    return f"""with {", ".join(steps)}
select vec_id, cast(best.c as int) as cluster, cast(best.d as bigint) as distance,
  cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
  cast(sum(best.d) over () as bigint) as inertia, sha as centroid_sha256
from near{rounds} join kept using (n) join shas on shas.c = best.c"""


def _crc32_sql(text: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: cast(ord(ch) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda acc, b: {bits}), 4294967295)"


def trie_sql(family: int = 5, most_taken: int = 8) -> str:
    """Prefixes as chained hashes of all turns so far; subtrees by joining each node to its own prefixes."""
    return f"""with turns as materialized (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
ids as materialized (select conv_id, conv_id - conv_id % {family} as source, {_crc32_sql("cast(conv_id as varchar)")} % {most_taken + 1} as h
  from (select distinct conv_id from turns)),
kept as (select i.conv_id, 0 as own, t.rn, t.role, t.text from ids i join turns t on t.conv_id = i.source and t.rn <= i.h
  union all select i.conv_id, 1, t.rn, t.role, t.text from ids i join turns t on t.conv_id = i.conv_id and t.rn > i.h),
placed as (select *, row_number() over (partition by conv_id order by own, rn) as depth from kept),
paths as materialized (select conv_id, depth, octet_length(encode(text)) as bytes,
  sha256(string_agg(sha256(role || chr(1) || text), ',') over (partition by conv_id order by depth)) as node from placed
  union all select conv_id, 0, 0, 'root' from ids),
sizes as (select conv_id, max(depth) as size from paths group by conv_id),
nodes as materialized (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) * (count(*) - 1) as saved,
  max(size) = depth as leaf, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (size = depth), '') as ends
  from paths join sizes using (conv_id) group by node, depth),
parents as (select n.node, p.node as parent from nodes n join paths p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
below as (select p.node, sum(n.saved) as saved_tokens, count(*) filter (n.leaf) as n_leaves
  from nodes n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.node),
children as (select parent as node, count(*) as n_children from parents group by parent)
select n.conv_id, cast(n.depth as bigint) as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
  n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join below using (node) left join children using (node) left join parents using (node) left join nodes up on up.node = parents.parent"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clusters": clusters_sql(), "op13_prefix_trie": trie_sql()}
