"""SQL that grows an isolation forest level by level and scores all rows by it."""

from __future__ import annotations

import math


def _average_path(n: str) -> str:
    return f"case when {n} > 2 then 2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} when {n} = 2 then 1.0 else 0.0 end"


def sql_forest(trees: int, samples: int, seed: int, contamination: float) -> str:
    """CTEs from ``points`` (id, x) to ``scored`` (id, score, prediction); the score is not rounded."""
    levels = math.ceil(math.log2(samples))
    number = "cast('0x' || substring({}, {}, 8) as bigint)"
    steps = []
    for k in range(levels + 1):
        steps.append(f"""
    bounds{k} as materialized (
      select tree, node, f, min(v) as lo, max(v) as hi from rows{k} join feature using (id)
      where s and {k} < (select deepest from forest) group by all having max(v) > min(v)),
    split{k} as materialized (
      select tree, node, fs[i] as f, los[i] + cut / 4294967296.0 * (his[i] - los[i]) as threshold
      from (select *, 1 + {number.format('d', 1)} * len(fs) // 4294967296 as i, {number.format('d', 9)} as cut
            from (select tree, node, list(f order by f) as fs, list(lo order by f) as los, list(hi order by f) as his,
                         md5('{seed}|' || tree || '|' || node) as d
                  from bounds{k} group by tree, node))),
    sizes{k} as (select tree, node, count(*) filter (s) as n from rows{k} group by all),
    leaves{k} as (
      select id, {k} + {_average_path('n')} as path from rows{k} join sizes{k} using (tree, node)
      anti join split{k} using (tree, node)),
    rows{k + 1} as materialized (
      select r.tree, 2 * r.node + cast(v > threshold as integer) as node, r.id, r.s
      from rows{k} r join split{k} using (tree, node) join feature p on p.id = r.id and p.f = split{k}.f)""")
    paths = " union all ".join(f"select * from leaves{k}" for k in range(levels + 1))
    return f"""
    feature as materialized (select id, unnest(range(len(x))) as f, unnest(x) as v from points),
    forest as materialized (
      select least(count(*), {samples}) as n, ceil(log2(greatest(least(count(*), {samples}), 2))) as deepest from points),
    digests as (select id, md5('{seed}|' || id) as d from points),
    places as (
      select t as tree, id, ({number.format('d', 1)} + t * {number.format('d', 9)}) % 4294967296 as place
      from digests cross join range({trees}) as r(t)),
    chosen as (
      select tree, id from places
      qualify row_number() over (partition by tree order by place, id) <= {samples}),
    rows0 as materialized (
      select t as tree, 1 as node, p.id, c.id is not null as s
      from points p cross join range({trees}) as r(t) left join chosen c on c.tree = t and c.id = p.id),{",".join(steps)},
    lengths as (select id, sum(path) as total from ({paths}) group by id),
    scores as (
      select id, -pow(2, -total / {trees} / (select {_average_path('n')} from forest)) as score from lengths),
    scored as (
      select id, score, case when score < (select quantile_cont(score, {contamination}) from scores) then -1 else 1 end
             as prediction
      from scores)"""
