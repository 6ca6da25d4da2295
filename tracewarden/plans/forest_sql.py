"""The forest of ``operators.forest`` as SQL for a second engine: sampling, growth by levels, scores."""

from tracewarden.operators.features import FEATURES
from tracewarden.operators.forest import DEPTH, DRAWS, OVERSAMPLE, PSI

SIZE = len(FEATURES)
ROWS = f"SELECT ip || '@' || bucket AS id, label, [{', '.join(FEATURES)}] AS x"


def _number(digits: str) -> str:
    return f"CAST('0x' || {digits} AS BIGINT)"


def forest(name: str, source: str, trees: int = 100, width: int = SIZE, seed: int = 42) -> str:
    """CTEs ``{name}`` (grp, tree, node, feature, cut) of inner nodes and ``{name}_leaf`` (grp, tree, node, size, sampled).

    ``source`` gives (grp, id, x) with x a list of features.
    """
    n = name
    out = f"""{n}_rows AS MATERIALIZED (SELECT * FROM ({source}) WHERE grp IS NOT NULL),
    {n}_share AS (SELECT grp, {PSI * OVERSAMPLE} / count(*) AS share FROM {n}_rows GROUP BY grp),
    {n}_draw AS (SELECT r.grp, r.id, r.x, t AS tree, substr(md5('{seed}|' || r.id || '|' || r.grp || '|' || (t // 4)), 8 * (t % 4) + 1, 7) AS u,
        CASE WHEN share >= 1 THEN 'g' ELSE printf('%07x', CAST(ceil(share * {DRAWS}) AS BIGINT)) END AS lim
      FROM {n}_rows r JOIN {n}_share USING (grp), range({trees}) AS v(t)),
    {n}_s0 AS MATERIALIZED (SELECT grp, tree, id, x, 0::BIGINT AS node FROM {n}_draw WHERE u < lim
      QUALIFY row_number() OVER (PARTITION BY grp, tree ORDER BY u, id) <= {PSI}),
    {n}_use AS MATERIALIZED (SELECT t AS tree, f FROM range({trees}) AS v(t), range({SIZE}) AS w(f)
      QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5('{seed}|' || t || '|' || f)) <= {width})"""
    for d in range(DEPTH):
        out += f""",
    {n}_b{d} AS (SELECT grp, tree, node, f, min(v) AS lo, max(v) AS hi FROM (SELECT grp, tree, node, unnest(range({SIZE})) AS f, unnest(x) AS v FROM {n}_s{d}) SEMI JOIN {n}_use USING (tree, f)
      GROUP BY ALL HAVING max(v) > min(v)),
    {n}_p{d} AS (SELECT *, row_number() OVER (PARTITION BY grp, tree, node ORDER BY f) - 1 AS k, count(*) OVER (PARTITION BY grp, tree, node) AS many,
        md5('{seed}|' || grp || '|' || tree || '|' || node) AS w FROM {n}_b{d}),
    {n}_n{d} AS MATERIALIZED (SELECT grp, tree, node, f AS feature, CASE WHEN lo < c AND c <= hi THEN c ELSE hi END AS cut
      FROM (SELECT *, lo + {_number('substr(w, 8, 7)')} / {DRAWS}.0::DOUBLE * (hi - lo) AS c FROM {n}_p{d} WHERE k = {_number('substr(w, 1, 7)')} % many)),
    {n}_s{d + 1} AS MATERIALIZED (SELECT grp, tree, id, x, 2 * node + 1 + CAST(x[feature + 1] >= cut AS BIGINT) AS node FROM {n}_s{d} JOIN {n}_n{d} USING (grp, tree, node))"""
    levels = range(DEPTH)
    out += f""",
    {n} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {n}_n{d}' for d in levels)}),
    {n}_size AS (SELECT grp, tree, count(*) AS sampled FROM {n}_s0 GROUP BY ALL),
    {n}_leaf AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f'SELECT grp, tree, node, count(*) AS size FROM {n}_s{d} GROUP BY ALL' for d in range(DEPTH + 1))})
      ANTI JOIN {n} USING (grp, tree, node) JOIN {n}_size USING (grp, tree))"""
    return out


def _path(size: str) -> str:
    return f"CASE WHEN {size} <= 1 THEN 0.0 WHEN {size} = 2 THEN 1.0 ELSE 2.0 * (ln({size} - 1.0) + 0.5772156649015329) - 2.0 * ({size} - 1.0) / {size} END"


def scores(name: str, source: str, out: str, prefixes: tuple[int, ...] = ()) -> str:
    """CTE ``{out}`` (grp, id, size, score): rows (grp, id, x) of ``source`` by the first ``size`` trees, or by all."""
    n = name
    at = "0::BIGINT AS node"
    text = f"{out}_r AS MATERIALIZED ({source}),\n    {out}_a0 AS (SELECT r.grp, r.id, r.x, t.tree, {at}, 0 AS depth FROM {out}_r r JOIN {n}_size t USING (grp))"
    for d in range(DEPTH):
        text += f""",
    {out}_a{d + 1} AS (SELECT a.grp, a.id, a.x, a.tree, CASE WHEN n.cut IS NULL THEN a.node ELSE 2 * a.node + 1 + CAST(a.x[n.feature + 1] >= n.cut AS BIGINT) END AS node,
        a.depth + CAST(n.cut IS NOT NULL AS INTEGER) AS depth FROM {out}_a{d} a LEFT JOIN {n} n USING (grp, tree, node))"""
    text += f""",
    {out}_d AS MATERIALIZED (SELECT grp, id, tree, depth + {_path('size')} AS d FROM {out}_a{DEPTH} JOIN {n}_leaf USING (grp, tree, node)),
    {out}_norm AS (SELECT grp, {_path('max(sampled)')} AS norm FROM {n}_size GROUP BY grp)"""
    sizes = " UNION ALL ".join(f"SELECT grp, id, {p} AS size, avg(d) AS d FROM {out}_d WHERE tree < {p} GROUP BY ALL" for p in prefixes) or f"SELECT grp, id, 0 AS size, avg(d) AS d FROM {out}_d GROUP BY ALL"
    return text + f",\n    {out} AS MATERIALIZED (SELECT grp, id, size, pow(2.0, -d / norm) AS score FROM ({sizes}) JOIN {out}_norm USING (grp))"
