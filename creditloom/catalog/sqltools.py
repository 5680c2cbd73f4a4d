"""SQL text for exact equal-frequency edges, shared by the oracles."""


def edges_cte(source: str, group: str, value: str, k: int, name: str = "edges") -> str:
    """CTEs ending in ``name(group, n, n_keys, e)``: the k + 1 interpolated edges, duplicates removed, ascending.

    Ranks are integers: position i of k is row i * (n - 1) / k, interpolated by the remainder.
    """
    return f"""
{name}_rn AS (SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS rn,
    count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL),
{name}_k AS (SELECT unnest(range(0, {k + 1})) AS k),
{name}_pos AS (SELECT g, n, k, (k * (n - 1)) // {k} AS lo, (k * (n - 1)) % {k} AS rest
    FROM (SELECT DISTINCT g, n FROM {name}_rn) CROSS JOIN {name}_k),
{name}_val AS (SELECT p.g, p.n, p.k, a.v + CASE WHEN p.rest = 0 THEN 0 ELSE (b.v - a.v) * (p.rest / {k}.0::DOUBLE) END AS e
    FROM {name}_pos p JOIN {name}_rn a ON a.g = p.g AND a.rn = p.lo
    LEFT JOIN {name}_rn b ON b.g = p.g AND b.rn = p.lo + 1),
{name} AS (SELECT g, any_value(n) AS n, (SELECT count(DISTINCT v) FROM {name}_rn r WHERE r.g = x.g) AS n_keys,
    list_sort(list_distinct(list(e))) AS e FROM {name}_val x GROUP BY g)"""


def bin_expr(value: str, edges: str = "e") -> str:
    """Right-closed bin number, lowest edge in bin 1, NULL outside."""
    return (
        f"CASE WHEN {value} >= {edges}[1] AND {value} <= {edges}[-1] "
        f"THEN greatest(len(list_filter({edges}, lambda x: x < {value})), 1) END"
    )
