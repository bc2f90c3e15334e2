"""The fits in SQL, for checking: traces by hashed signs, normal equations by sweeps, rho by grids that close in."""

from __future__ import annotations

PRIME = 2147483647
SIGNIFICANT = 5


def trace_ctes(kmax: int, probes: int, seed: int) -> str:
    """tr(k, tr): the mean over the probes, the first two exact. Needs w(i, j, w) and kept(cell)."""
    mix = f"""probe AS (SELECT range AS b FROM range(0, {probes})),
h1 AS (SELECT b, cell, (cell * 1103515245 + (b * 104729 + {seed * 15485863})) % {PRIME} AS h FROM kept CROSS JOIN probe), h2 AS (SELECT b, cell, (h * h + (b * 7919 + 12345)) % {PRIME} AS h FROM h1),
h3 AS (SELECT b, cell, (h * 48271 + cell) % {PRIME} AS h FROM h2), z0 AS MATERIALIZED (SELECT b, cell, CASE WHEN ((h * h) % {PRIME}) // 65536 % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS z FROM h3)"""
    powers = [f"z{k} AS MATERIALIZED (SELECT b, i AS cell, sum(w * z) AS z FROM w JOIN z{k - 1} p ON p.cell = w.j GROUP BY 1, 2)" for k in range(1, kmax + 1)]
    each = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(z0.z * z{k}.z) / {probes} FROM z0 JOIN z{k} USING (b, cell)) AS tr" for k in range(3, kmax + 1))
    exact = "SELECT 1 AS k, 0.0::DOUBLE AS tr UNION ALL SELECT 2, (SELECT sum(a.w * b.w) FROM w a JOIN w b ON a.i = b.j AND a.j = b.i)"
    return ", ".join([mix, *powers, f"tr AS MATERIALIZED ({exact} UNION ALL {each})"])


def sweeps(source: str, pivots: int, name: str) -> str:
    """name0 .. name<pivots>: the matrix (i, j, v) swept on its first rows; their block is then the inverse, the columns
    beside it the solutions, and the block below what the solutions leave."""
    out = [f"{name}0 AS MATERIALIZED (SELECT i, j, v FROM {source})"]
    for k in range(1, pivots + 1):
        m = f"{name}{k - 1}"
        out.append(
            f"""{name}{k} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN 1 / p.v WHEN a.i = {k} THEN a.v / p.v WHEN a.j = {k} THEN -a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v
FROM {m} a JOIN {m} c ON c.i = {k} AND c.j = a.j JOIN {m} r ON r.i = a.i AND r.j = {k} CROSS JOIN (SELECT v FROM {m} WHERE i = {k} AND j = {k}) p)"""
        )
    return ", ".join(out)


def fit_ctes(names: list[str]) -> str:
    """long (cell, i, x) of the columns x, y and wy, their products, and one row ``opt`` with rho and what goes with it."""
    columns = [*names, "y", "wy"]
    p = len(names)
    long = " UNION ALL ".join(f"SELECT cell, {i} AS i, CAST({c.lower()} AS DOUBLE) AS x FROM model" for i, c in enumerate(columns, 1))
    value = "(SELECT -sum(power(rho, k) * tr / k) FROM tr) - n / 2.0 * ln((e00 - 2 * rho * e01 + rho * rho * e11) / n)"

    def grid(name: str, rhos: str) -> str:
        each = f"SELECT rho, {value} AS value FROM ({rhos}) g CROSS JOIN e WHERE rho BETWEEN -0.99 AND 0.99"
        return f"{name} AS MATERIALIZED (SELECT rho FROM ({each}) ORDER BY value DESC, rho LIMIT 1)"

    at = lambda i, j: f"(SELECT v FROM s{p} WHERE i = {i} AND j = {j})"
    return ", ".join(
        [
            f"long AS MATERIALIZED ({long})",
            "products AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM long a JOIN long b USING (cell) GROUP BY 1, 2)",
            sweeps("products", p, "s"),
            f"e AS MATERIALIZED (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM model) AS n, {at(p + 1, p + 1)} AS e00, {at(p + 1, p + 2)} AS e01, {at(p + 2, p + 2)} AS e11)",
            grid("g1", "SELECT range / 1000.0::DOUBLE AS rho FROM range(-990, 991)"),
            grid("g2", "SELECT g1.rho + range * 2e-6::DOUBLE AS rho FROM range(-1000, 1001) CROSS JOIN g1"),
            grid("g3", "SELECT g2.rho + range * 4e-9::DOUBLE AS rho FROM range(-1000, 1001) CROSS JOIN g2"),
            """opt AS MATERIALIZED (SELECT rho, n, e00 - 2 * rho * e01 + rho * rho * e11 AS sse, -2 * e01 + 2 * rho * e11 AS slope, e11, (SELECT sum((k - 1) * power(rho, k - 2) * tr) FROM tr WHERE k > 1) AS bend,
(SELECT sum(power(rho, k - 1) * tr) FROM tr) AS series, (SELECT sum(power(rho, k) * tr) FROM tr) AS diagonal FROM g3 CROSS JOIN e)""",
            f"beta AS MATERIALIZED (SELECT a.i, a.v - rho * b.v AS beta, c.v AS inv FROM s{p} a JOIN s{p} b ON b.i = a.i AND b.j = {p + 2} JOIN s{p} c ON c.i = a.i AND c.j = a.i CROSS JOIN opt WHERE a.j = {p + 1} AND a.i <= {p})",
            f"""residual AS MATERIALIZED (SELECT model.cell, y - rho * wy - fitted AS e FROM model JOIN (SELECT cell, sum(x * beta) AS fitted FROM long JOIN beta USING (i) GROUP BY cell) f ON f.cell = model.cell CROSS JOIN opt)""",
            "term AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1)) + ") AS t(i, term))",
        ]
    )


def rounded(x: str) -> str:
    return f"round({x}, {SIGNIFICANT}) + 0.0"


def coefficients(names: list[str]) -> str:
    """(term, estimate, se_mle, se_hc1) with rho fixed for the robust errors."""
    p = len(names)
    return f""", meat AS MATERIALIZED (SELECT a.i, b.i AS j, sum(e * e * a.x * b.x) AS v FROM long a JOIN long b USING (cell) JOIN residual USING (cell) WHERE a.i <= {p} AND b.i <= {p} GROUP BY 1, 2),
hc AS (SELECT x.i, sum(x.v * meat.v * y.v) AS v FROM s{p} x JOIN meat ON meat.i = x.j JOIN s{p} y ON y.i = meat.j AND y.j = x.i WHERE x.i <= {p} AND x.j <= {p} GROUP BY 1)
SELECT term, {rounded('beta')} AS estimate, {rounded('sqrt(sse / n * inv)')} AS se_mle, {rounded(f'sqrt(hc.v * n / (n - {p}))')} AS se_hc1 FROM beta JOIN term USING (i) JOIN hc USING (i) CROSS JOIN opt
UNION ALL SELECT 'rho', {rounded('rho')}, {rounded('sqrt(1 / (bend + n / 2.0 * (2 * e11 / sse - (slope / sse) * (slope / sse))))')}, NULL::DOUBLE FROM opt"""


def full_errors(names: list[str]) -> str:
    """(term, estimate, se_full) from the Hessian of rho and beta around the products of the scores."""
    p = len(names)
    q = p + 1
    place = f"CASE WHEN i = {p + 2} THEN 1 ELSE i + 1 END"  # rho first
    return f""", theta AS MATERIALIZED (SELECT 1 AS i, rho AS v FROM opt UNION ALL SELECT i + 1, beta FROM beta),
vv AS MATERIALIZED (SELECT {place} AS i, {place.replace('i ', 'j ').replace('ELSE i', 'ELSE j')} AS j, v FROM products WHERE i <> {p + 1} AND j <> {p + 1}),
vy AS MATERIALIZED (SELECT {place} AS i, v FROM products WHERE i <> {p + 1} AND j = {p + 1}),
g AS MATERIALIZED (SELECT vy.i, vy.v - sum(vv.v * theta.v) AS v FROM vy JOIN vv ON vv.i = vy.i JOIN theta ON theta.i = vv.j GROUP BY vy.i, vy.v),
ss AS MATERIALIZED (SELECT (SELECT v FROM products WHERE i = {p + 1} AND j = {p + 1}) - 2 * (SELECT sum(theta.v * vy.v) FROM theta JOIN vy USING (i)) + (SELECT sum(a.v * vv.v * b.v) FROM theta a JOIN vv ON vv.i = a.i JOIN theta b ON b.i = vv.j) AS s),
minus AS MATERIALIZED (SELECT vv.i, vv.j, n * vv.v / s - 2 * n * a.v * b.v / (s * s) + CASE WHEN vv.i = 1 AND vv.j = 1 THEN bend ELSE 0 END AS v FROM vv JOIN g a ON a.i = vv.i JOIN g b ON b.i = vv.j CROSS JOIN ss CROSS JOIN opt),
{sweeps('minus', q, 'b')},
score AS MATERIALIZED (SELECT cell, {place} AS i, x * e / (s / n) + CASE WHEN i = {p + 2} THEN -series / n ELSE 0 END AS v FROM long JOIN residual USING (cell) CROSS JOIN ss CROSS JOIN opt WHERE i <> {p + 1}),
outer_ AS MATERIALIZED (SELECT a.i, c.i AS j, sum(a.v * c.v) AS v FROM score a JOIN score c USING (cell) GROUP BY 1, 2),
cov AS (SELECT x.i, sum(x.v * outer_.v * y.v) AS v FROM b{q} x JOIN outer_ ON outer_.i = x.j JOIN b{q} y ON y.i = outer_.j AND y.j = x.i GROUP BY 1),
named AS (SELECT 1 AS i, 'rho' AS term UNION ALL SELECT i + 1, term FROM term)
SELECT term, {rounded('theta.v')} AS estimate, {rounded(f'sqrt(cov.v * n / (n - {q}))')} AS se_full FROM theta JOIN named USING (i) JOIN cov USING (i) CROSS JOIN opt"""


def impacts(names: list[str], model: str) -> str:
    """(model, variable, direct, indirect, total)."""
    out = []
    for name in names:
        if name == "intercept" or name.startswith("W_"):
            continue
        i = names.index(name) + 1
        theta = f"(SELECT beta FROM beta WHERE i = {names.index('W_' + name) + 1})" if f"W_{name}" in names else "0.0"
        b = f"(SELECT beta FROM beta WHERE i = {i})"
        direct, total = f"((n + diagonal) / n * {b} + series / n * {theta})", f"(({b} + {theta}) / (1 - rho))"
        out.append(f"SELECT '{model}' AS model, '{name}' AS variable, {rounded(direct)} AS direct, {rounded(f'{total} - {direct}')} AS indirect, {rounded(total)} AS total FROM opt")
    return " " + " UNION ALL ".join(out)


def quality(names: list[str], model: str) -> str:
    """(model, n, logLik, AIC, BIC)."""
    k = len(names) + 2
    return f""", ll AS (SELECT n, (SELECT -sum(power(rho, k) * tr / k) FROM tr) - n / 2.0 * ln(sse / n) - n / 2.0 * ln(2 * pi()) - n / 2.0 AS v FROM opt)
SELECT '{model}' AS model, CAST(n AS BIGINT) AS n, round(v, 4) AS "logLik", round(-2 * v + 2 * {k}, 4) AS "AIC", round(-2 * v + {k} * ln(n), 4) AS "BIC" FROM ll"""
