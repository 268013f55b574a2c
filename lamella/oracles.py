"""DuckDB SQL with the results of the registered graph queries."""

from __future__ import annotations

import math

from lamella.operators.generate import Planted
from lamella.plans.experiments import REAL
from lamella.plans.methods import METHODS
from lamella.queries import DRAWN, PLANTED, R

_EDGES = """
    seen AS (SELECT DISTINCT event_type AS layer, date_trunc('hour', ts) AS h, user_id AS node FROM events WHERE user_id IS NOT NULL),
    half AS (SELECT a.layer, a.node AS src, b.node AS dst, CAST(count(*) AS DOUBLE) AS weight FROM seen a JOIN seen b ON a.layer = b.layer AND a.h = b.h AND a.node < b.node GROUP BY ALL),
    edges AS MATERIALIZED (SELECT * FROM half UNION ALL SELECT layer, dst, src, weight FROM half),
    nodes AS (SELECT DISTINCT user_id AS node FROM events WHERE user_id IS NOT NULL),
    layers AS (SELECT DISTINCT layer FROM edges),
    part AS (SELECT node, node % 5 AS c FROM nodes),
    size AS (SELECT count(*) AS n FROM nodes),
    own AS (SELECT layer, src AS node, sum(weight) AS deg FROM edges GROUP BY ALL),
    grid AS (SELECT layer, node FROM layers, nodes),
    degs AS MATERIALIZED (SELECT layer, node, coalesce(deg, 0) AS deg FROM grid LEFT JOIN own USING (layer, node))
""".replace("% 5", f"% {R}")
_STATE = """,
    shares AS (SELECT layer, node, c, CASE WHEN sum(deg) OVER x > 0 THEN deg / sum(deg) OVER x ELSE 0 END AS w FROM degs JOIN part USING (node) WINDOW x AS (PARTITION BY layer, c)),
    w0 AS MATERIALIZED (SELECT layer, node, c, CASE WHEN sum(w * w) OVER x > 0 THEN w / sqrt(sum(w * w) OVER x) ELSE 0 END AS w FROM shares WINDOW x AS (PARTITION BY layer, c)),
    s0 AS MATERIALIZED (SELECT e.layer, a.c AS p, b.c AS q, sum(a.w * b.w * e.weight) AS s FROM edges e JOIN w0 a ON a.layer = e.layer AND a.node = e.src JOIN w0 b ON b.layer = e.layer AND b.node = e.dst GROUP BY ALL)
"""
_SWEEP = f""",
    ks AS (SELECT CAST(i AS BIGINT) AS k FROM range({R}) t(i)),
    s1 AS MATERIALIZED (SELECT layers.layer, a.k AS p, b.k AS q, coalesce(s, 0) AS s FROM layers, ks a, ks b LEFT JOIN s0 ON s0.layer = layers.layer AND s0.p = a.k AND s0.q = b.k),
    total AS (SELECT w0.layer, q AS k, sum(w * w * s * s) AS total FROM w0 JOIN s1 ON s1.layer = w0.layer AND s1.p = w0.c GROUP BY ALL),
    pull AS (SELECT e.layer, e.src AS node, s1.q AS k, -4 * sum(e.weight * w * s) AS c0 FROM edges e JOIN w0 ON w0.layer = e.layer AND w0.node = e.dst JOIN s1 ON s1.layer = e.layer AND s1.p = w0.c GROUP BY ALL),
    co AS MATERIALIZED (
        SELECT w0.layer, w0.node, d.p AS k, d.s * d.s AS a4, 2 * (total - w0.w * w0.w * o.s * o.s) AS c1, coalesce(c0, 0) AS c0
        FROM w0 JOIN degs USING (layer, node) JOIN s1 d ON d.layer = w0.layer AND d.p = d.q JOIN s1 o ON o.layer = w0.layer AND o.p = w0.c AND o.q = d.p
        JOIN total t ON t.layer = w0.layer AND t.k = d.p LEFT JOIN pull u ON u.layer = w0.layer AND u.node = w0.node AND u.k = d.p WHERE deg > 0
    )
"""
_SOLVE = """,
    pq AS (SELECT *, CASE WHEN a4 >= 2.5e-13 THEN c1 / (2 * a4) END AS p, CASE WHEN a4 >= 2.5e-13 THEN c0 / (4 * a4) END AS q FROM {src}),
    root AS (
        SELECT *, CASE
            WHEN p IS NULL THEN CASE WHEN c1 > 0 THEN -c0 / (2 * c1) ELSE 0 END
            WHEN 4 * p * p * p + 27 * q * q > 0 THEN cbrt(-q / 2 + sqrt((4 * p * p * p + 27 * q * q) / 108)) + cbrt(-q / 2 - sqrt((4 * p * p * p + 27 * q * q) / 108))
            ELSE 2 * sqrt(-p / 3) * cos(acos(greatest(-1, least(1, -q / 2 * sqrt(-27 / (p * p * p))))) / 3) END AS z FROM pq
    ),
    solved AS MATERIALIZED (SELECT *, CASE WHEN z > 0 AND a4 * z * z * z * z + c1 * z * z + c0 * z < 0 THEN z ELSE 0 END AS x FROM root),
    valued AS MATERIALIZED (SELECT *, a4 * x * x * x * x + c1 * x * x + c0 * x AS f FROM solved),
    costs AS (SELECT node, k, round(sum(f), 9) AS cost FROM valued GROUP BY ALL),
    best AS (SELECT node, k, cost FROM costs QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost, k) = 1),
    moved AS MATERIALIZED (SELECT node, coalesce(k, 0) AS c, coalesce(cost, 0.0) AS cost FROM nodes LEFT JOIN best USING (node))
"""
_BASE = """,
    base AS MATERIALIZED (SELECT layer, node, (node * length(layer) + node // 7) % 4 AS c FROM grid)
"""
_PROFILE = """
    profile AS (SELECT CAST(l_suppkey % 10 AS DOUBLE) AS parameter, l_returnflag AS method, l_linenumber AS seed, avg(l_discount) AS error, avg(l_tax) AS nmi, CASE WHEN l_linenumber <> 3 THEN avg(l_quantity) END AS ari FROM lineitem GROUP BY l_suppkey % 10, l_returnflag, l_linenumber)
"""
_LABELS = "labelled AS (SELECT CASE WHEN c_nationkey <> 7 THEN CAST(c_nationkey % 5 AS BIGINT) END AS a, CAST((c_nationkey + length(c_mktsegment)) % 5 AS BIGINT) AS b FROM customer), t AS MATERIALIZED (SELECT a, b, count(*) AS n FROM labelled WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"
_COUNTS = ", x AS (SELECT a, sum(n) AS n FROM t GROUP BY a), y AS (SELECT b, sum(n) AS n FROM t GROUP BY b), z AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM t)"


def _uniform(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5) / {float(16**12)})"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _g(select: str, more: str = "") -> str:
    return f"WITH {_EDGES}{more} {select}"


_H = f""",
    total_edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM edges GROUP BY ALL),
    h AS MATERIALIZED (SELECT node, k, {_uniform("'h'", "node", "k")} AS value FROM nodes, (SELECT CAST(i AS BIGINT) AS k FROM range({R}) t(i))),
    xh AS MATERIALIZED (SELECT src AS node, k, sum(weight * value) AS value FROM total_edges JOIN h ON h.node = dst GROUP BY ALL)
"""
_STATS = """,
    d AS (SELECT layer, src, CAST(count(*) AS DOUBLE) AS d FROM edges GROUP BY ALL),
    full_d AS (SELECT grid.layer, grid.node, coalesce(d, 0) AS d FROM grid LEFT JOIN d ON d.layer = grid.layer AND d.src = grid.node),
    stats AS MATERIALIZED (
        SELECT layer, sum(d) / 2 AS edges, sum(d) / (count(*) * (count(*) - 1)) AS density, avg(d) AS avg_degree, stddev_samp(d) AS degree_sd,
               CASE WHEN avg(d) > 0 THEN stddev_samp(d) / avg(d) END AS degree_cv, max(d) AS max_degree, avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS isolated_nodes
        FROM full_d GROUP BY layer
    )
"""
_STAT_NAMES = ("edges", "density", "avg_degree", "degree_sd", "degree_cv", "max_degree", "isolated_nodes")
_MOVED = """,
    w1 AS (SELECT m.node, m.c, g.layer, coalesce(v.x, 0) AS w FROM moved m JOIN grid g USING (node) LEFT JOIN valued v ON v.layer = g.layer AND v.node = m.node AND v.k = m.c),
    w2 AS MATERIALIZED (SELECT layer, node, c, CASE WHEN sum(w * w) OVER x > 0 THEN w / sqrt(sum(w * w) OVER x) ELSE 0 END AS w FROM w1 WINDOW x AS (PARTITION BY layer, c)),
    s2 AS (SELECT e.layer, a.c AS p, b.c AS q, sum(a.w * b.w * e.weight) AS s FROM edges e JOIN w2 a ON a.layer = e.layer AND a.node = e.src JOIN w2 b ON b.layer = e.layer AND b.node = e.dst GROUP BY ALL)
"""
_RECON = "SELECT n.layer, norm2, coalesce(s2, 0) AS s2, sqrt(greatest(0, 1e-9 + norm2 - coalesce(s2, 0))) AS error FROM (SELECT layer, sum(weight * weight) AS norm2 FROM edges GROUP BY layer) n LEFT JOIN (SELECT layer, sum(s * s) AS s2 FROM {s} GROUP BY layer) m USING (layer)"


def _planted(s: Planted, name: str = "") -> str:
    """CTEs half{name} (layer, src, dst) with src < dst of a planted graph."""
    size, x = -(-s.n // s.k), name
    u = _uniform(str(s.seed), "'theta'", "node", "layer" if s.theta_by_layer else "0")
    near = f"CASE WHEN node % {size} < {size // 2} THEN 0.15 ELSE 0.8 END"
    t = {"exp": f"-ln({u}) + 0.2", "pow": f"pow({u}, {-1 / 1.5})", "one": "1.0", "two": f"CASE WHEN layer % 2 = 1 THEN {near} ELSE 0.95 - {near} END"}[s.theta]
    block = {
        "same": f"CASE WHEN a.c = b.c THEN {s.p} ELSE {s.q} END",
        "random": f"CASE WHEN a.c = b.c THEN {s.q} + {_uniform(str(s.seed), "'p'", 'a.layer')} * {2 * s.p - s.q} ELSE {s.q} END",
        "core": "CASE WHEN a.c = b.c AND a.c = 0 THEN 1.0 WHEN a.c = b.c THEN 0.05 ELSE 0.5 END",
        "deficient": f"CASE WHEN a.c = b.c AND a.c = (a.layer - 1) % {s.k} THEN {s.p} ELSE {s.q} END",
    }[s.blocks]
    return f"""
        n{x} AS (SELECT i AS node, CAST(i // {size} AS BIGINT) AS c FROM range({s.n}) t(i)),
        raw{x} AS (SELECT layer, node, c, {t} AS t FROM n{x}, (SELECT i + 1 AS layer FROM range({s.layers}) t(i))),
        th{x} AS MATERIALIZED (SELECT layer, node, c, t / avg(t) OVER (PARTITION BY layer, c) AS theta FROM raw{x}),
        own{x} AS (SELECT layer, c, sum(theta) AS t FROM th{x} GROUP BY ALL),
        tot{x} AS (SELECT a.layer, sum(a.t * b.t * {block}) AS total FROM own{x} a JOIN own{x} b ON a.layer = b.layer GROUP BY ALL),
        half{x} AS (
            SELECT a.layer, a.node AS src, b.node AS dst FROM th{x} a JOIN th{x} b ON a.layer = b.layer AND a.node < b.node JOIN tot{x} ON tot{x}.layer = a.layer
            WHERE {_uniform(str(s.seed), "a.layer", "a.node", "b.node")} < least(1.0, a.theta * b.theta * {block} * {s.degree * s.n} / total)
        )
    """


def _elbow(ranked: str, out: str) -> str:
    """CTEs that end with ``out`` (layer, q, base) from ranked values (layer, v, base, i)."""
    sigma = "greatest(e, 0) / nullif(p - 1 - CASE WHEN q < p THEN 1 ELSE 0 END, 0)"
    return f""",
        cum_{out} AS MATERIALIZED (SELECT layer, base, i AS q, count(*) OVER w AS p, sum(v) OVER a AS s, sum(v * v) OVER a AS s2, sum(v) OVER w AS ts, sum(v * v) OVER w AS ts2 FROM {ranked} WINDOW w AS (PARTITION BY layer), a AS (PARTITION BY layer ORDER BY i ROWS UNBOUNDED PRECEDING)),
        spread_{out} AS (SELECT *, s2 - s * s / q + CASE WHEN p > q THEN ts2 - s2 - (ts - s) * (ts - s) / (p - q) ELSE 0 END AS e FROM cum_{out}),
        {out} AS MATERIALIZED (SELECT layer, q, base FROM (SELECT layer, q, base, round(-p / 2.0 * ln({2 * math.pi} * nullif({sigma}, 0)) - e / (2 * nullif({sigma}, 0)), 9) AS l FROM spread_{out}) WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY layer ORDER BY l DESC, q) = 1)"""


_TRADE = """trade AS MATERIALIZED (
        SELECT l_returnflag AS layer, CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_returnflag, c_nationkey, s_nationkey)"""
_DAILY = "seen AS (SELECT DISTINCT date_trunc('hour', ts) AS h, user_id AS node FROM events WHERE user_id IS NOT NULL), half AS (SELECT DISTINCT strftime(a.h, '%Y-%m-%d') AS layer, a.node AS src, b.node AS dst FROM seen a JOIN seen b ON a.h = b.h AND a.node < b.node)"
_COS = "u AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings), sims AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v) / nullif(a.n * b.n, 0), 9) AS sim FROM u a JOIN u b ON a.id <> b.id), near AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims QUALIFY rank <= 20)"

ORACLE_SQL: dict[str, str] = {
    "deg_by_layer": _g(f"SELECT layer, node, {_r('deg')} AS deg FROM degs"),
    "layer_norm": _g(f"SELECT layer, {_r('sqrt(sum(weight * weight))')} AS norm FROM edges GROUP BY layer"),
    "layer_stats": _g("SELECT layer, " + ", ".join(f"{_r(c)} AS {c}" for c in _STAT_NAMES) + " FROM stats", _STATS),
    "layer_summary": _g(" UNION ALL ".join(f"SELECT '{c}' AS statistic, {_r(f'avg({c})')} AS mean, {_r(f'stddev_samp({c})')} AS sd FROM stats" for c in _STAT_NAMES), _STATS),
    "transitivity": _g(
        f"SELECT layer, coalesce(triangles, 0.0) AS triangles, triples, {_r('CASE WHEN triples > 0 THEN 3 * coalesce(triangles, 0) / triples END')} AS clustering FROM triples LEFT JOIN tri USING (layer)",
        """,
        triples AS (SELECT layer, sum(d * (d - 1) / 2) AS triples FROM (SELECT layer, src, CAST(count(*) AS DOUBLE) AS d FROM edges GROUP BY ALL) GROUP BY layer),
        tri AS (SELECT a.layer, CAST(count(*) AS DOUBLE) AS triangles FROM half a JOIN half b ON a.layer = b.layer AND a.dst = b.src JOIN half c ON c.layer = a.layer AND c.src = a.src AND c.dst = b.dst GROUP BY ALL)""",
    ),
    "components": f"""
        WITH RECURSIVE {_DAILY}, nodes AS (SELECT DISTINCT user_id AS node FROM events WHERE user_id IS NOT NULL), layers AS (SELECT DISTINCT layer FROM half),
        two_way AS MATERIALIZED (SELECT * FROM half UNION ALL SELECT layer, dst, src FROM half),
        reach(layer, node, root) AS (SELECT layer, node, node FROM layers, nodes UNION SELECT b.layer, b.dst, r.root FROM reach r JOIN two_way b ON b.layer = r.layer AND b.src = r.node),
        roots AS (SELECT layer, node, min(root) AS root FROM reach GROUP BY ALL)
        SELECT layer, count(DISTINCT root) AS components FROM roots GROUP BY layer
    """,
    "layer_similarity": _g(
        f"SELECT a.layer AS a, b.layer AS b, {_r('1 - (a.n + b.n - 2 * coalesce(m, 0)) / (CAST(size.n AS DOUBLE) * size.n)')} AS similarity FROM counts a JOIN counts b ON a.layer < b.layer CROSS JOIN size LEFT JOIN common ON common.a = a.layer AND common.b = b.layer",
        ", counts AS (SELECT layer, count(*) AS n FROM edges GROUP BY layer), common AS (SELECT x.layer AS a, y.layer AS b, count(*) AS m FROM edges x JOIN edges y ON x.src = y.src AND x.dst = y.dst AND x.layer < y.layer GROUP BY ALL)",
    ),
    "sum_graph": _g(f"SELECT src, dst, {_r('sum(weight)')} AS weight FROM edges GROUP BY src, dst"),
    "mean_graph": _g(f"SELECT src, dst, {_r('sum(weight) / (SELECT count(*) FROM layers)')} AS weight FROM edges GROUP BY src, dst"),
    "symmetrize_binarize": """
        WITH e AS (
            SELECT l_returnflag AS layer, CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
        ), b AS (SELECT layer, src, dst, weight FROM e UNION ALL SELECT layer, dst, src, weight FROM e WHERE src <> dst)
        SELECT layer, src, dst, sum(weight) AS weight, CASE WHEN sum(weight) > 40 AND src <> dst THEN 1.0 ELSE 0.0 END AS heavy FROM b GROUP BY ALL
    """.replace("GROUP BY ALL\n    ", "GROUP BY layer, src, dst\n    "),
    "norm_adj_tau": _g(
        f"SELECT e.layer, src, dst, {_r('weight / (sqrt(a.deg + tau) * sqrt(b.deg + tau))')} AS weight FROM edges e JOIN degs a ON a.layer = e.layer AND a.node = src JOIN degs b ON b.layer = e.layer AND b.node = dst JOIN taus t ON t.layer = e.layer",
        ", taus AS (SELECT layer, avg(deg) AS tau FROM degs GROUP BY layer)",
    ),
    "diag_augmented": _g(f"SELECT layer, node AS src, node AS dst, {_r('deg / ((SELECT n FROM size) - 1)')} AS weight FROM own"),
    "bias_adjusted_square": _g(
        f"SELECT src, dst, {_r('sum(weight)')} AS weight FROM w GROUP BY src, dst HAVING sum(weight) <> 0",
        ", w AS (SELECT a.src, b.dst, 1.0 AS weight FROM edges a JOIN edges b ON a.layer = b.layer AND a.dst = b.src UNION ALL SELECT src, src, -1.0 FROM edges)",
    ),
    "community_mass": _g(f"SELECT layer, c, {_r('sum(deg)')} AS mass FROM own JOIN part USING (node) GROUP BY layer, c"),
    "degree_share": _g(f"SELECT layer, node, c, {_r('w')} AS w FROM shares", _STATE),
    "unit_weights": _g(f"SELECT layer, node, c, {_r('w')} AS w FROM w0", _STATE),
    "block_sum_s": _g(f"SELECT layer, p, q, {_r('s')} AS s FROM s0", _STATE),
    "block_mean_b": _g(f"SELECT layer, p, q, {_r('b')} AS b FROM bm", (_BM := ", cs AS (SELECT c, count(*) AS n FROM part GROUP BY c), bm AS MATERIALIZED (SELECT layer, a.c AS p, b.c AS q, sum(weight) / (any_value(x.n) * any_value(y.n)) AS b FROM edges JOIN part a ON a.node = src JOIN part b ON b.node = dst JOIN cs x ON x.c = a.c JOIN cs y ON y.c = b.c GROUP BY layer, a.c, b.c)")),
    "block_normalized": _g(f"SELECT b.layer, b.p, b.q, {_r('b.b / sqrt(x.b * y.b)')} AS b FROM bm b JOIN bm x ON x.layer = b.layer AND x.p = b.p AND x.q = b.p JOIN bm y ON y.layer = b.layer AND y.p = b.q AND y.q = b.q", _BM),
    "degree_correction": _g(
        f"SELECT t.layer, node, t.c, {_r('theta')} AS theta, {_r('theta * sqrt(coalesce(b, 0))')} AS theta_normalized FROM th t LEFT JOIN bm ON bm.layer = t.layer AND bm.p = t.c AND bm.q = t.c",
        _BM + ", th AS (SELECT layer, node, c, CASE WHEN avg(deg) OVER x > 0 THEN deg / avg(deg) OVER x ELSE 0 END AS theta FROM degs JOIN part USING (node) WINDOW x AS (PARTITION BY layer, c))",
    ),
    "recon_error": _g(f"SELECT layer, {_r('norm2')} AS norm2, {_r('s2')} AS s2, {_r('error')} AS error FROM ({_RECON.format(s='s0')})", _STATE),
    "sweep_coeffs": _g(f"SELECT layer, node, k, {_r('a4')} AS a4, {_r('c1')} AS c1, {_r('c0')} AS c0 FROM co", _STATE + _SWEEP),
    "quartic": _g(f"SELECT layer, node, k, {_r('x')} AS x, {_r('f')} AS f FROM valued", _STATE + _SWEEP + _SOLVE.format(src="co")),
    "sweep_assign": _g(f"SELECT node, c, {_r('cost')} AS cost FROM moved", _STATE + _SWEEP + _SOLVE.format(src="co")),
    "sweep_assign_shared": _g(f"SELECT node, c, {_r('cost')} AS cost FROM moved", _STATE + _SWEEP + ", cs AS (SELECT node, k, sum(a4) AS a4, sum(c1) AS c1, sum(c0) AS c0 FROM co GROUP BY ALL)" + _SOLVE.format(src="cs")),
    "sweep_error": _g(f"SELECT {_r('sqrt(sum(error * error) / sum(norm2))')} AS error FROM ({_RECON.format(s='s2')})", _STATE + _SWEEP + _SOLVE.format(src="co") + _MOVED),
    "modularity": _g(
        f"SELECT layer, c, {_r('own / m - o * i / (m * m)')} AS q FROM (SELECT layer, a.c, sum(CASE WHEN a.c = b.c THEN weight ELSE 0 END) AS own, sum(weight) AS o FROM edges JOIN part a ON a.node = src JOIN part b ON b.node = dst GROUP BY layer, a.c) x JOIN (SELECT layer, c, sum(weight) AS i FROM edges JOIN part ON node = dst GROUP BY layer, c) y USING (layer, c) JOIN (SELECT layer, sum(weight) AS m FROM edges GROUP BY layer) z USING (layer)"
    ),
    "contingency": f"WITH {_LABELS} SELECT a, b, n FROM t",
    "nmi": f"""WITH {_LABELS}{_COUNTS}, e AS (SELECT
        (SELECT sum(t.n / z.n * ln(t.n * z.n / (x.n * y.n))) FROM t JOIN x USING (a) JOIN y USING (b), z) AS mi,
        (SELECT -sum(x.n / z.n * ln(x.n / z.n)) FROM x, z) AS ha, (SELECT -sum(y.n / z.n * ln(y.n / z.n)) FROM y, z) AS hb)
        SELECT {_r('2 * mi / (ha + hb)')} AS nmi, {_r('greatest(0, mi / sqrt(ha * hb))')} AS nmi_geometric FROM e""",
    "ari": f"""WITH {_LABELS}{_COUNTS}, e AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2.0) FROM x) AS i, (SELECT sum(n * (n - 1) / 2.0) FROM y) AS j, (SELECT n * (n - 1) / 2.0 FROM z) AS m)
        SELECT {_r('(ij - i * j / m) / ((i + j) / 2 - i * j / m)')} AS ari FROM e""",
    "misclass": f"""WITH RECURSIVE {_LABELS}, fits(a, used, n) AS (
            SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT)
            UNION ALL SELECT f.a + 1, list_append(f.used, k.k), f.n + coalesce((SELECT t.n FROM t WHERE t.a = f.a + 1 AND t.b = k.k), 0)
            FROM fits f, (SELECT CAST(i AS BIGINT) AS k FROM range(5) r(i)) k WHERE f.a < 4 AND NOT list_contains(f.used, k.k))
        SELECT {_r('1 - max(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM t)')} AS error FROM fits WHERE a = 4""",
    "knn_layer": f"WITH {_COS} SELECT src, dst, rank FROM near",
    "knn_symmetric": f"WITH {_COS}, b AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near) SELECT src, count(*) AS n FROM b GROUP BY src",
    "mean_removed_angle": f"""
        WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS v FROM embeddings)
        SELECT a.vec_id AS a, {_r('acos(greatest(-1, least(1, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))))) / pi()')} AS angle
        FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
    """,
    "coassoc_pairs": _g("SELECT a.node AS src, b.node AS dst, count(*) AS n FROM base a JOIN base b ON a.layer = b.layer AND a.c = b.c AND a.node <= b.node GROUP BY ALL", _BASE),
    "bipartite_wy": _g(f"SELECT a.layer AS pl, a.c AS pc, b.layer AS ql, b.c AS qc, {_r('sum(1.0 / n)')} AS w FROM base a JOIN base b USING (node) JOIN (SELECT node, count(*) AS n FROM base GROUP BY node) d USING (node) GROUP BY a.layer, a.c, b.layer, b.c", _BASE),
    "lap_matvec": _g(
        f"SELECT node, {_r('value - s / sqrt(d)')} AS y FROM x JOIN dd USING (node) JOIN (SELECT a.node, sum(x.value / sqrt(dd.d)) AS s FROM base a JOIN base b ON a.layer = b.layer AND a.c = b.c JOIN x ON x.node = b.node JOIN dd ON dd.node = b.node GROUP BY a.node) USING (node)",
        _BASE + f", x AS (SELECT node, {_uniform(chr(39) + 'x' + chr(39), 'node')} AS value FROM nodes), dd AS (SELECT a.node, count(*) AS d FROM base a JOIN base b ON a.layer = b.layer AND a.c = b.c GROUP BY a.node)",
    ),
    "skinny_product": _g(f"SELECT node, k, {_r('value')} AS value FROM xh", _H),
    "gram_matrix": _g(f"SELECT h.k AS p, xh.k AS q, {_r('sum(h.value * xh.value)')} AS value FROM h JOIN xh USING (node) GROUP BY h.k, xh.k", _H),
    "orth_nnls_assign": _g(
        f"SELECT node, k AS c, {_r('value / n2')} AS w FROM (SELECT node, k, value, n2 FROM xh JOIN (SELECT k, sum(value * value) AS n2 FROM h GROUP BY k) USING (k) QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(value / (sqrt(n2) + 1e-16), 9) DESC, k) = 1)", _H
    ),
    "sspa_pick1": _g(
        f"SELECT node, {_r('part')} AS part FROM (SELECT b.src AS node, round(sum(a.weight * b.weight), 9) AS part FROM total_edges a JOIN total_edges b ON b.dst = a.src WHERE a.dst = (SELECT dst FROM (SELECT dst, round(sum(weight * weight), 9) AS n2 FROM total_edges GROUP BY dst) ORDER BY n2 DESC, dst LIMIT 1) GROUP BY b.src) ORDER BY part DESC, node LIMIT 10", _H
    ),
    "snmtf_iter1": _g(
        f"SELECT h.node, h.k, {_r('h.value * coalesce(n.v, 0) / greatest(coalesce(d.v, 0), 1e-10)')} AS value FROM h LEFT JOIN num n ON n.node = h.node LEFT JOIN (SELECT h.node, sum(h.value * g.g) AS v FROM h JOIN (SELECT h.k, sum(h.value * num.v) AS g FROM h JOIN num USING (node) GROUP BY h.k) g USING (k) GROUP BY h.node) d ON d.node = h.node",
        _H + ", num AS MATERIALIZED (SELECT node, sum(value) AS v FROM xh GROUP BY node)",
    ),
    "elbow": _g(
        f"SELECT layer, q FROM lq WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY layer ORDER BY l DESC, q) = 1",
        f""",
        ranked AS (SELECT layer, deg AS v, row_number() OVER (PARTITION BY layer ORDER BY deg DESC, node) AS i, count(*) OVER (PARTITION BY layer) AS p FROM own),
        cum AS MATERIALIZED (SELECT layer, i AS q, p, sum(v) OVER a AS s, sum(v * v) OVER a AS s2, sum(v) OVER (PARTITION BY layer) AS ts, sum(v * v) OVER (PARTITION BY layer) AS ts2 FROM ranked WINDOW a AS (PARTITION BY layer ORDER BY i ROWS UNBOUNDED PRECEDING)),
        spread AS (SELECT *, s2 - s * s / q + CASE WHEN p > q THEN ts2 - s2 - (ts - s) * (ts - s) / (p - q) ELSE 0 END AS e FROM cum),
        lq AS (SELECT layer, q, round(-p / 2.0 * ln({2 * math.pi} * nullif(greatest(e, 0) / nullif(p - 1 - CASE WHEN q < p THEN 1 ELSE 0 END, 0), 0)) - e / (2 * nullif(greatest(e, 0) / nullif(p - 1 - CASE WHEN q < p THEN 1 ELSE 0 END, 0), 0)), 9) AS l FROM spread)""",
    ),
    "relabel_by_degree": _g("SELECT node, c, rank FROM part JOIN (SELECT c, row_number() OVER (ORDER BY coalesce(sum(d), 0) DESC, c) AS rank FROM part LEFT JOIN (SELECT src AS node, sum(weight) AS d FROM edges GROUP BY src) USING (node) GROUP BY c) USING (c)"),
    "summary_mean_sd": f"WITH {_PROFILE} SELECT parameter, method, " + ", ".join(f"round(round(avg({m}), 4), 6) + 0.0 AS {m}_mean, round(round(stddev_samp({m}), 4), 6) + 0.0 AS {m}_sd" for m in ("error", "nmi", "ari")) + " FROM profile GROUP BY parameter, method",
    "summary_mean_sd_se": f"WITH {_PROFILE} SELECT parameter, method, {_r('avg(ari)')} AS mean, {_r('stddev_samp(ari)')} AS sd, {_r('stddev_samp(ari) / sqrt(count(*))')} AS se FROM profile GROUP BY parameter, method",
    "pivot_methods": f"WITH {_PROFILE}, m AS (SELECT parameter, method, round(avg(error), 6) AS e FROM profile GROUP BY ALL) SELECT parameter, max(e) FILTER (method = 'A') AS \"A\", max(e) FILTER (method = 'N') AS \"N\", max(e) FILTER (method = 'R') AS \"R\" FROM m GROUP BY parameter",
    "melt_methods": f"WITH {_PROFILE} SELECT parameter, method, CAST(seed AS BIGINT) AS seed, 'error' AS metric, round(error, 6) AS value FROM profile UNION ALL SELECT parameter, method, CAST(seed AS BIGINT), 'nmi', round(nmi, 6) FROM profile",
    "best_restart": f"WITH {_PROFILE} SELECT parameter, method, CAST(seed AS BIGINT) AS seed FROM profile QUALIFY row_number() OVER (PARTITION BY parameter, method ORDER BY round(error, 9), seed) = 1",
    "gen_sbm_edges": f"WITH {_planted(Planted(n=90, layers=3))} SELECT CAST(layer AS VARCHAR) AS layer, src, dst FROM half UNION ALL SELECT CAST(layer AS VARCHAR), dst, src FROM half",
    "gen_scenarios": "WITH " + ", ".join(_planted(Planted(n=60, layers=2, **own), f"_{i}") for i, own in enumerate(DRAWN.values())) + " UNION ALL ".join(f"{' ' * (i > 0)} SELECT CAST(layer AS VARCHAR) AS layer, 2 * count(*) AS n, CAST(2 * sum(src * dst) AS BIGINT) AS cells, '{name}' AS scenario FROM half_{i} GROUP BY layer" for i, name in enumerate(DRAWN)),
    "daily_layers": f"WITH {_DAILY} SELECT layer, 2 * count(*) AS n FROM half GROUP BY layer",
    "layer_table": _g(
        "SELECT s.layer, components, printf('%.3f ± %.3f', avg_degree, degree_sd) AS degree, " + _r("CASE WHEN triples > 0 THEN 3 * coalesce(triangles, 0) / triples END") + " AS clustering FROM stats s JOIN comp USING (layer) LEFT JOIN triples USING (layer) LEFT JOIN tri USING (layer)",
        _STATS + """,
        triples AS (SELECT layer, sum(d * (d - 1) / 2) AS triples FROM (SELECT layer, src, CAST(count(*) AS DOUBLE) AS d FROM edges GROUP BY ALL) GROUP BY layer),
        tri AS (SELECT a.layer, CAST(count(*) AS DOUBLE) AS triangles FROM half a JOIN half b ON a.layer = b.layer AND a.dst = b.src JOIN half c ON c.layer = a.layer AND c.src = a.src AND c.dst = b.dst GROUP BY ALL),
        reach(layer, node, root) AS (SELECT layer, node, node FROM grid UNION SELECT e.layer, e.dst, r.root FROM reach r JOIN edges e ON e.layer = r.layer AND e.src = r.node),
        comp AS (SELECT layer, count(DISTINCT root) AS components FROM (SELECT layer, node, min(root) AS root FROM reach GROUP BY ALL) GROUP BY layer)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "fit_parallel": _g(
        f"SELECT CAST(0 AS BIGINT) AS iteration, {_r('any_value(total_error)')} AS error, {_r('sqrt(sum(CASE WHEN w2.c = w0.c THEN (w2.w - w0.w) * (w2.w - w0.w) ELSE w2.w * w2.w + w0.w * w0.w END) / sum(w0.w * w0.w))')} AS z_change, {_r('avg(CASE WHEN w2.c <> w0.c THEN 1.0 ELSE 0.0 END)')} AS frac_changed FROM w2 JOIN w0 USING (layer, node), after",
        _STATE + _SWEEP + _SOLVE.format(src="co") + _MOVED + f", after AS (SELECT sqrt(sum(error * error) / sum(norm2)) AS total_error FROM ({_RECON.format(s='s2')}))",
    ),
    "snmf_step": _g(
        f"SELECT h.node, h.k, {_r('h.value * (0.5 + 0.5 * coalesce(xh.value, 0) / (d.v + 1e-10))')} AS value FROM h LEFT JOIN xh USING (node, k) JOIN (SELECT h.node, g.q AS k, sum(h.value * g.v) AS v FROM h JOIN (SELECT a.k AS p, b.k AS q, sum(a.value * b.value) AS v FROM h a JOIN h b USING (node) GROUP BY a.k, b.k) g ON g.p = h.k GROUP BY h.node, g.q) d ON d.node = h.node AND d.k = h.k",
        _H,
    ),
    "mean_similarity": _g(
        f"SELECT {_r('avg(1 - (a.n + b.n - 2 * coalesce(m, 0)) / (CAST(size.n AS DOUBLE) * size.n))')} AS similarity FROM counts a JOIN counts b ON a.layer < b.layer CROSS JOIN size LEFT JOIN common ON common.a = a.layer AND common.b = b.layer",
        ", counts AS (SELECT layer, count(*) AS n FROM edges GROUP BY layer), common AS (SELECT x.layer AS a, y.layer AS b, count(*) AS m FROM edges x JOIN edges y ON x.src = y.src AND x.dst = y.dst AND x.layer < y.layer GROUP BY ALL)",
    ),
    "upper_weight": _g(f"SELECT layer, {_r('sum(weight)')} AS weight FROM half GROUP BY layer"),
    "block_density": _g(f"SELECT l.layer, x.c AS p, y.c AS q, {_r('coalesce(b, 0)')} AS density FROM layers l JOIN (SELECT DISTINCT c FROM part) x ON true JOIN (SELECT DISTINCT c FROM part) y ON x.c <= y.c LEFT JOIN bm ON bm.layer = l.layer AND bm.p = x.c AND bm.q = y.c", _BM),
    "largest_rows": _g(f"SELECT src AS node, {_r('n2')} AS norm2 FROM (SELECT src, round(sum(weight * weight), 9) AS n2 FROM (SELECT src, dst, sum(weight) AS weight FROM edges GROUP BY ALL) GROUP BY src) ORDER BY n2 DESC, src LIMIT 10"),
    "column_means": _g(
        f"SELECT r.src AS node, {_r('avg(coalesce(w, 0))')} AS mean, {_r('median(coalesce(w, 0))')} AS median FROM (SELECT DISTINCT src FROM t JOIN chosen ON chosen.node = t.dst) r CROSS JOIN chosen LEFT JOIN t ON t.src = r.src AND t.dst = chosen.node GROUP BY r.src",
        ", t AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY ALL), chosen AS (SELECT node FROM nodes WHERE node % 3 = 0)",
    ),
    "expected_adjacency": _g(f"SELECT src, dst, {_r(f'sum(a.value * b.value * CASE WHEN a.k = {R - 1} THEN -1 ELSE 1 END)')} AS weight FROM total_edges JOIN h a ON a.node = src JOIN h b ON b.node = dst AND b.k = a.k GROUP BY src, dst", _H),
    "matrix_distance": _g(
        f"SELECT {_r('sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)))')} AS distance FROM (SELECT * FROM edges WHERE layer = (SELECT min(layer) FROM layers)) a FULL JOIN (SELECT * FROM edges WHERE layer = (SELECT min(layer) FROM layers WHERE layer > (SELECT min(layer) FROM layers))) b ON a.src = b.src AND a.dst = b.dst"
    ),
    "matched_columns": _g(
        f"SELECT k, j, {_r('angle')} AS angle FROM cost JOIN (SELECT x.j AS j0, y.j AS j1, z.j AS j2 FROM cost x, cost y, cost z WHERE x.k = 0 AND y.k = 1 AND z.k = 2 AND x.j <> y.j AND x.j <> z.j AND y.j <> z.j ORDER BY x.angle + y.angle + z.angle LIMIT 1) ON j = CASE k WHEN 0 THEN j0 WHEN 1 THEN j1 ELSE j2 END",
        f""",
        a AS (SELECT node, k, {_uniform("'h'", "node", "k")} AS v FROM nodes, (SELECT CAST(i AS BIGINT) AS k FROM range(3) t(i))),
        b AS (SELECT node, (k + 1) % 3 AS j, v + 0.1 * {_uniform("'e'", "node", "k")} AS v FROM a),
        ca AS (SELECT node, k, v - avg(v) OVER (PARTITION BY k) AS v FROM a), cb AS (SELECT node, j, v - avg(v) OVER (PARTITION BY j) AS v FROM b),
        cost AS MATERIALIZED (SELECT k, j, acos(greatest(-1, least(1, sum(ca.v * cb.v) / sqrt(sum(ca.v * ca.v) * sum(cb.v * cb.v))))) / pi() AS angle FROM ca JOIN cb USING (node) GROUP BY k, j)""",
    ),
    "large_values": _g("SELECT node, " + _r("v") + " AS value FROM x WHERE abs(v) >= (SELECT min(s) FROM (SELECT abs(v) AS s FROM x ORDER BY s DESC LIMIT 10))", f", x AS MATERIALIZED (SELECT node, round({_uniform(chr(39) + 'v' + chr(39), 'node')} - 0.5, 9) AS v FROM nodes)"),
    "parts_of": _g(
        "SELECT node, greatest(v, 0.0) AS positive, greatest(-v, 0.0) + 0.0 AS negative, CASE WHEN node % 3 = 0 OR v / (node % 3) < 1e-6 THEN 1e-6 ELSE v / (node % 3) END AS guarded FROM x",
        f", x AS MATERIALIZED (SELECT node, round({_uniform(chr(39) + 'v' + chr(39), 'node')} - 0.5, 6) AS v FROM nodes)",
    ),
    "elbows": _g(
        "SELECT layer, CAST(1 AS BIGINT) AS number, q FROM f1 UNION ALL SELECT layer, CAST(2 AS BIGINT), q + base FROM f2",
        ", ranked1 AS (SELECT layer, deg AS v, CAST(0 AS BIGINT) AS base, row_number() OVER (PARTITION BY layer ORDER BY deg DESC, node) AS i FROM own)" + _elbow("ranked1", "f1")
        + ", ranked2 AS (SELECT layer, v, q AS base, i - q AS i FROM ranked1 JOIN f1 USING (layer) WHERE i > q)" + _elbow("ranked2", "f2"),
    ),
    "dense_ids": "SELECT dense_rank() OVER (ORDER BY p_name) - 1 AS node_id, p_name AS name FROM (SELECT DISTINCT p_name FROM part)",
    "contact_days": """
        WITH log AS (SELECT strftime(ts, '%Y-%m-%d') AS layer, user_id AS a, user_id // 10 AS b FROM events WHERE user_id IS NOT NULL),
        classes AS (SELECT class, row_number() OVER (ORDER BY class) AS label FROM (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN 'teachers' ELSE 'c' || (id % 4) END AS class FROM (SELECT a AS id FROM log UNION SELECT b FROM log))),
        people AS (SELECT id, label FROM (SELECT DISTINCT id, CASE WHEN id % 4 = 0 THEN 'teachers' ELSE 'c' || (id % 4) END AS class FROM (SELECT a AS id FROM log UNION SELECT b FROM log)) JOIN classes USING (class)),
        pairs AS (SELECT layer, a, b FROM log WHERE a <> b UNION SELECT layer, b, a FROM log WHERE a <> b)
        SELECT layer, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, x.label AS la, y.label AS lb, 1.0 AS weight FROM pairs JOIN people x ON x.id = a JOIN people y ON y.id = b
    """,
    "citation_graph": f"""
        WITH papers AS (SELECT * FROM embeddings WHERE label IN (1, 2, 5)), {_COS.replace("FROM embeddings", "FROM papers").replace("rank <= 20", "rank <= 5")},
        labels AS (SELECT label, row_number() OVER (ORDER BY CAST(label AS VARCHAR)) AS n FROM (SELECT DISTINCT label FROM papers)),
        cites AS (SELECT a.vec_id // 2 AS a, a.vec_id AS b FROM papers a WHERE a.vec_id // 2 IN (SELECT vec_id FROM papers) AND a.vec_id // 2 <> a.vec_id),
        e AS (SELECT 'cites' AS layer, a, b FROM cites UNION SELECT 'cites', b, a FROM cites UNION SELECT 'similar', src, dst FROM near UNION SELECT 'similar', dst, src FROM near)
        SELECT layer, a, b, n AS la, 1.0 AS weight FROM e JOIN papers ON vec_id = a JOIN labels USING (label)
    """,
    "triples_text": f"WITH {_TRADE}, one AS (SELECT CASE layer WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS layer, src, dst FROM trade WHERE src <> dst) SELECT layer, src, dst, 1.0 AS weight FROM one UNION SELECT layer, dst, src, 1.0 FROM one",
    "triplet_cells": f"WITH {_TRADE} SELECT layer, src, dst, weight - 30 AS weight FROM trade WHERE weight > 30 AND src <> dst",
    "known_labels": "SELECT c_custkey AS node, CAST(c_nationkey AS DOUBLE) AS label FROM customer WHERE c_nationkey <> 7",
    "one_layer": f"WITH {_TRADE} SELECT DISTINCT '0' AS layer, src, dst, 1.0 AS weight FROM trade",
    "shared_names": "SELECT c_custkey AS key FROM customer INTERSECT SELECT s_suppkey FROM supplier",
    "column_slices": f"SELECT vec_id, {_r('CAST(embedding[1] AS DOUBLE)')} AS first, {_r('CAST(embedding[-1] AS DOUBLE)')} AS last, {_r('list_sum(CAST(embedding[2:-2] AS DOUBLE[]))')} AS middle FROM embeddings",
    "written_back": f"WITH {_PROFILE} SELECT 'error' AS metric, 3 * count(*) AS n, {_r('3 * sum(round(error, 6))')} AS value FROM profile UNION ALL SELECT 'nmi', 3 * count(*), {_r('3 * sum(round(nmi, 6))')} FROM profile",
    "convergence_stats": f"WITH {_PROFILE} SELECT CAST(seed AS BIGINT) AS iteration, {_r('avg(error)')} AS mean, {_r('stddev_samp(error)')} AS sd, {_r('min(error)')} AS least, {_r('max(error)')} AS most FROM profile GROUP BY seed",
    "final_states": f"WITH {_PROFILE} SELECT CAST(parameter AS BIGINT) AS trial, CAST(max(seed) AS BIGINT) AS iterations, {_r('arg_max(error, seed)')} AS error FROM profile WHERE method = 'R' GROUP BY parameter",
    "results_text": f"WITH {_PROFILE} SELECT method, printf('%.3f ± %.3f', avg(error), stddev_samp(error)) AS error, printf('%.3f ± %.3f', avg(ari), stddev_samp(ari)) AS ari FROM profile GROUP BY method",
    "real_study": "SELECT method, '0.000 ± 0.000' AS error, '1.000 ± 0.000' AS nmi, '1.000 ± 0.000' AS ari FROM (VALUES " + ", ".join(f"('{m}')" for m in REAL) + ") t(method)",
    "convergence_study": "SELECT 'usenc' AS start, CAST(i AS BIGINT) AS trial, 1.0 AS nmi, 1.0 AS ari FROM range(2) t(i)",
    "scalability_study": "SELECT CAST(i AS BIGINT) AS trial, true AS swept, 1.0 AS nmi, 1.0 AS ari FROM range(2) t(i)",
} | {
    name: f"SELECT node, min(node) OVER (PARTITION BY node % {PLANTED}) AS community FROM (SELECT DISTINCT user_id AS node FROM events WHERE user_id IS NOT NULL)"
    for name in ["fit_exact", "fit_shared", "fit_restarts", "consensus_labels", "consensus_matrix_free", *(f"method_{m.replace('-', '_')}" for m in METHODS)]
}
