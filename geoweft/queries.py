"""Queries of the geometry operators over the driver's tables, each with its SQL where SQL can express it.

The SQL is written on its own, not derived from the operators: dense distances, ranks, recursive
sampling, and the interpolation's factorisation spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.geometry import box_distance_max_sq, box_distance_sq, cols, ray_meets_box, squared_distance
from .operators import conditional, fps, gradients, index, interpolate, knn, medoids, mls, ray
from .schema import pack_neighbors
from .sources import tables
from .storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums and exponentials differ in the last place between engines; adding 0 removes the sign of a zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _e(first: int, names: str, extra: str = "") -> str:
    return ", ".join(f"CAST(embedding[{first + i + 1}] AS DOUBLE){extra} AS {n}" for i, n in enumerate(names.split()))


# ---------------------------------------------------------------- shared SQL

POINTS = f"p AS (SELECT label AS b, vec_id AS pid, {_e(0, 'x y z')} FROM embeddings)"
POINTS_2D = f"p AS (SELECT label AS b, vec_id AS pid, {_e(0, 'x y')} FROM embeddings)"
MOVED = f"q AS (SELECT label AS b, vec_id AS qid, {_e(3, 'x y z')} FROM embeddings)"
FEATURES = "f AS (SELECT label AS b, vec_id AS pid, CAST(embedding[9:12] AS DOUBLE[]) AS f FROM embeddings)"
HEADS = "hq AS (SELECT b, pid AS qid, h, x + 0.01 * h AS x, y + 0.01 * h AS y, z + 0.01 * h AS z FROM p, (SELECT unnest([0, 1, 2]) AS h))"
HEAD_FEATURES = "hf AS (SELECT b, pid, h, list_transform(f, lambda v: v * (1 + h)) AS f FROM f, (SELECT unnest([0, 1, 2]) AS h))"


def _knn_sql(k: int, queries: str = "q", keys: str = "b, qid", dims: str = "xyz", name: str = "n") -> str:
    """CTE of the dense k-NN of ``queries`` against p, with coordinates."""
    d2 = " + ".join(f"(q.{a} - p.{a}) * (q.{a} - p.{a})" for a in dims)
    own = ", ".join(f"q.{k_.strip()}" for k_ in keys.split(","))
    n = ", ".join(f"p.{a} AS n{a}" for a in dims)
    q = ", ".join(f"q.{a}" for a in dims)
    return f"""{name}_all AS (SELECT {own}, p.pid, {q}, {n}, {d2} AS dist_sq FROM {queries} q JOIN p ON q.b = p.b),
      {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY dist_sq, pid) AS INTEGER) AS rank FROM {name}_all) WHERE rank <= {k})"""


# ---------------------------------------------------------------- indexing

_BOUNDS = "bd AS (SELECT b, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM p GROUP BY b)"


def _bins(a: str, bits: int, lo: str, hi: str) -> str:
    n = 1 << bits
    return f"CASE WHEN {hi} > {lo} THEN least(CAST(floor(greatest(0.0, least(1.0, ({a} - {lo}) / ({hi} - {lo}))) * {n}) AS BIGINT), {n - 1}) ELSE 0 END"


def _code(bits: int, axes: str) -> str:
    return " + ".join(f"(((i{a} >> {k}) & 1) << {len(axes) * k + j})" for k in range(bits) for j, a in enumerate(axes))


_CODES = f"""{_BOUNDS},
      iv AS (SELECT p.*, {_bins('x', 10, 'lx', 'hx')} AS ix, {_bins('y', 10, 'ly', 'hy')} AS iy, {_bins('z', 10, 'lz', 'hz')} AS iz FROM p JOIN bd USING (b)),
      co AS (SELECT b, pid, x, y, z, {_code(10, 'xyz')} AS code FROM iv),
      od AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY code, pid) - 1 AS leaf_pos FROM co)"""

_META = """sz AS (SELECT b, count(*) AS num_leaves FROM {t} GROUP BY b),
      md AS (SELECT b, num_leaves, CAST(CASE WHEN num_leaves > 1 THEN length(bin(num_leaves - 1)) ELSE 0 END AS INTEGER) AS leaf_level FROM sz),
      me AS (SELECT *, (1 << leaf_level) - num_leaves AS virtual_leaves FROM md)"""

_NODES = """nl AS (SELECT od.*, leaf_level, virtual_leaves, unnest(range(0, leaf_level + 1)) AS level FROM {t} od JOIN me USING (b)),
      nj AS (SELECT *, leaf_pos >> CAST(leaf_level - level AS INTEGER) AS j, virtual_leaves >> CAST(leaf_level - level + 1 AS INTEGER) AS cut FROM nl),
      no AS (SELECT b, CAST(level AS INTEGER) AS level, j, (1 << CAST(level AS INTEGER)) - 1 + j - (2 * any_value(cut) - bit_count(any_value(cut))) AS mem_idx, {boxes} FROM nj GROUP BY b, level, j)"""
_POINT_BOXES = ", ".join(f"{f}({a}) AS {s}_{a}" for s, f in (("lo", "min"), ("hi", "max")) for a in "xyz")


@_query(f"WITH {POINTS} SELECT b, {', '.join(f'{m}({a}) AS {m}_{a}' for m in ('min', 'max') for a in 'xyz')} FROM p GROUP BY b")
def scene_bounds(spark: SparkSession, d: str) -> DataFrame:
    return index.scene_bounds(tables.points(spark, d))


@_query(f"WITH {POINTS}, {_CODES} SELECT b, pid, code, leaf_pos FROM od")
def morton_order(spark: SparkSession, d: str) -> DataFrame:
    return index.morton_order(tables.points(spark, d)).select("b", "pid", "code", "leaf_pos")


@_query(f"WITH {POINTS}, {_CODES}, {_META.format(t='p')}, {_NODES.format(t='od', boxes=_POINT_BOXES)} SELECT * FROM no")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return index.tree_nodes(tables.points(spark, d))


@_query(f"WITH {POINTS}, {_META.format(t='p')} SELECT b, num_leaves, leaf_level, virtual_leaves, 2 * num_leaves - 1 + bit_count(virtual_leaves) AS num_real_nodes, 3 AS dim FROM me")
def tree_metadata(spark: SparkSession, d: str) -> DataFrame:
    return index.tree_metadata(tables.points(spark, d))


@_query(f"""WITH {POINTS}, {_CODES}, {_META.format(t='p')}, {_NODES.format(t='od', boxes=_POINT_BOXES)}
  SELECT a.b, a.mem_idx, coalesce(l.mem_idx, -1) AS left_child_mem, coalesce(r.mem_idx, -1) AS right_child_mem, CASE WHEN a.level = me.leaf_level THEN a.j ELSE -1 END AS mem_to_leaf
  FROM no a JOIN me USING (b) LEFT JOIN no l ON l.b = a.b AND l.level = a.level + 1 AND l.j = 2 * a.j LEFT JOIN no r ON r.b = a.b AND r.level = a.level + 1 AND r.j = 2 * a.j + 1""")
def tree_links(spark: SparkSession, d: str) -> DataFrame:
    return index.tree_links(index.tree_nodes(tables.points(spark, d)))


_TRIANGLES = "tr AS (SELECT 0 AS b, vec_id AS prim_id, " + _e(0, "x0 y0 z0 x1 y1 z1 x2 y2 z2") + " FROM embeddings)"
_SEGMENTS = "sg AS (SELECT 0 AS b, vec_id AS prim_id, " + _e(0, "x0 y0 x1 y1") + " FROM embeddings)"
_BOX = ", ".join(f"least({a}0, {a}1, {a}2) AS lo_{a}, greatest({a}0, {a}1, {a}2) AS hi_{a}, ({a}0 + {a}1 + {a}2) / 3.0 AS {a}" for a in "xyz")


@_query(f"""WITH {_TRIANGLES}, bx AS (SELECT b, prim_id, {_BOX} FROM tr),
  bd AS (SELECT b, {', '.join(f'min(lo_{a}) AS l{a}, max(hi_{a}) AS h{a}' for a in 'xyz')} FROM bx GROUP BY b),
  iv AS (SELECT bx.*, {', '.join(f"{_bins(a, 10, f'l{a}', f'h{a}')} AS i{a}" for a in 'xyz')} FROM bx JOIN bd USING (b)),
  od AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY {_code(10, 'xyz')}, prim_id) - 1 AS leaf_pos FROM iv),
  {_META.format(t='tr')}, {_NODES.format(t='od', boxes=', '.join(f'{f}({s}_{a}) AS {s}_{a}' for s, f in (('lo', 'min'), ('hi', 'max')) for a in 'xyz'))} SELECT * FROM no""")
def primitive_nodes(spark: SparkSession, d: str) -> DataFrame:
    return index.primitive_nodes(tables.primitives(spark, d, "triangle"), "triangle")


# ---------------------------------------------------------------- neighbours and gathers


@_query(f"WITH {POINTS}, {MOVED}, {_knn_sql(8)} SELECT b, qid, rank, pid, dist_sq FROM n")
def knn_ragged(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_join(tables.points(spark, d), tables.points(spark, d, first=3, key="qid"), 8)


@_query(f"WITH {POINTS}, q AS (SELECT b, pid AS qid, x, y, z FROM p), {_knn_sql(8)} SELECT b, qid, rank, pid, dist_sq FROM n")
def knn_self(spark: SparkSession, d: str) -> DataFrame:
    """Each point's neighbours in its own sample, itself first."""
    return knn.knn_join(tables.points(spark, d), tables.points(spark, d, key="qid"), 8)


@_query(f"WITH p0 AS (SELECT 0 AS b, vec_id AS pid, {_e(0, 'x y z')}, {_e(3, 'u v w')} FROM embeddings), p AS (SELECT b, pid, x, y, z FROM p0), q AS (SELECT b, pid AS qid, u AS x, v AS y, w AS z FROM p0), {_knn_sql(16)} SELECT b, qid, rank, pid, dist_sq FROM n")
def knn_single(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_join(tables.points(spark, d, b="0"), tables.points(spark, d, first=3, b="0", key="qid"), 16)


@_query(f"WITH p0 AS (SELECT 0 AS b, vec_id AS pid, {_e(0, 'x y z')}, {_e(3, 'u v w')} FROM embeddings), p AS (SELECT b, pid, x, y, z FROM p0), q AS (SELECT b, pid AS qid, u AS x, v AS y, w AS z FROM p0), {_knn_sql(16)} SELECT b, qid, rank, pid, dist_sq FROM n")
def knn_grid(spark: SparkSession, d: str) -> DataFrame:
    """The certified grid join gives the rows of the dense one."""
    return knn.knn_join(tables.points(spark, d, b="0"), tables.points(spark, d, first=3, b="0", key="qid"), 16, strategy="grid")


@_query(f"WITH p AS (SELECT 0 AS b, p_partkey AS pid, CAST(p_size AS DOUBLE) AS x, CAST(p_size % 5 AS DOUBLE) AS y FROM part), q AS (SELECT b, pid AS qid, x + 0.25 AS x, y FROM p), {_knn_sql(4, dims='xy')} SELECT b, qid, rank, pid, dist_sq FROM n")
def knn_ties_2d(spark: SparkSession, d: str) -> DataFrame:
    points = tables.part_points(spark, d)
    return knn.knn_join(points, points.withColumnRenamed("pid", "qid").withColumn("x", F.col("x") + 0.25), 4)


@_query(f"WITH {POINTS}, {MOVED}, {_knn_sql(4)} SELECT b, qid, rank, pid, dist_sq, nx, ny, nz FROM n")
def knn_positions(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_join(tables.points(spark, d), tables.points(spark, d, first=3, key="qid"), 4, positions=True)


@_query(f"WITH {POINTS}, {MOVED}, {_knn_sql(4)} SELECT n.b, qid, rank, n.pid, dist_sq, s.x AS nx, s.y AS ny, s.z AS nz FROM n JOIN (SELECT label AS b, vec_id AS pid, {_e(3, 'x y z')} FROM embeddings) s ON s.b = n.b AND s.pid = n.pid")
def knn_other_source(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours found in one cloud, positions taken from another."""
    found = knn.knn_join(tables.points(spark, d), tables.points(spark, d, first=3, key="qid"), 4)
    return knn.attach_positions(found, tables.points(spark, d, first=3))


@_query(f"WITH {POINTS}, {MOVED}, {_knn_sql(8)} SELECT b, qid, array_to_string(list(pid ORDER BY rank), ',') AS indices, max(dist_sq) AS far FROM n GROUP BY b, qid")
def knn_packed(spark: SparkSession, d: str) -> DataFrame:
    """One row a query."""
    packed = pack_neighbors(knn_ragged(spark, d))
    return packed.select("b", "qid", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.array_max("distances").alias("far"))


@_query(f"WITH {POINTS}, {HEADS}, {_knn_sql(8, 'hq', 'b, qid, h')} SELECT b, qid, h, rank, pid, dist_sq, nx, ny, nz FROM n")
def displaced_knn(spark: SparkSession, d: str) -> DataFrame:
    points = tables.points(spark, d)
    return knn.displaced_knn(points, tables.with_heads(points.withColumnRenamed("pid", "qid")), 8)


@_query(f"WITH {POINTS}, {FEATURES}, {HEADS}, {HEAD_FEATURES}, {_knn_sql(4, 'hq', 'b, qid, h')} SELECT n.b, n.qid, n.h, n.rank, n.pid, u.c - 1 AS c, n.dist_sq, hf.f[u.c] AS v FROM n JOIN hf ON hf.b = n.b AND hf.pid = n.pid AND hf.h = n.h, (SELECT unnest([1, 2, 3, 4]) AS c) u")
def gather_heads(spark: SparkSession, d: str) -> DataFrame:
    points = tables.points(spark, d)
    found = knn.displaced_knn(points, tables.with_heads(points.withColumnRenamed("pid", "qid")), 4, positions=False)
    return knn.gather_values(found, tables.with_heads(tables.features(spark, d))).select("b", "qid", "h", "rank", "pid", "dist_sq", F.posexplode("f").alias("c", "v"))


@_query(f"WITH {POINTS}, {MOVED}, {FEATURES}, {_knn_sql(4)} SELECT n.b, n.qid, n.rank, n.pid, f.f[1] AS v FROM n JOIN f ON f.b = n.b AND f.pid = n.pid")
def gather_features(spark: SparkSession, d: str) -> DataFrame:
    found = knn.knn_join(tables.points(spark, d), tables.points(spark, d, first=3, key="qid"), 4)
    return knn.gather_values(found, tables.features(spark, d)).select("b", "qid", "rank", "pid", F.col("f")[0].alias("v"))


@_query(f"""WITH {POINTS}, {FEATURES}, {HEADS}, {HEAD_FEATURES}, {_knn_sql(8, 'hq', 'b, qid, h')},
  g AS (SELECT n.b, n.qid, n.h, u.c - 1 AS c, n.dist_sq, hf.f[u.c] AS v, 1 / (n.dist_sq + 1e-12) AS w FROM n JOIN hf ON hf.b = n.b AND hf.pid = n.pid AND hf.h = n.h, (SELECT unnest([1, 2, 3, 4]) AS c) u)
  SELECT b, qid, h, c, round(coalesce(avg(v) FILTER (dist_sq <= 1e-12), sum(w * v) / greatest(sum(w), 1e-12)), 6) + 0.0 AS value FROM g GROUP BY b, qid, h, c""")
def inverse_distance(spark: SparkSession, d: str) -> DataFrame:
    """Head 0 is undisplaced, so its queries are exact hits."""
    points = tables.points(spark, d)
    found = knn.displaced_knn(points, tables.with_heads(points.withColumnRenamed("pid", "qid")), 8, positions=False)
    return _rounded(interpolate.inverse_distance(knn.gather_values(found, tables.with_heads(tables.features(spark, d)))), "value")


# ---------------------------------------------------------------- interpolation


def _mls_sql(k: int, keys: str, on: str, dims: str = "xyz", features: str = "f", n: str = "n") -> str:
    """CTEs w (weights), fx (fits): the factorisation of both attempts, spelled out."""
    size, ks = len(dims) + 1, [x.strip() for x in keys.split(",")]
    phi = ["1.0", *(f"d{a}" for a in dims)]
    sums = ", ".join(f"sum(w * {phi[i]} * {phi[j]}){' + 1e-6' if i == j else ''} AS a{i}{j}" for i in range(size) for j in range(i + 1))
    sums += ", " + ", ".join(f"sum(w * {phi[i]} * v) AS r{i}" for i in range(size))
    sql = f"""w0 AS (SELECT *, {', '.join(f'{a} - n{a} AS d{a}' for a in dims)}, max(CASE WHEN rank = {(k - 1) // 2 + 1} THEN dist_sq END) OVER (PARTITION BY {keys}) AS m2,
        count(*) FILTER (dist_sq <= 1e-12) OVER (PARTITION BY {keys}) AS hits FROM {n}),
      w AS (SELECT *, greatest(m2, 1e-12) AS bw, exp(-dist_sq / (2 * greatest(m2, 1e-12))) AS w FROM w0),
      wf AS (SELECT w.*, u.c - 1 AS c, ff.f[u.c] AS v FROM w JOIN {features} ff ON {on}, (SELECT unnest([1, 2, 3, 4]) AS c) u),
      s0 AS (SELECT {keys}, c, any_value(hits) AS hits, avg(v) FILTER (dist_sq <= 1e-12) AS hm, {sums} FROM wf GROUP BY {keys}, c),
      t0 AS (SELECT *, greatest(1e-5, 1e-4 * ({' + '.join(f'a{i}{i}' for i in range(size))}) / {size}) AS jit FROM s0)"""
    last = "t0"
    for t in range(2):
        for i in range(size):
            for j in range(i + 1):
                jit = " + jit" if t and i == j else ""
                s = f"a{i}{j}{jit}" + "".join(f" - l{t}{i}{m} * l{t}{j}{m}" for m in range(j))
                step = f"c{t}{i}{j}"
                if i == j:
                    floor = f"greatest(1e-12, least(1e-5, 1e-3 * abs(a{i}{i}{jit})))"
                    sql += f", {step} AS (SELECT *, {s} <= {floor} AS bad{t}{i}, sqrt(CASE WHEN {s} <= {floor} THEN {floor} ELSE {s} END) AS l{t}{i}{i} FROM {last})"
                else:
                    sql += f", {step} AS (SELECT *, ({s}) / l{t}{j}{j} AS l{t}{i}{j} FROM {last})"
                last = step
    bad = " OR ".join(f"bad0{i}" for i in range(size))
    sql += f", cl AS (SELECT {', '.join(ks)}, c, hits, hm, {', '.join(f'r{i}' for i in range(size))}, {', '.join(f'CASE WHEN {bad} THEN l1{i}{j} ELSE l0{i}{j} END AS l{i}{j}' for i in range(size) for j in range(i + 1))} FROM {last})"
    return sql + ", " + _solve_sql("cl", "fx", "r", "s", size)


def _solve_sql(source: str, target: str, right: str, left: str, size: int) -> str:
    sql, last = "", source
    for i in range(size):
        s = f"{right}{i}" + "".join(f" - l{i}{j} * {left}y{j}" for j in range(i))
        sql += f"{target}_y{i} AS (SELECT *, ({s}) / greatest(l{i}{i}, 1e-20) AS {left}y{i} FROM {last}), "
        last = f"{target}_y{i}"
    for i in reversed(range(size)):
        s = f"{left}y{i}" + "".join(f" - l{j}{i} * {left}{j}" for j in range(i + 1, size))
        name = target if i == 0 else f"{target}_x{i}"
        sql += f"{name} AS (SELECT *, ({s}) / greatest(l{i}{i}, 1e-20) AS {left}{i} FROM {last})" + (", " if i else "")
        last = name
    return sql


def _value_sql(keys: str, dims: str = "xyz", slopes: bool = True) -> str:
    out = f"SELECT {keys}, c, round(CASE WHEN hits > 0 THEN hm ELSE s0 END, 6) + 0.0 AS value"
    if slopes:
        out += "".join(f", round(CASE WHEN hits > 0 THEN 0.0 ELSE s{i + 1} END, 4) + 0.0 AS slope_{a}" for i, a in enumerate(dims))
    return out


@_query(f"WITH {POINTS}, {MOVED}, {FEATURES}, {_knn_sql(8)}, {_mls_sql(8, 'b, qid', 'ff.b = w.b AND ff.pid = w.pid')} {_value_sql('b, qid')} FROM fx")
def mls_slopes(spark: SparkSession, d: str) -> DataFrame:
    out = mls.mls(tables.points(spark, d), tables.points(spark, d, first=3, key="qid"), tables.features(spark, d), 8, slopes=True)
    return _rounded(_rounded(out, "value"), "slope_x", "slope_y", "slope_z", digits=4)


@_query(f"WITH {POINTS_2D}, q AS (SELECT label AS b, vec_id AS qid, {_e(3, 'x y')} FROM embeddings), {FEATURES}, {_knn_sql(8, dims='xy')}, {_mls_sql(8, 'b, qid', 'ff.b = w.b AND ff.pid = w.pid', 'xy')} {_value_sql('b, qid', slopes=False)} FROM fx")
def mls_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mls.mls(tables.points(spark, d, dims=2), tables.points(spark, d, dims=2, first=3, key="qid"), tables.features(spark, d), 8), "value")


@_query(f"WITH {POINTS}, {FEATURES}, {HEADS}, {HEAD_FEATURES}, {_knn_sql(8, 'hq', 'b, qid, h')}, {_mls_sql(8, 'b, qid, h', 'ff.b = w.b AND ff.pid = w.pid AND ff.h = w.h', features='hf')} {_value_sql('b, qid, h', slopes=False)} FROM fx")
def mls_heads(spark: SparkSession, d: str) -> DataFrame:
    points = tables.points(spark, d)
    return _rounded(mls.mls(points, tables.with_heads(points.withColumnRenamed("pid", "qid")), tables.with_heads(tables.features(spark, d)), 8), "value")


_ROUTED = f"rq AS (SELECT 0 AS b, vec_id AS qid, h, vec_id % 3 = 0 AS route, {_e(3, 'tx ty tz', ' + 0.01 * h')}, {_e(6, 'fx fy fz', ' - 0.01 * h')} FROM embeddings, (SELECT unnest([0, 1]) AS h))"
_BRANCHES = f"""e AS (SELECT CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS b, vec_id AS pid, {_e(0, 'x y z')}, CAST(embedding[9:12] AS DOUBLE[]) AS f FROM embeddings),
  p AS (SELECT b, pid, x, y, z FROM e), hf AS (SELECT b, pid, h, list_transform(f, lambda v: v * (1 + h)) AS f FROM e, (SELECT unnest([0, 1]) AS h)),
  q AS (SELECT CASE WHEN route THEN 1 ELSE 0 END AS b, qid, h, {', '.join(f'CASE WHEN route THEN t{a} ELSE f{a} END AS {a}' for a in 'xyz')} FROM rq)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings").withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    shift = lambda i, s: F.col("embedding")[i].cast("double") + s * 0.01 * F.col("h")
    return e.select(
        F.lit(0).alias("b"), F.col("vec_id").cast("long").alias("qid"), "h", (F.col("vec_id") % 3 == 0).alias("route"),
        *(shift(3 + i, 1).alias(f"t{a}") for i, a in enumerate("xyz")), *(shift(6 + i, -1).alias(f"f{a}") for i, a in enumerate("xyz")),
    )


def _branch(spark: SparkSession, d: str, even: bool) -> tuple[DataFrame, DataFrame]:
    own = F.col("b") % 2 == (0 if even else 1)
    points, features = tables.points(spark, d).filter(own).withColumn("b", F.lit(0)), tables.features(spark, d).filter(own).withColumn("b", F.lit(0))
    return points, tables.with_heads(features, heads=2)


@_query(f"WITH {_ROUTED}, {_BRANCHES}, {_knn_sql(4, 'q', 'b, qid, h')}, {_mls_sql(4, 'b, qid, h', 'ff.b = w.b AND ff.pid = w.pid AND ff.h = w.h', features='hf')} {_value_sql('0 AS b, qid, h', slopes=False)} FROM fx")
def conditional_mls(spark: SparkSession, d: str) -> DataFrame:
    yes, no = _branch(spark, d, True), _branch(spark, d, False)
    return _rounded(conditional.conditional_mls(_routed(spark, d), *yes, *no, 4), "value")


@_query(f"WITH {_ROUTED} SELECT b, qid, h, route, CASE WHEN route THEN tx ELSE fx END AS x, CASE WHEN route THEN ty ELSE fy END AS y, CASE WHEN route THEN tz ELSE fz END AS z FROM rq")
def route_pack(spark: SparkSession, d: str) -> DataFrame:
    return conditional.active_queries(_routed(spark, d), ("x", "y", "z"))


# ---------------------------------------------------------------- sampling

FPS_M = 16
_FPS = f"""WITH RECURSIVE {POINTS}, pn AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY pid) AS i FROM p),
  st AS (
    SELECT 0 AS slot, pn.b, pn.pid, pn.x, pn.y, pn.z, CAST(0 AS INTEGER) AS near, (pn.x - s.x) * (pn.x - s.x) + (pn.y - s.y) * (pn.y - s.y) + (pn.z - s.z) * (pn.z - s.z) AS d, s.pid AS chosen
    FROM pn JOIN (SELECT * FROM pn WHERE i = 1) s ON s.b = pn.b
    UNION ALL
    SELECT slot + 1, b, pid, x, y, z, CASE WHEN nd < d THEN slot + 1 ELSE near END, least(d, nd), cp FROM (
      SELECT *, (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) AS nd FROM (
        SELECT *, first_value(pid) OVER o AS cp, first_value(x) OVER o AS cx, first_value(y) OVER o AS cy, first_value(z) OVER o AS cz
        FROM st WHERE slot < {FPS_M - 1} WINDOW o AS (PARTITION BY b ORDER BY d DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))),
  asg AS (SELECT b, pid, near AS slot, d AS dist_sq FROM st WHERE slot = {FPS_M - 1}),
  anc AS (SELECT DISTINCT b, slot, chosen AS pid FROM st)"""


def _sampled(spark: SparkSession, d: str, **options) -> fps.FPSResult:
    return fps.fps(tables.points(spark, d), FPS_M, **options)


@_query(f"{_FPS}, {_CODES} SELECT anc.b, anc.slot, anc.pid, od.x, od.y, od.z, coalesce(s.r, 0.0) AS radius_sq, CAST(coalesce(s.n, 0) AS INTEGER) AS cnt, CAST(row_number() OVER (PARTITION BY anc.b ORDER BY od.leaf_pos, anc.slot) - 1 AS INTEGER) AS coarse_rank FROM anc JOIN od ON od.b = anc.b AND od.pid = anc.pid LEFT JOIN (SELECT b, slot, count(*) AS n, max(dist_sq) AS r FROM asg GROUP BY b, slot) s ON s.b = anc.b AND s.slot = anc.slot")
def fps_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).anchors


@_query(f"{_FPS} SELECT * FROM asg")
def fps_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).assignment


@_query(f"{_FPS}, {FEATURES} SELECT asg.b, asg.pid, f.f[1] AS v FROM asg JOIN anc ON anc.b = asg.b AND anc.slot = asg.slot JOIN f ON f.b = anc.b AND f.pid = anc.pid")
def fps_upsample(spark: SparkSession, d: str) -> DataFrame:
    return fps.upsample(tables.features(spark, d), _sampled(spark, d)).select("b", "pid", F.col("f")[0].alias("v"))


@_query()
def fps_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Its contract is a set of invariants, which ``fps_approximate_audit`` checks."""
    return _sampled(spark, d, mode="approx_bucketed", bucket_size=16).anchors


@_query(f"WITH {POINTS} SELECT b, {FPS_M} AS anchors, count(*) AS points, 0 AS wrong_distances, 0 AS nearer_anchors, true AS close_to_exact FROM p GROUP BY b")
def fps_approximate_audit(spark: SparkSession, d: str) -> DataFrame:
    """The invariants: distinct anchors, all points assigned to their nearest at its distance, and means of the distances within a quarter of the exact ones."""
    points, exact, found = tables.points(spark, d), _sampled(spark, d), _sampled(spark, d, mode="approx_bucketed", bucket_size=16)
    anchors = found.anchors.groupBy("b").agg(F.count_distinct("pid").cast("int").alias("anchors"))
    wrong = fps.check_assignment(found, points).groupBy("b").agg(F.count(F.lit(1)).cast("int").alias("wrong"))
    all_anchors = found.anchors.select("b", *(F.col(a).alias(f"n{a}") for a in "xyz"))
    nearest = points.join(all_anchors, "b").groupBy("b", "pid").agg(F.min(squared_distance(cols("xyz"), cols("xyz", "n"))).alias("least"))
    nearer = nearest.join(found.assignment, ["b", "pid"]).filter("least < dist_sq").groupBy("b").agg(F.count(F.lit(1)).cast("int").alias("nearer"))
    mean = lambda r, name: r.assignment.groupBy("b").agg(F.count(F.lit(1)).alias("points"), F.avg(F.sqrt("dist_sq")).alias(name))
    out = anchors.join(mean(found, "mean"), "b").join(mean(exact, "least").drop("points"), "b").join(wrong, "b", "left").join(nearer, "b", "left")
    return out.select("b", "anchors", "points", F.coalesce("wrong", F.lit(0)).alias("wrong_distances"), F.coalesce("nearer", F.lit(0)).alias("nearer_anchors"), (F.col("mean") < 1.25 * F.col("least")).alias("close_to_exact"))


# ---------------------------------------------------------------- rays

_EPS = 8 * 1.1920928955078125e-07
_RAYS2 = f"ry AS (SELECT 0 AS b, vec_id AS ray_id, {_e(4, 'ox oy dx dy')} FROM embeddings)"
_RAYS3 = f"ry AS (SELECT 0 AS b, vec_id AS ray_id, {_e(9, 'ox oy oz dx dy dz')} FROM embeddings)"


def _hit_sql(test: str) -> str:
    return f"""{test}, best AS (SELECT ray_id, min(t) AS least FROM ht GROUP BY ray_id),
  pick AS (SELECT ht.ray_id, min(struct_pack(prim_id := prim_id, t := t)) AS g FROM ht JOIN best USING (ray_id) WHERE t <= least + {_EPS!r} * greatest(1.0, abs(least)) GROUP BY ht.ray_id)"""


_SEGMENT_HITS = _hit_sql(f"""pr AS (SELECT *, x1 - x0 AS ex, y1 - y0 AS ey, x0 - ox AS ax, y0 - oy AS ay FROM ry JOIN sg USING (b)),
  de AS (SELECT *, dx * ey - dy * ex AS den, (dx * dx + dy * dy) * (ex * ex + ey * ey) AS sz FROM pr),
  tu AS (SELECT *, (ax * ey - ay * ex) / den AS t, (ax * dy - ay * dx) / den AS u FROM de WHERE sz > 0 AND abs(den) > {_EPS!r} * sqrt(sz)),
  ht AS (SELECT * FROM tu WHERE t >= 1e-7 AND u >= -{_EPS!r} AND u <= 1 + {_EPS!r})""")


@_query(f"WITH {_RAYS2}, {_SEGMENTS}, {_SEGMENT_HITS} SELECT ry.b, ry.ray_id, coalesce(g.prim_id, -1) AS prim_id, round(g.t, 6) + 0.0 AS t, round(ox + g.t * dx, 6) + 0.0 AS px, round(oy + g.t * dy, 6) + 0.0 AS py, g IS NOT NULL AS hit FROM ry LEFT JOIN pick USING (ray_id)")
def rays_segments(spark: SparkSession, d: str) -> DataFrame:
    out = ray.raytrace(tables.rays(spark, d, "segment"), tables.primitives(spark, d, "segment"), "segment")
    return _shown(out, "xy")


def _shown(hits: DataFrame, names: str) -> DataFrame:
    """Misses as nulls, since engines print infinities and NaN in their own ways."""
    return _rounded(hits.withColumns({c: F.when(F.col("hit"), F.col(c)) for c in ("t", *(f"p{a}" for a in names))}), "t", *(f"p{a}" for a in names))


_TRIANGLE_HITS = _hit_sql(f"""pr AS (SELECT *, {', '.join(f'{a}1 - {a}0 AS e{a}, {a}2 - {a}0 AS g{a}, o{a} - {a}0 AS a{a}' for a in 'xyz')} FROM ry JOIN tr USING (b)),
  p1 AS (SELECT *, ey * gz - ez * gy AS nx, ez * gx - ex * gz AS ny, ex * gy - ey * gx AS nz, dy * gz - dz * gy AS hx, dz * gx - dx * gz AS hy, dx * gy - dy * gx AS hz,
    ay * ez - az * ey AS qx, az * ex - ax * ez AS qy, ax * ey - ay * ex AS qz FROM pr),
  p2 AS (SELECT *, ex * hx + ey * hy + ez * hz AS det, (dx * dx + dy * dy + dz * dz) * (nx * nx + ny * ny + nz * nz) AS sz FROM p1),
  tu AS (SELECT *, (ax * hx + ay * hy + az * hz) / det AS u, (dx * qx + dy * qy + dz * qz) / det AS w, (gx * qx + gy * qy + gz * qz) / det AS t FROM p2 WHERE sz > 0 AND abs(det) > {_EPS!r} * sqrt(sz)),
  ht AS (SELECT * FROM tu WHERE t >= 1e-7 AND u >= -{_EPS!r} AND w >= -{_EPS!r} AND u + w <= 1 + {_EPS!r})""")


@_query(f"WITH {_RAYS3}, {_TRIANGLES}, {_TRIANGLE_HITS} SELECT ry.b, ry.ray_id, coalesce(g.prim_id, -1) AS prim_id, round(g.t, 6) + 0.0 AS t, round(ox + g.t * dx, 6) + 0.0 AS px, round(oy + g.t * dy, 6) + 0.0 AS py, round(oz + g.t * dz, 6) + 0.0 AS pz, g IS NOT NULL AS hit FROM ry LEFT JOIN pick USING (ray_id)")
def rays_triangles(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ray.raytrace(tables.rays(spark, d, "triangle"), tables.primitives(spark, d, "triangle"), "triangle"), "xyz")


@_query(f"WITH {_RAYS3}, {_TRIANGLES}, bx AS (SELECT b, {', '.join(f'min(least({a}0, {a}1, {a}2)) / 4 AS lo_{a}, max(greatest({a}0, {a}1, {a}2)) / 4 AS hi_{a}' for a in 'xyz')} FROM tr GROUP BY b), s AS (SELECT ray_id, {', '.join(f'least((lo_{a} - o{a}) / d{a}, (hi_{a} - o{a}) / d{a}) AS n{a}, greatest((lo_{a} - o{a}) / d{a}, (hi_{a} - o{a}) / d{a}) AS f{a}' for a in 'xyz')} FROM ry JOIN bx USING (b)) SELECT ray_id, greatest(nx, ny, nz, 0.0) <= least(fx, fy, fz, 2.0) AS meets FROM s")
def ray_box_slab(spark: SparkSession, d: str) -> DataFrame:
    boxes = index.primitive_boxes(tables.primitives(spark, d, "triangle"), "triangle")
    box = boxes.groupBy("b").agg(*((f(f"{s}_{a}") / 4).alias(f"{s}_{a}") for a in "xyz" for s, f in (("lo", F.min), ("hi", F.max))))
    rays = tables.rays(spark, d, "triangle").join(box, "b")
    v = lambda p: cols("xyz", p)
    return rays.select("ray_id", ray_meets_box(v("o"), v("d"), v("lo_"), v("hi_"), F.lit(0.0), F.lit(2.0)).alias("meets"))


@_query(f"WITH {POINTS}, {_BOUNDS}, {MOVED}, g AS (SELECT q.b, qid, {', '.join(f'greatest(l{a} - {a}, 0.0, {a} - h{a}) AS g{a}, greatest(abs({a} - l{a}), abs(h{a} - {a})) AS f{a}' for a in 'xyz')} FROM q JOIN bd USING (b)) SELECT b, qid, gx * gx + gy * gy + gz * gz AS near_sq, fx * fx + fy * fy + fz * fz AS far_sq FROM g")
def box_distances(spark: SparkSession, d: str) -> DataFrame:
    q = tables.points(spark, d, first=3, key="qid").join(index.scene_bounds(tables.points(spark, d)), "b")
    boxed = [cols("xyz", p) for p in ("", "min_", "max_")]
    return q.select("b", "qid", box_distance_sq(*boxed).alias("near_sq"), box_distance_max_sq(*boxed).alias("far_sq"))


# ---------------------------------------------------------------- gradients and medoids


@_query(f"WITH {POINTS}, {MOVED}, {_knn_sql(4)} SELECT b, pid, 0 AS c, round(sum(1.0 / rank), 6) + 0.0 AS grad FROM n GROUP BY b, pid")
def gather_vjp(spark: SparkSession, d: str) -> DataFrame:
    found = knn_positions(spark, d)
    upstream = found.select("b", "qid", "rank", F.lit(0).alias("c"), (1.0 / F.col("rank")).alias("g"))
    return _rounded(gradients.gather_vjp(found, upstream, ["b", "qid"]), "grad")


_VJP = f"""{_mls_sql(8, 'b, qid', 'ff.b = w.b AND ff.pid = w.pid')}, up AS (SELECT *, 1.0 + c AS u0, 0.5 AS u1, 0.0 AS u2, -0.25 AS u3 FROM fx), {_solve_sql('up', 'gx', 'u', 'g', 4)},
  nb AS (SELECT wf.*, gx.u0, gx.hits AS nh, s1, s2, s3, g1, g2, g3, g0 + dx * g1 + dy * g2 + dz * g3 AS a, v - (s0 + dx * s1 + dy * s2 + dz * s3) AS e FROM wf JOIN gx ON gx.b = wf.b AND gx.qid = wf.qid AND gx.c = wf.c)"""


def _vjp(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points, queries, features = tables.points(spark, d), tables.points(spark, d, first=3, key="qid"), tables.features(spark, d)
    upstream = queries.select("b", "qid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).select(
        "b", "qid", "c", (1.0 + F.col("c")).alias("g0"), F.lit(0.5).alias("g_x"), F.lit(0.0).alias("g_y"), F.lit(-0.25).alias("g_z")
    )
    return gradients.mls_vjp(points, queries, features, upstream, 8)


@_query(f"""WITH {POINTS}, {MOVED}, {FEATURES}, {_knn_sql(8)}, {_VJP},
  sm AS (SELECT b, qid, max(nh) AS nh, max(m2) AS m2, sum(a * e * w * dist_sq / (bw * bw)) AS th, {', '.join(f'sum(w * (e * g{i + 1} - a * s{i + 1}) - a * e * w * d{a} / bw) AS q{a}, max(CASE WHEN rank = 4 THEN d{a} END) AS m{a}' for i, a in enumerate('xyz'))} FROM nb GROUP BY b, qid)
  SELECT b, qid, {', '.join(f'round(CASE WHEN nh > 0 THEN 0.0 ELSE q{a} + (CASE WHEN m2 > 1e-12 THEN th ELSE 0.0 END) * m{a} END, 6) + 0.0 AS g_{a}' for a in 'xyz')} FROM sm""")
def mls_vjp_queries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vjp(spark, d)[0], "g_x", "g_y", "g_z")


@_query(f"""WITH {POINTS}, {MOVED}, {FEATURES}, {_knn_sql(8)}, {_VJP}
  SELECT b, pid, c, round(sum(CASE WHEN nh = 0 THEN w * a WHEN dist_sq <= 1e-12 THEN u0 / nh ELSE 0.0 END), 4) + 0.0 AS grad FROM nb GROUP BY b, pid, c""")
def mls_vjp_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vjp(spark, d)[1], "grad", digits=4)


def _ray_vjp(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    rays, prims = tables.rays(spark, d, kind), tables.primitives(spark, d, kind)
    names = "xy" if kind == "segment" else "xyz"
    hits = ray.raytrace(rays, prims, kind)
    upstream = rays.select("b", "ray_id", F.lit(1.0).alias("gt"), *(F.lit(0.5).alias(f"gp{a}") for a in names))
    return gradients.ray_vjp(rays, prims, hits, upstream, kind)


# a shallow hit makes gradients of any size, so values are compared to six significant digits
def _digits(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.when(F.abs(n) < 1e-9, F.lit("0")).otherwise(F.format_string("%.5e", F.col(n))) for n in names})


def _digits_sql(x: str, name: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-9 THEN '0' ELSE format('{{:.5e}}', {x}) END AS {name}"


_SEGMENT_VJP = f"""{_RAYS2}, {_SEGMENTS}, {_SEGMENT_HITS},
  hh AS (SELECT ry.*, g.prim_id AS pr_id, g.t AS t, x1 - x0 AS ex, y1 - y0 AS ey, x0 - ox AS ax, y0 - oy AS ay FROM ry JOIN pick USING (ray_id) JOIN sg ON sg.prim_id = g.prim_id),
  h2 AS (SELECT *, dx * ey - dy * ex AS den, 1.0 + 0.5 * dx + 0.5 * dy AS tt FROM hh),
  h3 AS (SELECT *, tt / den AS n, -tt * t / den AS c FROM h2)"""


@_query(f"WITH {_SEGMENT_VJP} SELECT ry.b, ry.ray_id, {_digits_sql('coalesce(0.5 - n * ey, 0.0)', 'g_ox')}, {_digits_sql('coalesce(0.5 + n * ex, 0.0)', 'g_oy')}, {_digits_sql('coalesce(t * 0.5 + c * ey, 0.0)', 'g_dx')}, {_digits_sql('coalesce(t * 0.5 - c * ex, 0.0)', 'g_dy')} FROM ry LEFT JOIN (SELECT ray_id, n, c, t, ex, ey FROM h3) USING (ray_id)")
def ray_vjp_rays(spark: SparkSession, d: str) -> DataFrame:
    return _digits(_ray_vjp(spark, d, "segment")[0], "g_ox", "g_oy", "g_dx", "g_dy")


@_query(f"WITH {_SEGMENT_VJP}, g AS (SELECT b, pr_id AS prim_id, n * ey - (-n * ay - c * dy) AS g0x, -n * ex - (n * ax + c * dx) AS g0y, -n * ay - c * dy AS g1x, n * ax + c * dx AS g1y FROM h3) SELECT b, prim_id, round(sum(g0x), 4) + 0.0 AS g_x0, round(sum(g0y), 4) + 0.0 AS g_y0, round(sum(g1x), 4) + 0.0 AS g_x1, round(sum(g1y), 4) + 0.0 AS g_y1 FROM g GROUP BY b, prim_id")
def ray_vjp_segments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ray_vjp(spark, d, "segment")[1], "g_x0", "g_y0", "g_x1", "g_y1", digits=4)


# with n the normal, p the hit point and w = v0 - p: t = n.(v0 - o) / n.d gives dt = (n.dv0 + de1.(e2 x w) + de2.(w x e1)) / n.d
_TRIANGLE_VJP = f"""{_RAYS3}, {_TRIANGLES}, {_TRIANGLE_HITS},
  hh AS (SELECT ry.*, g.prim_id AS pr_id, {', '.join(f'{a}1 - {a}0 AS e{a}, {a}2 - {a}0 AS g{a}, {a}0 - (o{a} + g.t * d{a}) AS w{a}' for a in 'xyz')} FROM ry JOIN pick USING (ray_id) JOIN tr ON tr.prim_id = g.prim_id),
  h2 AS (SELECT *, ey * gz - ez * gy AS nx, ez * gx - ex * gz AS ny, ex * gy - ey * gx AS nz FROM hh),
  h3 AS (SELECT *, (1.0 + 0.5 * dx + 0.5 * dy + 0.5 * dz) / (nx * dx + ny * dy + nz * dz) AS k FROM h2),
  h4 AS (SELECT *, k * (gy * wz - gz * wy) AS ax, k * (gz * wx - gx * wz) AS ay, k * (gx * wy - gy * wx) AS az, k * (wy * ez - wz * ey) AS bx, k * (wz * ex - wx * ez) AS by_, k * (wx * ey - wy * ex) AS bz FROM h3),
  h5 AS (SELECT pr_id, {', '.join(f'k * n{a} - a{a} - {b} AS g0{a}, a{a} AS g1{a}, {b} AS g2{a}' for a, b in zip('xyz', ('bx', 'by_', 'bz')))} FROM h4)"""


@_query(f"WITH {_TRIANGLE_VJP} SELECT 0 AS b, pr_id AS prim_id, {', '.join(f'round(sum(g{v}{a}), 4) + 0.0 AS g_{a}{v}' for v in range(3) for a in 'xyz')} FROM h5 GROUP BY pr_id")
def ray_vjp_triangles(spark: SparkSession, d: str) -> DataFrame:
    names = [f"g_{a}{v}" for v in range(3) for a in "xyz"]
    return _rounded(_ray_vjp(spark, d, "triangle")[1].select("b", "prim_id", *names), *names, digits=4)


@_query(f"""WITH {POINTS}, {_CODES}, mb AS (SELECT *, leaf_pos // 4 AS grp, leaf_pos % 4 AS slot FROM od),
  ce AS (SELECT *, avg(x) OVER g AS cx, avg(y) OVER g AS cy, avg(z) OVER g AS cz, count(*) OVER g AS n FROM mb WINDOW g AS (PARTITION BY b, grp)),
  di AS (SELECT *, CASE WHEN n = 2 THEN 0.0 ELSE (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) END AS dd FROM ce)
  SELECT b, grp, arg_min(pid, struct_pack(d := dd, s := slot)) AS medoid, round(any_value(cx), 6) + 0.0 AS centroid_x, round(any_value(cy), 6) + 0.0 AS centroid_y, round(any_value(cz), 6) + 0.0 AS centroid_z FROM di GROUP BY b, grp""")
def medoids_of_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Groups of four neighbours in Morton order."""
    points = tables.points(spark, d)
    members = index.morton_order(points).select("b", F.expr("leaf_pos div 4").alias("grp"), (F.col("leaf_pos") % 4).alias("slot"), "pid")
    return _rounded(medoids.select_medoids(members, points), "centroid_x", "centroid_y", "centroid_z")


# ---------------------------------------------------------------- public surface


@_query(ORACLE_SQL["knn_ragged"])
def api_sorted_queries(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of an index that is gone by the time they are read; ordering the queries changes no row."""
    with api.BVH(tables.points(spark, d)) as own:
        return materialize(own.knn(tables.points(spark, d, first=3, key="qid"), 8, sort_queries=True), "neighbours")


@_query(ORACLE_SQL["mls_slopes"])
def api_point_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Interpolation over a cloud that is kept for several calls."""
    points = tables.points(spark, d)
    with api.PointGeometry(points) as geometry:
        out = api.mls_interpolate(points, tables.points(spark, d, first=3, key="qid"), tables.features(spark, d), 8, return_grad=True, geometry=geometry)
        return materialize(_rounded(_rounded(out, "value"), "slope_x", "slope_y", "slope_z", digits=4), "values")


def _outcome(call: Callable[[], object]) -> str:
    try:
        call()
    except (RuntimeError, ValueError) as e:
        return str(e)
    return "ok"


@_query("""SELECT * FROM (VALUES ('index', 'live', 'ok'), ('index', 'destroyed', 'Batched BVH handle has been destroyed'), ('index', 'destroyed again', 'ok'),
  ('geometry', 'live', 'ok'), ('geometry', 'other table', 'PointGeometry belongs to a different source table'), ('geometry', 'destroyed', 'PointGeometry has been destroyed'),
  ('rays', 'live', 'ok'), ('rays', 'destroyed', 'RayBVH has been destroyed')) AS t(owner, state, outcome)""")
def api_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What owners of an index say when they are read alive, destroyed, and for another table."""
    points, found = tables.points(spark, d), []
    handle = api.build_bvh(points)
    found.append(("index", "live", _outcome(lambda: handle["points"])))
    api.destroy_bvh(handle)
    found += [("index", "destroyed", _outcome(lambda: handle["points"])), ("index", "destroyed again", _outcome(lambda: api.destroy_bvh(handle)))]
    geometry = api.PointGeometry(points)
    found += [("geometry", "live", _outcome(lambda: geometry.validate(points))), ("geometry", "other table", _outcome(lambda: geometry.validate(tables.points(spark, d))))]
    geometry.destroy()
    found.append(("geometry", "destroyed", _outcome(lambda: geometry.validate(points))))
    rays = api.RayBVH(tables.primitives(spark, d, "triangle"), primitive_type="triangle")
    found.append(("rays", "live", _outcome(lambda: rays.nodes)))
    rays.destroy()
    found.append(("rays", "destroyed", _outcome(lambda: rays.nodes)))
    return spark.createDataFrame(found, "owner string, state string, outcome string")


@_query("SELECT * FROM (VALUES ('k', CAST(4.0 AS DOUBLE)), ('k', 8.0), ('k', 16.0), ('dim', 2.0), ('dim', 3.0)) AS t(name, value)")
def api_constants(spark: SparkSession, d: str) -> DataFrame:
    """The values of k and the dimensions that the public surface takes."""
    return spark.createDataFrame([("k", float(k)) for k in api.SUPPORTED_K] + [("dim", float(n)) for n in api.SUPPORTED_DIMS], "name string, value double")
