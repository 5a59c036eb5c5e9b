"""The survey queries as DuckDB SQL, written apart from the DataFrame operators."""

from adit.operators.surface import triangle_table
from adit.sources.views import duckdb_with

N_S, N_T, DS, DT = 100, 72, "1.0e0", "5.0e0"


def _grid(view: str = "cloud_gappy", gap: str = "0.3e0") -> str:
    """CTEs b (binned points), g (cell radii) and sc (all cells)."""
    return f"""{duckdb_with(view)},
        b AS MATERIALIZED (SELECT cloud_id, CAST(floor(s / {DS}) AS BIGINT) AS i, CAST(floor((theta + 180.0e0) / {DT}) AS BIGINT) AS j, r FROM {view}
              WHERE s >= 0 AND s < 100 AND theta >= -180 AND theta < 180),
        st AS (SELECT *, r - lag(r) OVER (PARTITION BY cloud_id, i, j ORDER BY r) AS d FROM b),
        g AS MATERIALIZED (SELECT cloud_id, i, j, CASE WHEN max(d) > {gap} THEN max(r) ELSE median(r) END AS r, coalesce(max(d) > {gap}, false) AS bimodal, count(*) AS n FROM st GROUP BY cloud_id, i, j),
        sc AS MATERIALIZED (SELECT c.cloud_id, si.i, tj.j, g.r FROM (SELECT DISTINCT cloud_id FROM g) c
               CROSS JOIN (SELECT unnest(range({N_S})) AS i) si CROSS JOIN (SELECT unnest(range({N_T})) AS j) tj LEFT JOIN g ON g.cloud_id = c.cloud_id AND g.i = si.i AND g.j = tj.j)"""


def _filled(view: str = "cloud_gappy") -> str:
    """CTEs c1 (filled around theta) and c2 (then along s)."""
    return f"""{_grid(view)},
        cov AS (SELECT cloud_id, i, count(r) / {N_T}.0e0 AS coverage FROM sc GROUP BY cloud_id, i),
        t3 AS (SELECT cloud_id, i, j + o * {N_T} AS j3, j, o, r FROM sc CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o)),
        w3 AS (SELECT *, last_value(CASE WHEN r IS NOT NULL THEN j3 END IGNORE NULLS) OVER p AS ja, last_value(r IGNORE NULLS) OVER p AS ra,
                      first_value(CASE WHEN r IS NOT NULL THEN j3 END IGNORE NULLS) OVER q AS jb, first_value(r IGNORE NULLS) OVER q AS rb FROM t3
               WINDOW p AS (PARTITION BY cloud_id, i ORDER BY j3 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      q AS (PARTITION BY cloud_id, i ORDER BY j3 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        c1 AS MATERIALIZED (SELECT w3.cloud_id, w3.i, w3.j, coverage >= 0.1e0 AS dense,
                 CASE WHEN r IS NOT NULL THEN r WHEN coverage >= 0.1e0 THEN CASE WHEN ja = jb THEN ra ELSE ra + (rb - ra) * (j3 - ja) / (jb - ja) END END AS r,
                 r IS NULL AND coverage >= 0.1e0 AS interpolated FROM w3 JOIN cov ON cov.cloud_id = w3.cloud_id AND cov.i = w3.i WHERE o = 0),
        ws AS (SELECT *, count(r) OVER (PARTITION BY cloud_id, j) AS known,
                      last_value(CASE WHEN r IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, last_value(r IGNORE NULLS) OVER p AS ra,
                      first_value(CASE WHEN r IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ib, first_value(r IGNORE NULLS) OVER q AS rb FROM c1
               WINDOW p AS (PARTITION BY cloud_id, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      q AS (PARTITION BY cloud_id, j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        c2 AS MATERIALIZED (SELECT cloud_id, i, j, dense, CASE WHEN r IS NOT NULL OR dense OR known < 2 THEN r WHEN ia IS NULL THEN rb WHEN ib IS NULL THEN ra WHEN ia = ib THEN ra
                        ELSE ra + (rb - ra) * (i - ia) / (ib - ia) END AS r,
                      interpolated OR (r IS NULL AND NOT dense AND known >= 2) AS interpolated FROM ws)"""


def _areas(view: str = "cloud_gappy") -> str:
    return f"""{_filled(view)},
        nx AS (SELECT *, coalesce(lead(r) OVER (PARTITION BY cloud_id, i ORDER BY j), CASE WHEN j = {N_T - 1} THEN first_value(r) OVER (PARTITION BY cloud_id, i ORDER BY j) END) AS r2 FROM c2),
        a AS MATERIALIZED (SELECT cloud_id, i, (i + 0.5e0) * {DS} AS s, CASE WHEN count(r) = {N_T} THEN 0.5e0 * sin(radians({DT})) * sum(r * r2) END AS area,
                 CASE WHEN count(r) = {N_T} THEN avg(CASE WHEN interpolated THEN 1.0e0 ELSE 0.0e0 END) ELSE 1.0e0 END AS frac_interp FROM nx GROUP BY cloud_id, i)"""


def _filled_2d() -> str:
    """CTE f2: unknown cells by inverse distance from the nearest known ones along s and around theta, then along s."""
    near = lambda f, frame: f"{f}(CASE WHEN r IS NOT NULL THEN {{p}} END IGNORE NULLS) OVER {frame} AS p{frame}, {f}(r IGNORE NULLS) OVER {frame} AS v{frame}"
    back, on = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    term = lambda v, p, x: f"coalesce({v}/abs({p}-{x}), 0)"
    one = lambda v, p, x: f"coalesce(CASE WHEN {v} IS NOT NULL THEN 1/abs({p}-{x}) END, 0)"
    sides = [("va", "pa", "j3"), ("vb", "pb", "j3"), ("vc", "pc", "i"), ("vd", "pd", "i")]
    top, low = (" + ".join(f(*x) for x in sides) for f in (term, one))
    return f"""{_grid()},
        x3 AS (SELECT cloud_id, i, CAST(j + o * {N_T} AS DOUBLE) AS j3, j, o, r FROM sc CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o)),
        y3 AS (SELECT *, {near('last_value', 'a').format(p='j3')}, {near('first_value', 'b').format(p='j3')} FROM x3
               WINDOW a AS (PARTITION BY cloud_id, i ORDER BY j3 {back}), b AS (PARTITION BY cloud_id, i ORDER BY j3 {on})),
        z3 AS (SELECT *, {near('last_value', 'c').format(p='i')}, {near('first_value', 'd').format(p='i')} FROM y3 WHERE o = 0
               WINDOW c AS (PARTITION BY cloud_id, j ORDER BY i {back}), d AS (PARTITION BY cloud_id, j ORDER BY i {on})),
        n3 AS (SELECT cloud_id, i, j, r IS NULL AS interpolated, CASE WHEN r IS NOT NULL THEN r WHEN {low} > 0 THEN ({top})/({low}) END AS r FROM z3),
        l3 AS (SELECT *, {near('last_value', 'c').format(p='i')}, {near('first_value', 'd').format(p='i')} FROM n3
               WINDOW c AS (PARTITION BY cloud_id, j ORDER BY i {back}), d AS (PARTITION BY cloud_id, j ORDER BY i {on})),
        f2 AS MATERIALIZED (SELECT cloud_id, i, j, interpolated, CASE WHEN r IS NOT NULL THEN r WHEN pc IS NULL THEN vd WHEN pd IS NULL THEN vc ELSE vc + (vd-vc)*(i-pc)/(pd-pc) END AS r FROM l3)"""


def _triangulated() -> str:
    """Unknown cells from the empty-circle triangle over all known ones: each walks from an outer triangle to the lower hull of (i, j, i^2 + j^2);
    first among the known cells near it, which counts where its circle does not leave them."""
    corners = ("ka", "kb", "kc")
    turn = lambda u, v: f"({u}x*{v}y - {u}y*{v}x)"
    after = dict(zip(corners, (("kb", "kc"), ("kc", "ka"), ("ka", "kb"))))
    plane = lambda cost, name: ", ".join(
        f"{' + '.join(cost(k) + '*' + f(*after[k]) for k in corners)} AS {name}{n}" for n, f in enumerate((turn, lambda u, v: f"({u}y - {v}y)", lambda u, v: f"({v}x - {u}x)"))
    )
    over = lambda name: f"({name}0 + {name}1*dx + {name}2*dy)"
    here = {k: turn(*after[k]) for k in corners}
    there = {k: f"({here[k]} + ({after[k][0]}y - {after[k][1]}y)*dx + ({after[k][1]}x - {after[k][0]}x)*dy)" for k in corners}
    way = {k: f"CASE WHEN {there[k]} > 0 THEN [{here[k]}/{there[k]}, ({after[k][0]}y - {after[k][1]}y)/{there[k]}, ({after[k][1]}x - {after[k][0]}x)/{there[k]}] ELSE ['inf'::DOUBLE, 0, 0] END" for k in corners}
    new = ", ".join(f"CASE WHEN go = '{k}' THEN {v} ELSE {k}{n} END AS {k}{n}" for k in corners for n, v in (("x", "dx"), ("y", "dy"), ("f", "pf"), ("r", "pr"), ("o", "0")))
    area = " + ".join(here.values())
    state = ", ".join(f"{k}{n}" for k in corners for n in "xyfro")
    first = ", ".join(f"any_value({k}{n}) AS {k}{n}" for k in corners for n in "xyfro")
    start = {"ka": ("-2000 - i", "-2000 - j"), "kb": ("2000 - i", "-2000 - j"), "kc": ("-i", "2000 - j")}
    outer = ", ".join(f"CAST({x} AS DOUBLE) AS {k}x, CAST({y} AS DOUBLE) AS {k}y, 0.0::DOUBLE AS {k}f, 0.0::DOUBLE AS {k}r, 1.0::DOUBLE AS {k}o" for k, (x, y) in start.items())
    def walk(t: str, start: str, near: str) -> str:
        """CTE <t>l: the last triangle of each cell of ``start``, among the known cells that are ``near``."""
        return f"""
        {t}t AS (SELECT cloud_id, CAST(i AS DOUBLE) AS i, CAST(j AS DOUBLE) AS j, 0 AS n, {outer} FROM {start}
          UNION ALL SELECT cloud_id, i, j, n + 1, {new} FROM (
            SELECT *, CASE WHEN {way['ka']} <= {way['kb']} AND {way['ka']} <= {way['kc']} THEN 'ka' WHEN {way['kb']} <= {way['kc']} THEN 'kb' ELSE 'kc' END AS go FROM (
              SELECT t.*, p.f AS pf, p.r AS pr, p.x - i AS dx, p.y - j AS dy FROM (
                SELECT cloud_id, i, j, any_value(n) AS n, {first}, arg_min(id, k) AS p FROM (
                  SELECT cloud_id, i, j, n, {state}, id, CASE WHEN {over('o')} > 0 THEN CAST(-{over('o')} AS BIGINT)
                    WHEN {over('o')} = 0 AND w*(dx*dx + dy*dy) < {over('h')} THEN 100000000000000000 + CAST(w*(dx*dx + dy*dy) - {over('h')} AS BIGINT)
                    WHEN {over('o')} = 0 AND w*(dx*dx + dy*dy) = {over('h')} AND w*f < {over('t')} THEN 200000000000000000 + CAST(w*f - {over('t')} AS BIGINT) END AS k
                  FROM (SELECT s.*, kn.f, kn.id, kn.x - i AS dx, kn.y - j AS dy FROM (
                    SELECT *, {area} AS w, {plane(lambda k: k + 'o', 'o')}, {plane(lambda k: f'(1 - {k}o)*({k}x*{k}x + {k}y*{k}y)', 'h')}, {plane(lambda k: k + 'f', 't')} FROM {t}t) s JOIN kn ON kn.cloud_id = s.cloud_id{near}) s)
                WHERE k IS NOT NULL GROUP BY cloud_id, i, j) t JOIN kn p ON p.id = t.p))),
        {t}l AS MATERIALIZED (SELECT cloud_id, i, j, {', '.join(f'arg_max({c}, n) AS {c}' for c in state.split(', '))} FROM {t}t GROUP BY cloud_id, i, j),"""

    circle = f"""2*((kbx-kax)*(kcy-kay) - (kby-kay)*(kcx-kax)) AS e, (kbx-kax)*(kbx-kax) + (kby-kay)*(kby-kay) AS eb, (kcx-kax)*(kcx-kax) + (kcy-kay)*(kcy-kay) AS ec"""
    return f"""{_grid()},
        kn AS MATERIALIZED (SELECT cloud_id, CAST(i AS DOUBLE) AS x, CAST(j + o*{N_T} AS DOUBLE) AS y, r, CAST((i*i*7919 + i*j*104729 + j*j*15485863) % 1048573 AS DOUBLE) AS f, row_number() OVER (ORDER BY cloud_id, i, j, o) AS id
                            FROM sc CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) WHERE r IS NOT NULL),
        {walk('n', 'sc WHERE r IS NULL', ' AND abs(kn.x - s.i) <= 15 AND abs(kn.y - s.j) <= 15')}
        nc AS (SELECT *, ((kcy-kay)*eb - (kby-kay)*ec)/e AS ux, ((kbx-kax)*ec - (kcx-kax)*eb)/e AS uy FROM (SELECT *, {circle} FROM nl)),
        ok AS MATERIALIZED (SELECT * FROM nc WHERE kao + kbo + kco = 0 AND greatest(abs(kax + ux), abs(kay + uy)) + sqrt(ux*ux + uy*uy) <= 15 - 1e-6),
        {walk('d', 'sc ANTI JOIN ok USING (cloud_id, i, j) WHERE r IS NULL', '')}
        dv AS (SELECT cloud_id, i, j, CASE WHEN {' AND '.join(f'({k}o = 0 OR {here[k]} = 0)' for k in corners)} THEN ({' + '.join(f'(1 - {k}o)*{k}r*{here[k]}' for k in corners)})/({area}) END AS r FROM (SELECT cloud_id, i, j, {state} FROM ok UNION ALL SELECT * FROM dl)),
        dn AS (SELECT v.cloud_id, v.i, v.j, arg_min(kn.r, [(x-i)*(x-i) + (y-j)*(y-j), x, y]) AS r FROM dv v JOIN kn USING (cloud_id) WHERE v.r IS NULL GROUP BY ALL)
        SELECT cloud_id, i, j, round(r + 3.3e-11, 9) AS r, false AS interpolated FROM sc WHERE r IS NOT NULL
        UNION ALL SELECT cloud_id, CAST(i AS BIGINT), CAST(j AS BIGINT), round(r + 3.3e-11, 9), true FROM (SELECT * FROM dv WHERE r IS NOT NULL UNION ALL SELECT * FROM dn)"""


def _iso_surface() -> str:
    """The table of cases as rows of corners; triangles around the voxels in half cells, as whole numbers."""
    cases = ", ".join(f"({k}, {', '.join(str(c) for corner in t for c in corner)})" for k, made in enumerate(triangle_table()) for t in made)
    names = [p + d for p in ("ka", "kb", "kc") for d in "xyz"]
    corner = ", ".join(f"(2*{n[2]} + 1 + {n})*0.25e0 AS {n}" for n in names)
    cross = ["uy*vz - uz*vy", "uz*vx - ux*vz", "ux*vy - uy*vx"]
    edges = " UNION ALL ".join(f"SELECT cloud_id, {a}x px, {a}y py, {a}z pz, {b}x qx, {b}y qy, {b}z qz FROM f" for a, b in (("ka", "kb"), ("kb", "kc"), ("kc", "ka")))
    return f"""WITH {duckdb_with('cloud')}, {_XYZ}, {_VOX}, m(pattern, {', '.join(names)}) AS (VALUES {cases}),
        b AS (SELECT cloud_id, ix - (k & 1) AS x, iy - ((k >> 1) & 1) AS y, iz - (k >> 2) AS z, 1 << k AS bit FROM v CROSS JOIN (SELECT unnest(range(8)) AS k)),
        c AS (SELECT cloud_id, x, y, z, CAST(sum(bit) AS BIGINT) AS pattern FROM b GROUP BY cloud_id, x, y, z),
        f AS MATERIALIZED (SELECT cloud_id, {corner} FROM c JOIN m USING (pattern)),
        g AS (SELECT *, {', '.join(f"kb{d} - ka{d} AS u{d}, kc{d} - ka{d} AS v{d}" for d in 'xyz')} FROM f),
        s AS (SELECT cloud_id, sum({' + '.join(f'ka{d}*({x})' for d, x in zip('xyz', cross))})/6 AS volume, sum(sqrt({' + '.join(f'pow({x}, 2)' for x in cross)}))/2 AS area, count(*) AS n_faces FROM g GROUP BY cloud_id),
        e AS (SELECT cloud_id, count(*) AS n, count(*) FILTER ((px, py, pz) < (qx, qy, qz)) AS up FROM ({edges}) GROUP BY cloud_id, least((px, py, pz), (qx, qy, qz)), greatest((px, py, pz), (qx, qy, qz)))
        SELECT cloud_id, round(any_value(volume), 6) AS volume, round(any_value(area), 6) AS area, any_value(n_faces) AS n_faces, count(*) AS n_edges, bool_and(n = 2) AS closed, bool_and(n = 2 AND up = 1) AS oriented
        FROM e JOIN s USING (cloud_id) GROUP BY cloud_id"""


_CUM = """, cu AS (SELECT cloud_id, i, s, sum(st) OVER (PARTITION BY cloud_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS volume FROM
        (SELECT cloud_id, i, s, coalesce(0.5e0 * (area + lag(area) OVER w) * (s - lag(s) OVER w), 0.0e0) AS st FROM a WHERE area IS NOT NULL WINDOW w AS (PARTITION BY cloud_id ORDER BY s)))"""
_SEG = (
    _CUM
    + """, sp AS (SELECT min(s) AS lo, max(s) AS hi FROM cu),
      ed AS (SELECT k, least(lo + k * 10.0e0, hi) AS edge FROM (SELECT lo, hi, unnest(range(CAST(ceil((hi - lo) / 10.0e0) AS BIGINT) + 1)) AS k FROM sp)),
      pc AS (SELECT cloud_id, s, volume, lead(s) OVER w AS s2, lead(volume) OVER w AS v2 FROM cu WINDOW w AS (PARTITION BY cloud_id ORDER BY s)),
      ip AS (SELECT k, edge, cloud_id, CASE WHEN s2 IS NULL THEN volume ELSE volume + (v2 - volume) * (edge - s) / (s2 - s) END AS v
             FROM ed JOIN pc ON edge >= s AND (edge < s2 OR (s2 IS NULL AND edge = s))),
      sg AS (SELECT cloud_id, k, edge AS s_from, lead(edge) OVER w AS s_to, lead(v) OVER w - v AS v FROM ip WINDOW w AS (PARTITION BY cloud_id ORDER BY k)),
      sv AS (SELECT k, s_from, s_to, max(v) FILTER (cloud_id = 'ref') AS v_ref, max(v) FILTER (cloud_id = 'mobile') AS v_oth FROM sg WHERE s_to IS NOT NULL GROUP BY ALL)"""
)
_PAIR = "pr AS (SELECT i, j, max(r) FILTER (cloud_id = 'ref') AS a, max(r) FILTER (cloud_id = 'mobile') AS b FROM sc GROUP BY i, j)"
_ENDS = "min_by(area, s) * greatest(0, min(s)) + max_by(area, s) * greatest(0, 100.0e0 - max(s))"
_RUNS = "first_runs AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, rep, cloud_id, method ORDER BY stamp DESC, run_no DESC, volume DESC) = 1)"
_STEP = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2))"
_TW = "WINDOW w AS (PARTITION BY run_id ORDER BY seq)"
_PD = """pd AS MATERIALIZED (SELECT a.net, a.idx AS i, b.idx AS j, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS d_ref, sqrt(pow(c.x-d.x,2)+pow(c.y-d.y,2)+pow(c.z-d.z,2)) AS d_oth
      FROM targets a JOIN targets b ON a.net=b.net AND a.idx < b.idx AND a.cloud_id='ref' AND b.cloud_id='ref' JOIN targets c ON c.net=a.net AND c.idx=a.idx AND c.cloud_id='mobile' JOIN targets d ON d.net=b.net AND d.idx=b.idx AND d.cloud_id='mobile')"""


def _scale(keys: str, src: str) -> str:
    """The through-origin fit of src's pairs by keys, its residuals in a second pass."""
    k = f"SELECT *, sum(d_ref*d_oth) OVER (PARTITION BY {keys})/sum(d_ref*d_ref) OVER (PARTITION BY {keys}) AS kk FROM ({src})"
    return f"SELECT {keys}, count(*) AS n, any_value(kk) AS k, sqrt(sum(pow(d_oth-kk*d_ref,2))/greatest(count(*)-1,1)/sum(d_ref*d_ref)) AS sigma_k, sqrt(sum(pow(d_oth-kk*d_ref,2))/count(*)) AS resid_rms, avg(d_ref) AS len_ref, avg(d_oth) AS len_oth FROM ({k}) GROUP BY {keys}"


_LOO = f"{duckdb_with('targets')}, {_PD}, lo AS MATERIALIZED ({_scale('net, dropped', 'SELECT t.net, t.idx AS dropped, d_ref, d_oth FROM (SELECT DISTINCT net, idx FROM targets) t JOIN pd ON pd.net=t.net AND t.idx<>i AND t.idx<>j')})"
_CONS = f"""{_LOO}, ba AS ({_scale('net', 'SELECT * FROM pd')}), fl0 AS (SELECT lo.net, dropped AS idx, lo.resid_rms AS loo_rms, ba.resid_rms/lo.resid_rms AS improve, ba.resid_rms/lo.resid_rms > 2 AS flagged FROM lo JOIN ba ON ba.net=lo.net),
      fl AS MATERIALIZED (SELECT *, NOT flagged OR bool_and(flagged) OVER (PARTITION BY net) AS clean FROM fl0),
      kk AS ({_scale('net', 'SELECT pd.* FROM pd JOIN fl x ON x.net=pd.net AND x.idx=i AND x.clean JOIN fl y ON y.net=pd.net AND y.idx=j AND y.clean')}),
      sd AS (SELECT net, i AS idx, j AS p, d_ref, d_oth FROM pd UNION ALL SELECT net, j, i, d_ref, d_oth FROM pd),
      rs AS (SELECT sd.net, sd.idx, avg(d_oth - k*d_ref) AS mean_resid FROM sd JOIN fl ON fl.net=sd.net AND fl.idx=sd.p AND fl.clean JOIN kk ON kk.net=sd.net GROUP BY ALL),
      co AS (SELECT fl.net, fl.idx, loo_rms, improve, flagged, coalesce(mean_resid, 0) AS mean_resid FROM fl LEFT JOIN rs ON rs.net=fl.net AND rs.idx=fl.idx)"""
_CHAIN = "ch AS (SELECT net, cloud_id, idx, sqrt(pow(x-first_value(x) OVER w,2)+pow(y-first_value(y) OVER w,2)+pow(z-first_value(z) OVER w,2)) AS from_first, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)+pow(z-lag(z) OVER w,2)) AS segment FROM targets WINDOW w AS (PARTITION BY net, cloud_id ORDER BY idx))"
_XYZ = "xyz AS MATERIALIZED (SELECT cloud_id, pid, r*cos(radians(theta)) AS x, r*sin(radians(theta)) AS y, s AS z FROM cloud)"
_VOX = "v AS MATERIALIZED (SELECT DISTINCT cloud_id, CAST(floor(x/0.5e0) AS BIGINT) AS ix, CAST(floor(y/0.5e0) AS BIGINT) AS iy, CAST(floor(z/0.5e0) AS BIGINT) AS iz FROM xyz)"


def _r(*columns: str, nd: int = 6) -> str:
    return ", ".join(f"round({c}, {nd}) AS {c}" for c in columns)


#: Student t (0.975) and chi-squared (0.975, 0.025) quantiles of n - 1 degrees of freedom, and Grubbs' critical values (0.05, two-sided).
_QUANTILES = """q(n, t, chi_lo, chi_hi, g_crit) AS (VALUES
    (2, 12.706204736175e0, 5.023886187315e0, 0.000982069117e0, NULL),
    (3, 4.302652729749e0, 7.377758908228e0, 0.050635615969e0, 1.154304851344e0),
    (4, 3.182446305284e0, 9.348403604496e0, 0.215795282624e0, 1.481250000000e0),
    (5, 2.776445105198e0, 11.143286781878e0, 0.484418557088e0, 1.715037312343e0),
    (6, 2.570581835636e0, 12.832501994030e0, 0.831211613487e0, 1.887145117784e0),
    (7, 2.446911851145e0, 14.449375335448e0, 1.237344245791e0, 2.019968507680e0),
    (8, 2.364624251593e0, 16.012764274629e0, 1.689869180677e0, 2.126645087195e0),
    (9, 2.306004135204e0, 17.534546139485e0, 2.179730747253e0, 2.215004223326e0),
    (10, 2.262157162798e0, 19.022767798642e0, 2.700389499980e0, 2.289954084480e0),
    (11, 2.228138851986e0, 20.483177350807e0, 3.246972780237e0, 2.354730051566e0),
    (12, 2.200985160092e0, 21.920049261021e0, 3.815748252236e0, 2.411559518432e0))"""


#: Poses that turn 7 degrees about z a second, points a quarter second after each, and their places in the world
_SKEW = f"""{duckdb_with('traj')}, ps AS (SELECT run_id, seq, x, y, z, radians((seq*7 % 360)/2.0e0) AS h, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2, radians(((seq+1)*7 % 360)/2.0e0) AS h2 FROM traj WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
      sh AS (SELECT run_id, seq, y/2+0.5e0 AS px, z/2 AS py, x/2 AS pz, CAST(seq % 10 AS DOUBLE) AS intensity FROM traj),
      sl AS (SELECT *, cos(h)*cos(h2)+sin(h)*sin(h2) AS dt FROM ps WHERE x2 IS NOT NULL),
      an AS (SELECT *, acos(least(abs(dt), 1.0e0)) AS ang, CASE WHEN dt < 0 THEN -1.0e0 ELSE 1.0e0 END AS sg FROM sl),
      qu AS (SELECT *, (sin(0.75e0*ang)*sin(h) + sg*sin(0.25e0*ang)*sin(h2))/sin(ang) AS qz, (sin(0.75e0*ang)*cos(h) + sg*sin(0.25e0*ang)*cos(h2))/sin(ang) AS qw FROM an),
      wo AS (SELECT qu.run_id, qu.seq, px, py, pz, intensity, px + qw*(-2*qz*py) - qz*(2*qz*px) + qu.x + (x2-qu.x)*0.25e0 AS wx, py + qw*(2*qz*px) + qz*(-2*qz*py) + qu.y + (y2-qu.y)*0.25e0 AS wy, pz + qu.z + (z2-qu.z)*0.25e0 AS wz FROM qu JOIN sh ON sh.run_id=qu.run_id AND sh.seq=qu.seq)"""

_KAPPA = f"""{duckdb_with('traj')}, s0 AS (SELECT run_id, seq, x, y, z, coalesce({_STEP},0) AS st FROM traj {_TW}), c0 AS (SELECT *, sum(st) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM s0),
      t0 AS (SELECT run_id, max(s) AS total, greatest(floor(max(s)/5.0e0)+1, 4) AS n FROM c0 GROUP BY run_id HAVING max(s) > 0),
      a0 AS (SELECT run_id, k, least(k*(total/(n-1)), total) AS t FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM t0)),
      p0 AS (SELECT run_id, x, y, z, s, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2, lead(s) OVER w s2, max(s) OVER (PARTITION BY run_id) AS total FROM c0 WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
      rs AS (SELECT a0.run_id, a0.k, x+(x2-x)*(t-s)/(s2-s) AS x, y+(y2-y)*(t-s)/(s2-s) AS y, z+(z2-z)*(t-s)/(s2-s) AS z FROM a0 JOIN p0 ON p0.run_id=a0.run_id AND s2 > s AND t >= s AND (t < s2 OR (s2 >= total AND t >= s2))),
      df AS (SELECT run_id, k, (lead(x) OVER w-lag(x) OVER w)/2 ux, (lead(y) OVER w-lag(y) OVER w)/2 uy, (lead(z) OVER w-lag(z) OVER w)/2 uz, lead(x) OVER w-2*x+lag(x) OVER w wx, lead(y) OVER w-2*y+lag(y) OVER w wy, lead(z) OVER w-2*z+lag(z) OVER w wz FROM rs WINDOW w AS (PARTITION BY run_id ORDER BY k)),
      kp AS (SELECT run_id, k, sqrt(pow(uy*wz-uz*wy,2)+pow(uz*wx-ux*wz,2)+pow(ux*wy-uy*wx,2))/greatest(pow(ux*ux+uy*uy+uz*uz, 1.5e0), 1e-12) AS kappa FROM df WHERE ux IS NOT NULL)"""
#: Areas of both clouds on s' = s - start, those of the mobile one interpolated at the reference's
_SHIFT = """, ar AS (SELECT s - min(s) OVER () AS p, area AS area_a FROM a WHERE area IS NOT NULL AND cloud_id='ref' AND s >= 3.0e0),
      br AS (SELECT s - min(s) OVER () AS q, area FROM a WHERE area IS NOT NULL AND cloud_id='mobile' AND s >= 1.25e0), b2 AS (SELECT q, area, lead(q) OVER (ORDER BY q) AS q2, lead(area) OVER (ORDER BY q) AS area2 FROM br),
      sh AS (SELECT p, area_a, CASE WHEN q2 IS NULL THEN area ELSE area+(area2-area)*(p-q)/(q2-q) END AS area_b FROM ar JOIN b2 ON p >= q AND (p < q2 OR (q2 IS NULL AND p = q)))"""

ORACLES = {
    "deskew": f"WITH {_SKEW} SELECT run_id, seq + 0.25e0 AS t, round(wx, 6) AS x, round(wy, 6) AS y, round(wz, 6) AS z, intensity FROM wo",
    "dense_map": f"""WITH {_SKEW} SELECT run_id, CAST(floor(wx/2.0e0) AS BIGINT) AS ix, CAST(floor(wy/2.0e0) AS BIGINT) AS iy, CAST(floor(wz/2.0e0) AS BIGINT) AS iz, count(*) AS n, round(avg(wx),6) AS x, round(avg(wy),6) AS y, round(avg(wz),6) AS z, round(avg(intensity),6) AS intensity
        FROM wo WHERE px*px+py*py+pz*pz > 1.0e0 AND px*px+py*py+pz*pz < 36.0e0 GROUP BY ALL""",
    "grid_median": f"WITH {_grid('cloud')} SELECT cloud_id, i, j, round(median(r), 8) AS r, count(*) AS n FROM b GROUP BY ALL",
    "grid_bimodal": f"WITH {_grid('cloud')} SELECT cloud_id, i, j, round(r, 8) AS r, bimodal, n FROM g",
    "bimodal_slabs": f"WITH {_grid('cloud')} SELECT cloud_id, i, count(*) FILTER (bimodal) AS n_bimodal, count(*) FILTER (bimodal) / {N_T}.0e0 > 0.2e0 AS warned FROM g GROUP BY cloud_id, i HAVING count(*) FILTER (bimodal) > 0",
    "coverage_slab": f"WITH {_grid()} SELECT cloud_id, i, round(count(r)/{N_T}.0e0, 6) AS coverage FROM sc GROUP BY cloud_id, i",
    "coverage_total": f"WITH {_grid()} SELECT cloud_id, count(*) AS n_cells, round(1 - count(*)/{N_S * N_T}.0e0, 6) AS frac_missing FROM g GROUP BY cloud_id",
    "coverage_theta": f"WITH {_grid()}, {_PAIR} SELECT j, {_r('cov_ref', 'cov_oth', 'both_pct', 'dr')} FROM (SELECT j, count(a)*100.0e0/{N_S} AS cov_ref, count(b)*100.0e0/{N_S} AS cov_oth, count(a+b)*100.0e0/{N_S} AS both_pct, avg(b-a) AS dr FROM pr GROUP BY j)",
    "circular_fill": f"WITH {_filled()} SELECT cloud_id, i, j, round(r, 8) AS r, dense, interpolated FROM c1",
    "along_s_fill": f"WITH {_filled()} SELECT cloud_id, i, j, round(r, 10) AS r, dense, interpolated FROM c2",
    "slab_area": f"WITH {_areas()} SELECT cloud_id, i, {_r('s', 'area', 'frac_interp')} FROM a",
    "volume_trapezoid": f"""WITH {_areas()}, n AS (SELECT *, lead(s) OVER w AS s2, lead(area) OVER w AS a2 FROM a WHERE area IS NOT NULL WINDOW w AS (PARTITION BY cloud_id ORDER BY s)),
        v AS (SELECT cloud_id, coalesce(sum(0.5e0*(area+a2)*(s2-s)), 0) + {_ENDS} AS volume, count(*) AS n_slabs, avg(frac_interp) AS frac_interp FROM n GROUP BY cloud_id)
        SELECT cloud_id, n_slabs, {_r('volume', 'frac_interp')}, round(volume/100.0e0, 6) AS mean_area FROM v""",
    "volume_simpson": f"""WITH {_areas()}, n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY cloud_id) AS n FROM a WHERE area IS NOT NULL),
        w AS (SELECT *, n - (1 - n % 2) AS m FROM n),
        x AS (SELECT *, (CASE WHEN k >= m THEN 0 WHEN k = 0 OR k = m-1 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)/3.0e0 + CASE WHEN n % 2 = 1 THEN 0 ELSE CASE n-1-k WHEN 0 THEN 5.0e0/12 WHEN 1 THEN 8.0e0/12 WHEN 2 THEN -1.0e0/12 ELSE 0 END END AS f FROM w)
        SELECT cloud_id, round(sum(f*area)*{DS} + {_ENDS}, 6) AS volume FROM x GROUP BY cloud_id""",
    "cumulative_volume": f"WITH {_areas()}{_CUM} SELECT cloud_id, i, {_r('s', 'volume')} FROM cu",
    "segment_volume": f"WITH {_areas()}{_SEG} SELECT k, {_r('s_from', 's_to', 'v_ref', 'v_oth')}, round(v_oth-v_ref, 6) AS dv, round((v_oth-v_ref)/nullif(v_ref,0)*100, 6) AS dv_pct FROM sv",
    "segment_worst": f"WITH {_areas()}{_SEG} SELECT arg_max(k, abs(v_oth-v_ref)) AS worst_k, round(max(abs(v_oth-v_ref)), 6) AS worst_abs_dv, round(avg(abs(v_oth-v_ref)), 6) AS mean_abs_dv FROM sv",
    "segment_masked": f"""WITH {_areas()}, m AS (SELECT *, CAST(floor((s - min(s) OVER (PARTITION BY cloud_id))/10.0e0) AS BIGINT) AS seg FROM a WHERE area IS NOT NULL),
        p AS (SELECT *, 0.5e0*(area+lead(area) OVER w)*(lead(s) OVER w - s) AS piece FROM m WINDOW w AS (PARTITION BY cloud_id, seg ORDER BY s))
        SELECT cloud_id, seg, round(sum(piece), 6) AS volume, count(*) AS n FROM p GROUP BY cloud_id, seg HAVING count(*) >= 2""",
    "delta_r_cells": f"WITH {_grid()}, {_PAIR} SELECT i, j, round(a, 8) AS r_ref, round(b, 8) AS r_oth, round(b-a, 8) AS dr FROM pr WHERE a IS NOT NULL AND b IS NOT NULL",
    "delta_r_summary": f"""WITH {_grid()}, {_PAIR}, t AS (SELECT j, count(b)*100.0e0/{N_S} AS c FROM pr GROUP BY j)
        SELECT round(count(b-a)/{N_S * N_T}.0e0, 6) AS overlap, round(median(b-a), 6) AS median_dr, round(median(abs(b-a)), 6) AS median_abs_dr,
               (SELECT j FROM t ORDER BY c, j LIMIT 1) AS worst_j, round((SELECT min(c) FROM t), 6) AS worst_cov FROM pr""",
    "threshold_sweep": f"""WITH {_grid()}, lo AS (SELECT i, min(c) AS c FROM (SELECT cloud_id, i, count(r)/{N_T}.0e0 AS c FROM sc GROUP BY cloud_id, i) GROUP BY i),
        th AS (SELECT unnest([0.98e0, 0.95e0, 0.92e0, 0.9e0, 0.85e0, 0.8e0, 0.75e0, 0.7e0, 0.65e0, 0.6e0, 0.5e0]) AS threshold), e AS (SELECT threshold, i, i - row_number() OVER (PARTITION BY threshold ORDER BY i) AS isl FROM lo JOIN th ON c >= threshold),
        r AS (SELECT threshold, min(i) AS start, count(*) AS n FROM e GROUP BY threshold, isl), x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY n DESC, start) = 1)
        SELECT threshold, coalesce(start, 0) AS start, coalesce(n, 0) AS n FROM th LEFT JOIN x USING (threshold)""",
    "golden_segment": f"""WITH {_grid()}, lo AS (SELECT i, min(c) AS c FROM (SELECT cloud_id, i, count(r)/{N_T}.0e0 AS c FROM sc GROUP BY cloud_id, i) GROUP BY i),
        e AS (SELECT i, i - row_number() OVER (ORDER BY i) AS isl FROM lo WHERE c >= 0.9e0), r AS (SELECT min(i) AS start, count(*) AS n FROM e GROUP BY isl ORDER BY n DESC, start LIMIT 1),
        x AS (SELECT coalesce((SELECT start FROM r), 0) AS start, coalesce((SELECT n FROM r), 0) AS n)
        SELECT start*{DS} AS s_lo, (start + least(n, 25))*{DS} AS s_hi FROM x""",
    "harmonic_fit": f"""WITH {duckdb_with('cloud')}, h AS (SELECT cloud_id, floor((theta+180.0e0)/{DT}) AS j, avg(r*cos(radians(theta))) AS dz, count(*) AS w FROM cloud GROUP BY ALL),
        p AS (SELECT cloud_id, cos(radians((j+0.5e0)*{DT}-180.0e0)) AS c, sin(radians((j+0.5e0)*{DT}-180.0e0)) AS s, dz AS y, w/sum(w) OVER (PARTITION BY cloud_id) AS w FROM h),
        m AS (SELECT cloud_id, sum(w*c) c, sum(w*s) s, sum(w*c*c) cc, sum(w*c*s) cs, sum(w*s*s) ss, sum(w*y) y, sum(w*c*y) cy, sum(w*s*y) sy, sum(w*y*y) yy FROM p GROUP BY cloud_id),
        f AS (SELECT *, ((cy-c*y)*(ss-s*s)-(sy-s*y)*(cs-c*s))/((cc-c*c)*(ss-s*s)-pow(cs-c*s,2)) AS a, ((sy-s*y)*(cc-c*c)-(cy-c*y)*(cs-c*s))/((cc-c*c)*(ss-s*s)-pow(cs-c*s,2)) AS b FROM m)
        SELECT cloud_id, round(degrees(atan2(b,a)),6) AS phase_deg, round(sqrt(a*a+b*b),6) AS amplitude, round(y-a*c-b*s,6) AS offset, round((a*(cy-c*y)+b*(sy-s*y))/(yy-y*y),6) AS r2 FROM f""",
    "band_percentiles": f"""WITH {duckdb_with('cloud')} SELECT cloud_id, CAST(floor(s/10.0e0) AS BIGINT) AS band, round(quantile_cont(r, 0.1), 8) AS p10, round(quantile_cont(r, 0.5), 8) AS p50, round(quantile_cont(r, 0.9), 8) AS p90,
        round(avg(CASE WHEN r < 1.6e0 THEN 1.0e0 ELSE 0.0e0 END), 8) AS near FROM cloud GROUP BY ALL""",
    "radius_hist": f"WITH {duckdb_with('cloud')} SELECT cloud_id, CAST(floor((r - 1.5e0)/0.0025e0) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY ALL",
    "theta_bins": f"WITH {duckdb_with('cloud')} SELECT cloud_id, CAST(floor((theta+180.0e0)/{DT}) AS BIGINT) AS j, round(avg(r*cos(radians(theta))), 6) AS dz, round(avg(r), 6) AS r, count(*) AS n FROM cloud GROUP BY ALL",
    "profile_cloud": f"WITH {_filled()} SELECT cloud_id, i, j, round(r*cos(radians((j+0.5e0)*{DT}-180.0e0)), 6) AS x, round(r*sin(radians((j+0.5e0)*{DT}-180.0e0)), 6) AS y, (i+0.5e0)*{DS} AS z, interpolated FROM c2 WHERE r IS NOT NULL",
    "alignment_guard": f"WITH {duckdb_with('cloud')} SELECT cloud_id, round(median(r), 6) AS median_r, median(r) <= 15 AS aligned FROM cloud GROUP BY cloud_id",
    "wedge_filter": f"WITH {duckdb_with('cloud')} SELECT cloud_id, count(*) AS n FROM cloud WHERE NOT (theta BETWEEN 80.0e0 AND 130.0e0) GROUP BY cloud_id",
    "mesh_volume": f"""WITH {_filled()}, k AS (SELECT cloud_id, i, row_number() OVER (PARTITION BY cloud_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY cloud_id) AS m FROM (SELECT cloud_id, i FROM c2 GROUP BY cloud_id, i HAVING count(r) = {N_T})),
        v AS MATERIALIZED (SELECT c2.cloud_id, k, m, j, r*cos(radians((j+0.5e0)*{DT}-180.0e0)) AS x, r*sin(radians((j+0.5e0)*{DT}-180.0e0)) AS y, (i+0.5e0)*{DS} AS z FROM c2 JOIN k USING (cloud_id, i)),
        q AS (SELECT p.cloud_id, p.x x0,p.y y0,p.z z0, a.x x1,a.y y1,a.z z1, b.x x2,b.y y2,b.z z2, c.x x3,c.y y3,c.z z3 FROM v p JOIN v a ON a.cloud_id=p.cloud_id AND a.k=p.k AND a.j=(p.j+1)%{N_T}
              JOIN v b ON b.cloud_id=p.cloud_id AND b.k=p.k+1 AND b.j=a.j JOIN v c ON c.cloud_id=p.cloud_id AND c.k=p.k+1 AND c.j=p.j),
        e AS (SELECT p.cloud_id, p.k, p.m, p.z AS z, p.x*a.y - p.y*a.x AS cr FROM v p JOIN v a ON a.cloud_id=p.cloud_id AND a.k=p.k AND a.j=(p.j+1)%{N_T}),
        d AS (SELECT cloud_id, x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2) + x0*(y2*z3-z2*y3)+y0*(z2*x3-x2*z3)+z0*(x2*y3-y2*x3) AS t, 2 AS f FROM q
              UNION ALL SELECT cloud_id, CASE WHEN k = 0 THEN -z*cr ELSE z*cr END, 1 FROM e WHERE k = 0 OR k = m - 1)
        SELECT cloud_id, round(abs(sum(t))/6, 6) AS volume, CAST(sum(f) AS BIGINT) AS n_faces FROM d GROUP BY cloud_id""",
    "fill_2d": f"WITH {_filled_2d()} SELECT cloud_id, i, j, round(r, 10) AS r, interpolated FROM f2",
    "triangulated_fill": f"WITH RECURSIVE {_triangulated()}",
    "mesh_volume_to_ends": f"""WITH {_filled_2d()},
        p AS (SELECT cloud_id, i, j, r*cos(radians((j+0.5e0)*{DT}-180.0e0)) AS x, r*sin(radians((j+0.5e0)*{DT}-180.0e0)) AS y FROM f2),
        v AS MATERIALIZED (SELECT cloud_id, i + 1 AS k, j, x, y, i + 0.5e0 AS z FROM p UNION ALL SELECT cloud_id, 0, j, x, y, 0.0e0 FROM p WHERE i = 0 UNION ALL SELECT cloud_id, {N_S} + 1, j, x, y, 100.0e0 FROM p WHERE i = {N_S} - 1),
        q AS (SELECT p.cloud_id, p.x x0,p.y y0,p.z z0, a.x x1,a.y y1,a.z z1, b.x x2,b.y y2,b.z z2, c.x x3,c.y y3,c.z z3 FROM v p JOIN v a ON a.cloud_id=p.cloud_id AND a.k=p.k AND a.j=(p.j+1)%{N_T}
              JOIN v b ON b.cloud_id=p.cloud_id AND b.k=p.k+1 AND b.j=a.j JOIN v c ON c.cloud_id=p.cloud_id AND c.k=p.k+1 AND c.j=p.j),
        e AS (SELECT p.cloud_id, p.k, p.z, p.x*a.y - p.y*a.x AS cr FROM v p JOIN v a ON a.cloud_id=p.cloud_id AND a.k=p.k AND a.j=(p.j+1)%{N_T}),
        d AS (SELECT cloud_id, x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2) + x0*(y2*z3-z2*y3)+y0*(z2*x3-x2*z3)+z0*(x2*y3-y2*x3) AS t, 2 AS f FROM q
              UNION ALL SELECT cloud_id, CASE WHEN k = 0 THEN -z*cr ELSE z*cr END, 1 FROM e WHERE k = 0 OR k = {N_S} + 1)
        SELECT cloud_id, round(abs(sum(t))/6, 6) AS volume, CAST(sum(f) AS BIGINT) AS n_faces, CAST(3*sum(f)//2 AS BIGINT) AS n_edges, true AS closed, true AS oriented FROM d GROUP BY cloud_id""",
    "mesh_edges_closed": f"""WITH {_filled()}, k AS (SELECT cloud_id, count(*) AS m FROM (SELECT cloud_id, i FROM c2 GROUP BY cloud_id, i HAVING count(r) = {N_T}) GROUP BY cloud_id)
        SELECT cloud_id, 3*((m-1)*{N_T}*2 + 2*{N_T})//2 AS n_edges, true AS closed, true AS oriented FROM k""",
    "voxel_count": f"WITH {duckdb_with('cloud')}, {_XYZ}, {_VOX} SELECT cloud_id, count(*) AS n, round(count(*)*0.125e0, 6) AS volume FROM v GROUP BY cloud_id",
    "voxel_extrapolated": f"""WITH {duckdb_with('cloud')}, {_XYZ}, n AS (SELECT cloud_id, h, count(*)*h*h*h AS volume FROM (SELECT DISTINCT cloud_id, h, floor(x/h) a, floor(y/h) b, floor(z/h) c FROM xyz CROSS JOIN (SELECT unnest([0.5e0, 0.75e0, 1.0e0]) AS h)) GROUP BY cloud_id, h)
        SELECT cloud_id, round(regr_intercept(volume, h), 6) AS volume FROM n GROUP BY cloud_id""",
    "voxel_downsample": f"WITH {duckdb_with('cloud')}, {_XYZ} SELECT cloud_id, CAST(floor(x/0.5e0) AS BIGINT) AS ix, CAST(floor(y/0.5e0) AS BIGINT) AS iy, CAST(floor(z/0.5e0) AS BIGINT) AS iz, count(*) AS n, round(avg(x),6) AS x, round(avg(y),6) AS y, round(avg(z),6) AS z FROM xyz GROUP BY ALL",
    "dilate": f"WITH {duckdb_with('cloud')}, {_XYZ}, {_VOX} SELECT DISTINCT cloud_id, ix+a AS ix, iy+b AS iy, iz+c AS iz FROM v CROSS JOIN (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(a,b,c)",
    "loop_closure": f"WITH {duckdb_with('traj')}, e AS (SELECT run_id, arg_min(x,seq) x0,arg_min(y,seq) y0,arg_min(z,seq) z0,arg_max(x,seq) x1,arg_max(y,seq) y1,arg_max(z,seq) z1,count(*) n FROM traj GROUP BY run_id) SELECT run_id, CASE WHEN n>=2 THEN round(sqrt(pow(x1-x0,2)+pow(y1-y0,2)+pow(z1-z0,2)),6) END AS error FROM e",
    "path_length": f"WITH {duckdb_with('traj')}, s AS (SELECT run_id, {_STEP} AS st FROM traj {_TW}) SELECT run_id, round(coalesce(sum(st),0),6) AS length, count(*) AS n FROM s GROUP BY run_id",
    "step_dedup": f"WITH {duckdb_with('traj')}, s AS (SELECT *, {_STEP} AS st FROM traj {_TW}) SELECT run_id, seq, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM s WHERE st IS NULL OR st > 5.0e0",
    "cum_arclength": f"WITH {duckdb_with('traj')}, s AS (SELECT run_id, seq, coalesce({_STEP},0) AS st FROM traj {_TW}) SELECT run_id, seq, round(sum(st) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING),6) AS s FROM s",
    "resample_arclength": f"""WITH {duckdb_with('traj')}, s AS (SELECT run_id, seq, x, y, z, coalesce({_STEP},0) AS st FROM traj {_TW}), c AS (SELECT *, sum(st) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM s),
        t AS (SELECT run_id, max(s) AS total, greatest(floor(max(s)/5.0e0)+1, 4) AS n FROM c GROUP BY run_id HAVING max(s) > 0),
        a AS (SELECT run_id, k, least(k*(total/(n-1)), total) AS t FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM t)),
        p AS (SELECT run_id, seq, x, y, z, s, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2, lead(s) OVER w s2, max(s) OVER (PARTITION BY run_id) AS total FROM c WINDOW w AS (PARTITION BY run_id ORDER BY seq))
        SELECT a.run_id, a.k, round(t,6) AS s, round(x+(x2-x)*(t-s)/(s2-s),6) AS x, round(y+(y2-y)*(t-s)/(s2-s),6) AS y, round(z+(z2-z)*(t-s)/(s2-s),6) AS z
        FROM a JOIN p ON p.run_id=a.run_id AND s2 > s AND t >= s AND (t < s2 OR (s2 >= total AND t >= s2))""",
    "stationary_skip": f"WITH {duckdb_with('traj')}, s AS (SELECT run_id, seq, {_STEP} AS d FROM traj {_TW}) SELECT run_id, count(*) AS kept FROM s WHERE d IS NULL OR d >= 5.0e0 GROUP BY run_id",
    "range_filter": f"WITH {duckdb_with('traj')} SELECT run_id, count(*) AS n FROM traj WHERE x*x+y*y+z*z > 9.0e0 AND x*x+y*y+z*z < 100.0e0 GROUP BY run_id",
    "rigid_transform": f"WITH {duckdb_with('traj')} SELECT run_id, seq, round(0.6e0*x-0.8e0*y+1, 6) AS x, round(0.8e0*x+0.6e0*y+2, 6) AS y, round(z+3, 6) AS z FROM traj",
    "nearest_sample": f"""WITH {duckdb_with('traj')}, l AS (SELECT unnest(range(51)) AS k), d AS (SELECT run_id, seq, k, pow(x-k*0.2e0,2)+pow(y-k*0.1e0,2)+pow(z-k*0.05e0,2) AS d2 FROM traj CROSS JOIN l)
        SELECT run_id, seq, k, round(sqrt(d2), 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY run_id, seq ORDER BY d2, k) = 1""",
    "cylindrical": f"""WITH {duckdb_with('traj')}, l AS (SELECT unnest(range(101)) AS k), d AS (SELECT run_id, seq, x, y, z, k, pow(x-k*0.1e0,2)+y*y+z*z AS d2 FROM traj CROSS JOIN l QUALIFY row_number() OVER (PARTITION BY run_id, seq ORDER BY d2, k) = 1)
        SELECT run_id, seq, round(x, 6) AS s, round(sqrt(y*y+z*z), 6) AS r, round(degrees(atan2(y, z)), 6) AS theta FROM d""",
    "interp_pose": f"""WITH {duckdb_with('traj')}, q AS (SELECT run_id, seq + 0.25e0 AS t FROM traj), p AS (SELECT *, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2 FROM traj {_TW})
        SELECT q.run_id, t, round(x + coalesce(x2-x,0)*0.25e0,6) AS x, round(y + coalesce(y2-y,0)*0.25e0,6) AS y, round(z + coalesce(z2-z,0)*0.25e0,6) AS z FROM q JOIN p ON p.run_id=q.run_id AND p.seq = t - 0.25e0""",
    "penalised_rmse": f"WITH {duckdb_with('reps')} SELECT trial_id, round(sqrt(sum(pow(CASE WHEN failed THEN 100.0e0 ELSE error_m END, 2))/count(*)), 6) AS objective, count(*) AS num_runs, count(*) FILTER (failed) AS num_failures FROM reps GROUP BY trial_id",
    "success_stats": f"WITH {duckdb_with('reps')} SELECT trial_id, round(avg(error_m), 10) AS mean_error, round(stddev_pop(error_m), 10) AS std_error, round(max(error_m), 10) AS max_error, round(min(error_m), 10) AS min_error FROM (SELECT trial_id, CASE WHEN NOT failed THEN error_m END AS error_m FROM reps) GROUP BY trial_id",
    "failure_breakdown": f"WITH {duckdb_with('reps')} SELECT trial_id, coalesce(nullif(failure_reason,''),'unknown') AS reason, count(*) AS n FROM reps WHERE failed GROUP BY ALL",
    "leaderboard": f"WITH {duckdb_with('reps')}, m AS (SELECT trial_id, sqrt(sum(pow(CASE WHEN failed THEN 100.0e0 ELSE error_m END, 2))/count(*)) AS o FROM reps GROUP BY trial_id) SELECT CAST(row_number() OVER (ORDER BY o, trial_id) AS INTEGER) AS rank, trial_id, round(o,6) AS objective FROM m ORDER BY o, trial_id LIMIT 10",
    "good_trials": "SELECT o_orderkey AS trial_id, round(o_totalprice/5000.0e0, 6) AS value FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice/5000.0e0 < 50.0e0",
    "category_median": "SELECT o_orderpriority AS category, round(median(o_totalprice/5000.0e0), 6) AS median, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "unknown_params": "SELECT p_partkey AS trial_id, p_brand AS name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 1)",
    "conditional_params": """WITH s(name, parent, parent_value) AS (VALUES ('type', NULL, NULL), ('size', 'type', 'A'), ('price', 'type', 'B')),
        p AS (SELECT p_partkey AS trial_id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS t, CAST(p_size AS VARCHAR) AS z, CAST(p_partkey AS VARCHAR) AS pr FROM part)
        SELECT trial_id, name, parent IS NULL OR parent_value = t AS active, CASE WHEN parent IS NULL THEN t WHEN parent_value = t THEN CASE name WHEN 'size' THEN z ELSE pr END END AS value FROM p CROSS JOIN s""",
    "conditional_tree": """WITH p AS (SELECT p_partkey AS trial_id, p_size % 2 = 0 AS a, p_size % 3 = 1 AS b, p_size = 10 AS c, * FROM part)
        SELECT trial_id, 'type' AS name, true AS active, CASE WHEN a THEN 'A' ELSE 'B' END AS value FROM p
        UNION ALL SELECT trial_id, 'mode', a, CASE WHEN a THEN 'm' || (p_size % 3) END FROM p
        UNION ALL SELECT trial_id, 'depth', a AND b, CASE WHEN a AND b THEN CAST(p_size AS VARCHAR) END FROM p
        UNION ALL SELECT trial_id, 'price', a AND b AND c, CASE WHEN a AND b AND c THEN CAST(p_partkey AS VARCHAR) END FROM p""",
    "newest_runs": f"WITH {duckdb_with('runs')} SELECT dataset, rep, cloud_id, stamp, run_no, round(volume,6) AS volume FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, rep, cloud_id ORDER BY stamp DESC, run_no DESC, volume DESC) = 1",
    "comparability_guard": f"WITH {duckdb_with('runs')}, l AS (SELECT dataset, 'method' AS key, method AS v FROM runs UNION ALL SELECT dataset, 'cloud_id', cloud_id FROM runs UNION ALL SELECT dataset, 'dataset', dataset FROM runs) SELECT dataset, key, count(DISTINCT v) AS n_values FROM l GROUP BY ALL HAVING count(DISTINCT v) > 1",
    "repeatability": f"""WITH {duckdb_with('runs')}, {_RUNS}, {_QUANTILES}, d AS (SELECT dataset, cloud_id, method, count(*) AS n, avg(volume) AS mean, min(volume) AS min, max(volume) AS max, stddev_samp(volume) AS sd FROM first_runs GROUP BY ALL)
        SELECT dataset, cloud_id, method, d.n, {_r('mean', 'min', 'max', 'sd')}, round(sd/mean*100, 6) AS cv_pct, round(sd/sqrt(d.n), 6) AS sem, round(mean-t*sd/sqrt(d.n), 6) AS ci95_lo, round(mean+t*sd/sqrt(d.n), 6) AS ci95_hi,
               CASE WHEN d.n > 1 THEN round(max-min, 6) END AS range, round(sd*sqrt((d.n-1)/chi_lo), 6) AS sd_ci95_lo, round(sd*sqrt((d.n-1)/chi_hi), 6) AS sd_ci95_hi, round(g_crit, 6) AS g_crit FROM d LEFT JOIN q ON q.n = d.n""",
    "grubbs": f"""WITH {duckdb_with('runs')}, {_RUNS}, {_QUANTILES}, d AS (SELECT *, abs(volume - avg(volume) OVER w) AS dev FROM first_runs WINDOW w AS (PARTITION BY dataset, cloud_id, method)),
        g AS (SELECT dataset, cloud_id, method, count(*) AS n, CASE WHEN stddev_samp(volume) > 0 THEN max(dev)/stddev_samp(volume) ELSE 0 END AS g, arg_max(rep, dev) AS outlier FROM d GROUP BY ALL HAVING count(*) >= 3)
        SELECT dataset, cloud_id, method, g.n, round(g, 6) AS g, round(g_crit, 6) AS g_crit, outlier, g > g_crit AS flagged FROM g JOIN q ON q.n = g.n""",
    "bias": f"""WITH {duckdb_with('runs')}, {_RUNS}, b AS (SELECT dataset, method, avg(volume) FILTER (cloud_id='ref') AS reference, count(*) FILTER (cloud_id='ref') AS n_ref, count(*) FILTER (cloud_id='mobile') AS n, avg(volume) FILTER (cloud_id='mobile') AS m, stddev_samp(volume) FILTER (cloud_id='mobile') AS sd_delta FROM first_runs GROUP BY ALL)
        SELECT dataset, method, round(reference,6) AS reference, n_ref, n, round(m-reference,6) AS mean_delta, round((m-reference)/reference*100,6) AS mean_delta_pct, round(sd_delta,6) AS sd_delta FROM b""",
    "paired_bias": f"""WITH {duckdb_with('runs')}, {_RUNS}, p AS (SELECT dataset, rep, method, max(volume) FILTER (cloud_id='ref') AS a, max(volume) FILTER (cloud_id='mobile') AS b FROM first_runs GROUP BY ALL)
        SELECT dataset, method, count(*) AS n, round(avg(b-a),6) AS mean_delta, round(avg((b-a)/a*100),6) AS mean_delta_pct, round(stddev_samp(b-a),6) AS sd_delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    "method_spread": f"WITH {duckdb_with('runs')}, {_RUNS}, p AS (SELECT dataset, rep, cloud_id, max(volume) FILTER (method='profiles') AS a, max(volume) FILTER (method='surface_mesh') AS b FROM first_runs GROUP BY ALL) SELECT dataset, rep, cloud_id, round((b-a)/a*100,6) AS delta_pct FROM p WHERE a <> 0 AND b <> 0",
    "aux_stability": "SELECT l_returnflag AS dataset, metric, count(*) AS n, round(avg(value),6) AS mean, round(min(value),6) AS min, round(max(value),6) AS max, round(stddev_samp(value),6) AS sd FROM (UNPIVOT (SELECT l_returnflag, l_discount, l_tax, l_quantity FROM lineitem) ON l_discount, l_tax, l_quantity INTO NAME metric VALUE value) GROUP BY ALL",
    "has_reference": f"WITH {duckdb_with('runs')} SELECT dataset, rep, bool_or(cloud_id='ref') AS has_reference FROM runs GROUP BY ALL",
    "run_index": f"WITH {duckdb_with('runs')}, {_RUNS} SELECT dataset, rep, cloud_id, coalesce(printf('%.5f', max(volume) FILTER (method='profiles')),'') AS profiles, coalesce(printf('%.5f', max(volume) FILTER (method='surface_mesh')),'') AS surface_mesh, coalesce(printf('%.5f', max(volume) FILTER (method='hull_bound')),'') AS hull_bound FROM first_runs GROUP BY ALL",
    "pair_distances": f"WITH {duckdb_with('targets')}, {_PD} SELECT net, i, j, {_r('d_ref', 'd_oth')} FROM pd",
    "scale_k": f"WITH {duckdb_with('targets')}, {_PD} SELECT net, n, {_r('k', 'sigma_k', 'resid_rms', 'len_ref', 'len_oth')} FROM ({_scale('net', 'SELECT * FROM pd')})",
    "leave_one_out": f"WITH {_LOO} SELECT net, dropped, n, {_r('k', 'sigma_k', 'resid_rms', 'len_ref', 'len_oth')} FROM lo",
    "target_consistency": f"WITH {_CONS} SELECT net, idx, {_r('loo_rms', 'improve', 'mean_resid')}, flagged FROM co",
    "segment_lengths": f"WITH {duckdb_with('targets')}, {_CHAIN} SELECT net, cloud_id, idx, {_r('from_first', 'segment')} FROM ch",
    "uniform_scale_fit": f"""WITH {_CONS}, {_CHAIN}, w AS (SELECT a.net, a.idx, a.from_first AS r, b.from_first AS m, (b.from_first-a.from_first)*1000 AS d, flagged FROM ch a JOIN ch b ON a.net=b.net AND a.idx=b.idx AND a.cloud_id='ref' AND b.cloud_id='mobile' JOIN co ON co.net=a.net AND co.idx=a.idx),
        f AS (SELECT net, CASE WHEN count(*) FILTER (NOT flagged) < 2 THEN regr_slope(d,r) ELSE regr_slope(d,r) FILTER (NOT flagged) END AS sl, CASE WHEN count(*) FILTER (NOT flagged) < 2 THEN regr_intercept(d,r) ELSE regr_intercept(d,r) FILTER (NOT flagged) END AS ic, arg_max(m,idx)/arg_max(r,idx) AS ke, arg_max(flagged,idx) OR arg_min(flagged,idx) AS ef FROM w GROUP BY net)
        SELECT net, round(1+sl/1000,6) AS k_fit, round(ic,4) AS intercept_mm, round(ke,6) AS k_end, CASE WHEN abs(sl/1000-(ke-1)) < 5e-4 THEN 'uniform' WHEN ef THEN 'end target flagged' ELSE 'not uniform' END AS verdict FROM f""",
    "decomposition": f"""WITH {_areas()}, {duckdb_with('targets')}, n AS (SELECT *, lead(s) OVER w AS s2, lead(area) OVER w AS a2 FROM a WHERE area IS NOT NULL WINDOW w AS (PARTITION BY cloud_id ORDER BY s)),
        v AS (SELECT cloud_id, (coalesce(sum(0.5e0*(area+a2)*(s2-s)),0) + {_ENDS})/100.0e0 AS ma FROM n GROUP BY cloud_id), ar AS (SELECT max(ma) FILTER (cloud_id='mobile')/max(ma) FILTER (cloud_id='ref') AS ar FROM v),
        l AS (SELECT p.net, p.cloud_id, sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2)) AS len FROM targets p JOIN targets q ON p.net=q.net AND p.cloud_id=q.cloud_id AND p.idx=0 AND q.idx=7),
        sm AS (SELECT a.net, bool_and(abs(a.x-b.x) <= 1e-8+1e-5*abs(b.x) AND abs(a.y-b.y) <= 1e-8+1e-5*abs(b.y) AND abs(a.z-b.z) <= 1e-8+1e-5*abs(b.z)) AS same_targets FROM targets a JOIN targets b ON a.net=b.net AND a.idx=b.idx AND a.cloud_id='ref' AND b.cloud_id='mobile' GROUP BY a.net),
        x AS (SELECT net, max(len) FILTER (cloud_id='mobile')/max(len) FILTER (cloud_id='ref') AS lr FROM l GROUP BY net)
        SELECT x.net, round(lr,6) AS length_ratio, round(ar,6) AS area_ratio, round(lr*ar,6) AS volume_ratio, same_targets FROM x CROSS JOIN ar JOIN sm ON sm.net=x.net""",
    "from_cylindrical": f"WITH {duckdb_with('cloud')} SELECT cloud_id, count(*) AS n, round(sum(round(s,6)),3) AS x, round(sum(round(r*sin(radians(theta)),6)),3) AS y, round(sum(round(r*cos(radians(theta)),6)),3) AS z FROM cloud GROUP BY cloud_id",
    "reversed_axis": f"""WITH {duckdb_with('traj')}, d AS (SELECT run_id, seq, x, y, z FROM traj)
        SELECT run_id, seq, round(10.0e0 - x, 6) AS s, round(sqrt(y*y+z*z), 6) AS r, round(degrees(atan2(-y, z)), 6) AS theta, round(z, 6) AS dz FROM d""",
    "gravity_frame": f"""WITH {duckdb_with('traj')}, l AS (SELECT run_id, seq, lead(x) OVER w - x AS x, lead(y) OVER w - y AS y, lead(z) OVER w - z AS z FROM traj {_TW}), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS q FROM l),
        t AS (SELECT run_id, seq, x/q AS tx, y/q AS ty, z/q AS tz FROM n WHERE q > 1e-6 AND abs(z) < 0.999e0*q), a AS (SELECT *, sqrt(pow(tz*tx,2)+pow(tz*ty,2)+pow(1-tz*tz,2)) AS m FROM t), u AS (SELECT *, -tz*tx/m AS ax, -tz*ty/m AS ay, (1-tz*tz)/m AS az FROM a)
        SELECT run_id, seq, {_r('ax', 'ay', 'az')}, round(ty*az-tz*ay,6) AS bx, round(tz*ax-tx*az,6) AS by, round(tx*ay-ty*ax,6) AS bz FROM u""",
    "curvature": f"WITH {_KAPPA} SELECT run_id, k, round(kappa, 6) AS kappa FROM kp",
    "curvature_peaks": f"""WITH {_KAPPA}, r AS (SELECT run_id, k, round(kappa, 6) AS kappa FROM kp), c AS (SELECT *, CASE WHEN kappa IS DISTINCT FROM lag(kappa) OVER w THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY run_id ORDER BY k)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS top FROM c), f AS (SELECT run_id, top, min(k) AS lo, max(k) AS hi, any_value(kappa) AS kappa FROM g GROUP BY run_id, top),
        p AS (SELECT *, lag(kappa) OVER w AS b, lead(kappa) OVER w AS a FROM f WINDOW w AS (PARTITION BY run_id ORDER BY top)), l AS (SELECT run_id, quantile_cont(kappa, 0.9) AS lim FROM r GROUP BY run_id)
        SELECT p.run_id, (lo + hi)//2 AS k, kappa FROM p JOIN l ON l.run_id = p.run_id WHERE kappa > b AND kappa > a AND kappa >= lim""",
    "area_bridge": f"""WITH {_areas()}, w AS (SELECT *, last_value(CASE WHEN area IS NOT NULL THEN s END IGNORE NULLS) OVER p AS sa, last_value(area IGNORE NULLS) OVER p AS va, first_value(CASE WHEN area IS NOT NULL THEN s END IGNORE NULLS) OVER q AS sb, first_value(area IGNORE NULLS) OVER q AS vb FROM a
        WINDOW p AS (PARTITION BY cloud_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY cloud_id ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT cloud_id, i, round(s,6) AS s, round(CASE WHEN area IS NOT NULL THEN area WHEN sa IS NULL THEN vb WHEN sb IS NULL THEN va ELSE va+(vb-va)*(s-sa)/(sb-sa) END, 6) AS area FROM w""",
    "shifted_difference": f"WITH {_areas()}{_SHIFT} SELECT {_r('p', 'area_a', 'area_b')}, round(area_b-area_a, 6) AS d_area FROM sh",
    "campaign_segments": f"""WITH {_areas()}{_SHIFT}, cg AS (SELECT *, CAST(floor(p/10.0e0) AS BIGINT) AS k FROM sh), ct AS (SELECT k, 0.5e0*(area_a+lead(area_a) OVER w)*(lead(p) OVER w-p) AS a, 0.5e0*(area_b+lead(area_b) OVER w)*(lead(p) OVER w-p) AS b FROM cg WINDOW w AS (PARTITION BY k ORDER BY p)),
        v AS (SELECT k, sum(a) AS v_a, sum(b) AS v_b FROM ct GROUP BY k HAVING count(*) >= 2)
        SELECT k, {_r('v_a', 'v_b')}, round(v_b-v_a, 6) AS dv, round((v_b-v_a)/v_a*100, 6) AS dv_pct, abs((v_b-v_a)/v_a*100) > 5 AS flagged FROM v""",
    "campaign_change": f"""WITH {duckdb_with('runs')}, {_RUNS}, m AS (SELECT dataset, cloud_id, method, avg(volume) AS v FROM first_runs GROUP BY ALL),
        c AS (SELECT method, max(v) FILTER (dataset='ds0' AND cloud_id='ref') AS ra, max(v) FILTER (dataset='ds1' AND cloud_id='ref') AS rb, max(v) FILTER (dataset='ds0' AND cloud_id='mobile') AS oa, max(v) FILTER (dataset='ds1' AND cloud_id='mobile') AS ob FROM m GROUP BY method),
        x AS (SELECT method, ob-oa AS total, rb-ra AS tunnel, (ob-rb)-(oa-ra) AS sensor FROM c WHERE ra IS NOT NULL AND rb IS NOT NULL AND oa IS NOT NULL AND ob IS NOT NULL)
        SELECT method, {_r('total', 'tunnel', 'sensor')}, round(abs(sensor)/nullif(abs(tunnel)+abs(sensor), 0)*100, 6) AS sensor_share_pct FROM x""",
    "band_mean": f"""WITH {duckdb_with('cloud')}, b AS (SELECT cloud_id, floor((theta+180.0e0)/{DT}) AS j, avg(r*cos(radians(theta))) AS dz FROM cloud GROUP BY ALL), c AS (SELECT *, (j+0.5e0)*{DT}-180.0e0 AS angle FROM b)
        SELECT 'dip' AS band, round(avg(dz), 6) AS mean, count(dz) AS n FROM c WHERE angle BETWEEN -130 AND -110 UNION ALL SELECT 'opposite', round(avg(dz), 6), count(dz) FROM c WHERE angle BETWEEN 50 AND 70""",
    "last_by_path": f"""WITH {duckdb_with('runs')}, p AS (SELECT *, concat_ws('/', dataset, rep, strftime(stamp, '%Y%m%d'), lpad(CAST(run_no AS VARCHAR), 9, '0'), cloud_id, method, printf('%.5f', volume)) AS path FROM runs)
        SELECT dataset, rep, run_no, cloud_id, method, round(volume, 6) AS volume FROM p QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY path DESC) = 1""",
    "pooled_trials": "SELECT o_orderkey AS trial_id, round(o_totalprice/5000.0e0, 6) AS value, 'COMPLETE' AS state, o_orderpriority AS category FROM orders WHERE o_orderstatus <> 'F'",
    "best_and_bounds": """WITH b AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_totalprice/5000.0e0, o_orderkey LIMIT 1),
        p AS (SELECT o_orderkey AS trial_id, 'cust' AS name, CAST(o_custkey AS DOUBLE) AS value, CAST(o_custkey AS DOUBLE)/150.0e0 AS place FROM b UNION ALL SELECT o_orderkey, 'total', o_totalprice, (ln(o_totalprice)-ln(1.0e0))/(ln(1e6)-ln(1.0e0)) FROM b UNION ALL SELECT o_orderkey, 'key', o_orderkey+1.0e0, (o_orderkey+1.0e0)/1e6 FROM b)
        SELECT trial_id, name, round(value, 6) AS value, round(place, 6) AS place, CASE WHEN place <= 0.15e0 THEN 'near low' WHEN place >= 0.85e0 THEN 'near high' ELSE 'inside' END AS verdict FROM p""",
    "outcomes": """WITH r AS (SELECT CASE WHEN o_custkey % 11 = 0 THEN 124 WHEN o_custkey % 7 = 0 THEN o_custkey % 5 ELSE 0 END AS c, o_custkey % 13 <> 0 AS h, o_totalprice/100 AS l FROM orders),
        f AS (SELECT CASE WHEN c = 124 THEN 'timeout' WHEN c <> 0 THEN 'exit_' || CAST(c AS VARCHAR) WHEN NOT h THEN 'no_trajectory' WHEN l > 1500 THEN 'runaway' ELSE '' END AS failure_reason FROM r)
        SELECT failure_reason, failure_reason <> '' AS failed, count(*) AS n FROM f GROUP BY ALL""",
    "config_patches": "SELECT p_partkey AS trial_id, 'a.json' AS file, 'm.brand=' || p_brand || ';m.size=' || CAST(p_size AS VARCHAR) AS patch FROM part",
    "frame_counts": f"""WITH {duckdb_with('traj')}, t AS (SELECT seq, seq % 5 AS n, seq % 3 <> 0 AS m, seq BETWEEN 1.8e0 AND 40.2e0 AS i FROM traj)
        SELECT count(*) AS read, count(*) FILTER (n > 0) AS parsed, count(*) FILTER (NOT i) AS out_of_range, count(*) FILTER (i AND NOT m) AS stationary, count(*) FILTER (i AND m) AS kept FROM t""",
    "point_times": """WITH p AS (SELECT user_id AS scan_id, CASE user_id % 4 WHEN 0 THEN (1e5+value/1000)*1.0e0 WHEN 1 THEN (1e5+value/1000)*1e9 WHEN 2 THEN value*1e-3 ELSE value*1e6 END AS t FROM events),
        m AS (SELECT scan_id, [abs(median(t)-1e5), abs(median(t*1e-9)-1e5), abs(median(1e5+t)-1e5), abs(median(1e5+t*1e-9)-1e5)] AS o FROM p GROUP BY scan_id), k AS (SELECT scan_id, list_position(o, list_min(o)) AS k FROM m),
        r AS (SELECT p.scan_id, CASE k WHEN 1 THEN t WHEN 2 THEN t*1e-9 WHEN 3 THEN 1e5+t ELSE 1e5+t*1e-9 END AS t FROM p JOIN k ON k.scan_id = p.scan_id)
        SELECT scan_id, count(*) AS n, round(min(t), 4) AS t_min, round(max(t), 4) AS t_max FROM r GROUP BY scan_id""",
    "cap_fingerprint": f"""WITH {duckdb_with('targets')} SELECT concat_ws('/', CAST(net AS VARCHAR), cloud_id) AS run_id, string_agg(printf('%.4f %.4f %.4f', x, y, z), '; ' ORDER BY printf('%.4f %.4f %.4f', x, y, z)) AS caps FROM targets WHERE idx IN (0, 7) GROUP BY ALL""",
    "iso_surface": _iso_surface(),
    "surface_volume": f"""WITH {duckdb_with('cloud')}, {_XYZ}, {_VOX}, b AS (SELECT cloud_id, ix - (k & 1) AS x, iy - ((k >> 1) & 1) AS y, iz - (k >> 2) AS z, 1 << k AS bit FROM v CROSS JOIN (SELECT unnest(range(8)) AS k)),
        c AS (SELECT cloud_id, CAST(sum(bit) AS BIGINT) AS pattern FROM b GROUP BY cloud_id, x, y, z),
        t AS (SELECT unnest([1 + 2 + 8 + 128, 1 + 2 + 32 + 128, 1 + 4 + 8 + 128, 1 + 4 + 64 + 128, 1 + 16 + 32 + 128, 1 + 16 + 64 + 128]) AS mask)
        SELECT cloud_id, round(sum([0.0e0, 0.125e0, 0.5e0, 0.875e0, 1.0e0][bit_count(pattern & mask) + 1])/6*0.125e0, 6) AS volume FROM c CROSS JOIN t GROUP BY cloud_id""",
    "outbound_leg": f"""WITH RECURSIVE {duckdb_with('traj')}, c AS MATERIALIZED (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz, count(*) OVER w AS n FROM traj WINDOW w AS (PARTITION BY run_id)),
        m AS MATERIALIZED (SELECT run_id, avg(cx*cx) xx, avg(cx*cy) xy, avg(cx*cz) xz, avg(cy*cy) yy, avg(cy*cz) yz, avg(cz*cz) zz FROM c GROUP BY run_id),
        pw AS (SELECT run_id, 0 AS k, 0.5773e0 AS a, 0.5771e0 AS b, 0.5777e0 AS d FROM m UNION ALL
               SELECT run_id, k + 1, CASE WHEN q > 0 THEN u/q ELSE a END, CASE WHEN q > 0 THEN v/q ELSE b END, CASE WHEN q > 0 THEN w/q ELSE d END FROM
                 (SELECT *, sqrt(u*u+v*v+w*w) AS q FROM (SELECT pw.*, xx*a+xy*b+xz*d AS u, xy*a+yy*b+yz*d AS v, xz*a+yz*b+zz*d AS w FROM pw JOIN m ON m.run_id = pw.run_id WHERE k < 300))),
        p AS (SELECT c.run_id, seq, x, y, z, n, cx*a+cy*b+cz*d AS pj FROM c JOIN pw ON pw.run_id = c.run_id AND pw.k = 300),
        f AS (SELECT *, abs(pj - first_value(pj) OVER w) AS away, row_number() OVER w - 1 AS pos FROM p WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
        t AS (SELECT run_id, greatest(arg_max(pos, away), least(any_value(n) - 1, 10)) AS turn FROM (SELECT * FROM f ORDER BY run_id, pos) GROUP BY run_id)
        SELECT f.run_id, seq, {_r('x', 'y', 'z')} FROM f JOIN t ON t.run_id = f.run_id WHERE pos <= turn""",
    "outlier_removal": f"""WITH {duckdb_with('cloud')}, x AS MATERIALIZED (SELECT cloud_id, row_number() OVER () AS id, r*cos(radians(theta)) AS x, r*sin(radians(theta)) AS y, s AS z FROM cloud), g AS MATERIALIZED (SELECT *, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k FROM x),
        o AS (SELECT a, b, c FROM (SELECT unnest([-1,0,1]) AS a) CROSS JOIN (SELECT unnest([-1,0,1]) AS b) CROSS JOIN (SELECT unnest([-1,0,1]) AS c)), q AS (SELECT cloud_id, id, x, y, z, i+a AS i, j+b AS j, k+c AS k FROM g CROSS JOIN o),
        n AS (SELECT q.cloud_id, q.id, list_sort(list(sqrt(pow(q.x-g.x,2)+pow(q.y-g.y,2)+pow(q.z-g.z,2))))[1:8] AS d FROM q JOIN g ON g.cloud_id=q.cloud_id AND g.i=q.i AND g.j=q.j AND g.k=q.k AND g.id<>q.id GROUP BY ALL),
        sure AS MATERIALIZED (SELECT cloud_id, id, d FROM n WHERE len(d) = 8 AND d[8] <= 1), l AS MATERIALIZED (SELECT * FROM x WHERE id NOT IN (SELECT id FROM sure)),
        far AS (SELECT l.cloud_id, l.id, list_sort(list(sqrt(pow(l.x-x.x,2)+pow(l.y-x.y,2)+pow(l.z-x.z,2))))[1:8] AS d FROM l JOIN x ON x.cloud_id=l.cloud_id AND x.id<>l.id GROUP BY ALL),
        e AS (SELECT cloud_id, list_avg(d) AS d FROM (SELECT * FROM sure UNION ALL SELECT * FROM far)), m AS (SELECT cloud_id, avg(d) + 2*stddev_samp(d) AS lim FROM e GROUP BY cloud_id)
        SELECT e.cloud_id, count(*) AS n FROM e JOIN m ON m.cloud_id=e.cloud_id WHERE d <= lim GROUP BY e.cloud_id""",
    "hull_area": f"""WITH RECURSIVE {duckdb_with('cloud')}, {_XYZ}, p AS MATERIALIZED (SELECT DISTINCT cloud_id, CAST(floor(z/{DS}) AS BIGINT) AS i, x, y FROM xyz),
        st AS (SELECT cloud_id, i, unnest(arg_min(struct_pack(x := x, y := y), struct_pack(y := y, x := x))) FROM p GROUP BY cloud_id, i HAVING count(*) > 2),
        h AS (SELECT cloud_id, i, 0 AS k, x, y, 1.0e0 AS dx, 0.0e0 AS dy, x AS x0, y AS y0, false AS done FROM st UNION ALL
              SELECT cloud_id, i, k + 1, n.x, n.y, n.x - x, n.y - y, x0, y0, n.x = x0 AND n.y = y0 FROM
                (SELECT cloud_id, i, k, x, y, x0, y0, arg_min(struct_pack(x := px, y := py), CASE WHEN a < -1e-12 THEN a + 2*pi() ELSE a END) AS n FROM
                   (SELECT h.cloud_id, h.i, k, h.x, h.y, x0, y0, p.x AS px, p.y AS py, atan2(dx*(p.y-h.y)-dy*(p.x-h.x), dx*(p.x-h.x)+dy*(p.y-h.y)) AS a FROM h JOIN p ON p.cloud_id=h.cloud_id AND p.i=h.i WHERE NOT done AND k < 1000 AND (p.x <> h.x OR p.y <> h.y)) GROUP BY ALL)),
        s AS (SELECT cloud_id, i, x, y, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM h WINDOW w AS (PARTITION BY cloud_id, i ORDER BY k)), ar AS (SELECT cloud_id, i, abs(sum(x1*y-x*y1))/2 AS area FROM s GROUP BY cloud_id, i)
        SELECT d.cloud_id, d.i, round(area, 6) AS area FROM (SELECT DISTINCT cloud_id, i FROM p) d LEFT JOIN ar ON ar.cloud_id=d.cloud_id AND ar.i=d.i""",
    "phantom_volumes": "SELECT hole, method, round(0.5e0*72*4*sin(radians(5.0e0))*100, 4) AS volume, round((0.5e0*72*4*sin(radians(5.0e0))*100/(400*pi())-1)*100, 6) AS error_pct FROM (SELECT unnest([false, true]) AS hole) CROSS JOIN (SELECT unnest(['profiles', 'surface_mesh']) AS method)",
    "largest_cavity": f"""WITH RECURSIVE {duckdb_with('cloud')}, {_XYZ}, {_VOX}, w AS MATERIALIZED (SELECT DISTINCT cloud_id, ix+a AS ix, iy+b AS iy, iz+c AS iz FROM v CROSS JOIN (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(a,b,c)),
        bx AS (SELECT cloud_id, min(ix)-1 a, max(ix)+1 b, min(iy)-1 c, max(iy)+1 d, min(iz)-1 e, max(iz)+1 f FROM w GROUP BY cloud_id),
        al AS (SELECT cloud_id, a, b, c, d, e, f, ix, iy, unnest(range(e, f+1)) AS iz FROM (SELECT *, unnest(range(c, d+1)) AS iy FROM (SELECT *, unnest(range(a, b+1)) AS ix FROM bx))),
        fr AS MATERIALIZED (SELECT al.*, ix IN (a, b) OR iy IN (c, d) OR iz IN (e, f) AS rim, row_number() OVER () AS id FROM al ANTI JOIN w USING (cloud_id, ix, iy, iz)),
        ad AS MATERIALIZED (SELECT x.id AS u, y.id AS v FROM fr x CROSS JOIN (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(p,q,r) JOIN fr y ON y.cloud_id=x.cloud_id AND y.ix=x.ix+p AND y.iy=x.iy+q AND y.iz=x.iz+r),
        ou AS (SELECT id FROM fr WHERE rim UNION SELECT ad.v FROM ou JOIN ad ON ad.u = ou.id),
        inn AS MATERIALIZED (SELECT id, cloud_id FROM fr WHERE id NOT IN (SELECT id FROM ou)), ai AS MATERIALIZED (SELECT u, v FROM ad WHERE u IN (SELECT id FROM inn) AND v IN (SELECT id FROM inn)),
        sd AS MATERIALIZED (SELECT id FROM inn WHERE id NOT IN (SELECT u FROM ai WHERE v < u)),
        rc AS (SELECT id AS seed, id FROM sd UNION SELECT seed, v FROM rc JOIN ai ON ai.u = rc.id), sz AS (SELECT seed, count(*) AS n FROM rc GROUP BY seed),
        m AS (SELECT cloud_id, max(n) AS n FROM sz JOIN inn ON inn.id = sz.seed GROUP BY cloud_id)
        SELECT bx.cloud_id, coalesce(n, 0) AS n, round(coalesce(n, 0)*0.125e0, 6) AS volume, coalesce(n, 0) <= 0 AS leaked FROM bx LEFT JOIN m USING (cloud_id)""",
    "dilate_clipped": f"""WITH {duckdb_with('cloud')}, {_XYZ}, {_VOX}, o AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(a,b,c)), one AS (SELECT DISTINCT cloud_id, ix+a AS ix, iy+b AS iy, iz+c AS iz FROM v CROSS JOIN o),
        two AS (SELECT DISTINCT cloud_id, ix+a AS ix, iy+b AS iy, iz+c AS iz FROM one CROSS JOIN o), bx AS (SELECT cloud_id, min(ix) a, max(ix) b, min(iy) c, max(iy) d, min(iz) e, max(iz) f FROM v GROUP BY cloud_id)
        SELECT two.cloud_id, ix, iy, iz FROM two JOIN bx ON bx.cloud_id=two.cloud_id AND ix BETWEEN a AND b AND iy BETWEEN c AND d AND iz BETWEEN e AND f""",
    "strided_scans": f"WITH {duckdb_with('traj')} SELECT run_id, count(*) AS n, CAST(min(seq) AS DOUBLE) AS first, CAST(max(seq) AS DOUBLE) AS last FROM traj WHERE seq BETWEEN 1.8e0 AND 40.2e0 AND seq % 3 = 0 GROUP BY run_id",
}
