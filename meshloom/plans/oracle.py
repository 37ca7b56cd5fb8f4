"""SQL of the tiling operators for another engine (DuckDB's dialect), in long form: a row for each dimension of an array.

Fragments are common table expressions; ``sql`` joins those that a query needs. Nothing here runs in Spark.
"""

from __future__ import annotations

DIMS = 8

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": ((), "SELECT label AS sample, vec_id AS pt_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, embedding FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL"),
    "feats": (("cells",), f"SELECT sample, pt_id, d.d AS dim, CAST(embedding[d.d + 3] AS DOUBLE) AS v FROM cells, range({DIMS}) d(d)"),
    "triples": (("cells",), """SELECT a.sample, a.pt_id AS a, b.pt_id AS b, c.pt_id AS c, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS xc, c.y AS yc,
      sign((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS turn
      FROM cells a JOIN cells b ON a.sample = b.sample AND a.pt_id < b.pt_id JOIN cells c ON b.sample = c.sample AND b.pt_id < c.pt_id"""),
    "faces": (("triples",), """SELECT * FROM triples t WHERE turn <> 0 AND NOT EXISTS (SELECT 1 FROM cells d WHERE d.sample = t.sample AND d.pt_id NOT IN (t.a, t.b, t.c) AND t.turn * (
      ((xa-d.x)*(xa-d.x)+(ya-d.y)*(ya-d.y)) * ((xb-d.x)*(yc-d.y)-(xc-d.x)*(yb-d.y)) - ((xb-d.x)*(xb-d.x)+(yb-d.y)*(yb-d.y)) * ((xa-d.x)*(yc-d.y)-(xc-d.x)*(ya-d.y))
      + ((xc-d.x)*(xc-d.x)+(yc-d.y)*(yc-d.y)) * ((xa-d.x)*(yb-d.y)-(xb-d.x)*(ya-d.y))) > 0)"""),
    "sides": (("faces",), """SELECT *, sqrt((xa-xb)**2+(ya-yb)**2) AS s1, sqrt((xb-xc)**2+(yb-yc)**2) AS s2, sqrt((xa-xc)**2+(ya-yc)**2) AS s3 FROM faces"""),
    "tris": (("sides",), """SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY a, b, c) AS tri_id, (xa+xb+xc)/3 AS x, (ya+yb+yc)/3 AS y, area, 2*area/least(s1,s2,s3) AS height, a, b, c, xa, ya, xb, yb, xc, yc
      FROM (SELECT *, sqrt(greatest((s1+s2+s3)/2*((s1+s2+s3)/2-s1)*((s1+s2+s3)/2-s2)*((s1+s2+s3)/2-s3), 0)) AS area FROM sides)"""),
    "corners": (("tris",), "SELECT sample, tri_id, unnest([a, b, c]) AS pt_id FROM tris"),
    "edge_sides": (("tris",), """SELECT sample, tri_id, x, y, a AS from_pt, b AS to_pt, xa AS x0_pt, xb AS x1_pt, ya AS y0_pt, yb AS y1_pt FROM tris
      UNION ALL SELECT sample, tri_id, x, y, a, c, xa, xc, ya, yc FROM tris UNION ALL SELECT sample, tri_id, x, y, b, c, xb, xc, yb, yc FROM tris"""),
    "edges": (("edge_sides",), """SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY from_pt, to_pt) AS edge_id, from_pt, to_pt, from_tri, to_tri, x0_pt, x1_pt, y0_pt, y1_pt, x0_tri, x1_tri, y0_tri, y1_tri,
      sqrt((x1_pt-x0_pt)**2+(y1_pt-y0_pt)**2) AS length_pt, sqrt((x1_tri-x0_tri)**2+(y1_tri-y0_tri)**2) AS length_tri FROM (
      SELECT sample, from_pt, to_pt, min(x0_pt) AS x0_pt, min(x1_pt) AS x1_pt, min(y0_pt) AS y0_pt, min(y1_pt) AS y1_pt, CASE WHEN count(*) = 2 THEN min(tri_id) END AS from_tri, max(tri_id) AS to_tri,
      CASE WHEN count(*) = 2 THEN arg_min(x, tri_id) END AS x0_tri, arg_max(x, tri_id) AS x1_tri, CASE WHEN count(*) = 2 THEN arg_min(y, tri_id) END AS y0_tri, arg_max(y, tri_id) AS y1_tri FROM edge_sides GROUP BY ALL)"""),
    "hull": (("edges",), "SELECT e.*, (SELECT max(tri_id) FROM tris t WHERE t.sample = e.sample) + row_number() OVER (PARTITION BY sample ORDER BY edge_id) AS ext FROM edges e WHERE from_tri IS NULL"),
    "xtris": (("hull",), "SELECT sample, tri_id, x, y, area, height, false AS external FROM tris UNION ALL SELECT sample, ext, (x0_pt+x1_pt)/2, (y0_pt+y1_pt)/2, 0.0, 0.0, true FROM hull"),
    "xedges": (("hull",), """SELECT e.sample, e.edge_id, e.from_pt, e.to_pt, coalesce(e.from_tri, h.ext) AS from_tri, e.to_tri, e.x0_pt, e.x1_pt, e.y0_pt, e.y1_pt, coalesce(e.x0_tri, (e.x0_pt+e.x1_pt)/2) AS x0_tri, e.x1_tri,
      coalesce(e.y0_tri, (e.y0_pt+e.y1_pt)/2) AS y0_tri, e.y1_tri, e.length_pt, e.length_tri, h.ext IS NOT NULL AS boundary FROM edges e LEFT JOIN hull h ON e.sample = h.sample AND e.edge_id = h.edge_id"""),
    "cut": (("edges",), "SELECT sample, quantile_cont(length_pt, 0.9) AS thresh FROM edges GROUP BY sample"),
    "good": (("cut",), """SELECT sample, tri_id FROM (SELECT e.sample, unnest([from_tri, to_tri]) AS tri_id FROM edges e JOIN cut USING (sample) WHERE length_pt <= thresh) WHERE tri_id IS NOT NULL GROUP BY ALL HAVING count(*) = 3"""),
    "near_tris": (("good",), "SELECT e.sample, e.from_tri AS a, e.to_tri AS b FROM edges e JOIN good g ON g.sample = e.sample AND g.tri_id = e.from_tri JOIN good h ON h.sample = e.sample AND h.tri_id = e.to_tri"),
    "reached": (("near_tris",), "SELECT sample, tri_id AS node, tri_id AS other FROM good UNION SELECT r.sample, r.node, CASE WHEN n.a = r.other THEN n.b ELSE n.a END FROM reached r JOIN near_tris n ON n.sample = r.sample AND (n.a = r.other OR n.b = r.other)"),
    "parts": (("reached",), "SELECT sample, node AS tri_id, min(other) AS component FROM reached GROUP BY ALL"),
    "part_sizes": (("parts", "corners"), "SELECT p.sample, p.component, count(DISTINCT pt_id) AS cells FROM parts p JOIN corners c ON c.sample = p.sample AND c.tri_id = p.tri_id GROUP BY ALL"),
    "wholes": (("parts",), "SELECT p.sample FROM (SELECT sample, count(DISTINCT component) AS k, count(*) AS n FROM parts GROUP BY sample) p JOIN (SELECT sample, count(*) AS total FROM tris GROUP BY sample) t ON t.sample = p.sample WHERE k = 1 AND n = total"),
    "kept_tris": (("part_sizes", "wholes"), "SELECT p.sample, p.tri_id FROM parts p JOIN part_sizes s ON s.sample = p.sample AND s.component = p.component LEFT JOIN wholes w ON w.sample = p.sample WHERE s.cells >= 6 OR w.sample IS NOT NULL"),
    "linked_both": (("edges",), "SELECT sample, from_pt AS a, to_pt AS b FROM edges UNION SELECT sample, to_pt, from_pt FROM edges"),
    "zs": (("normed",), """SELECT x.cell_id, x.gene, greatest(least((x.v - m.mu) / m.sd, 10), -10) AS z FROM
      (SELECT c.cell_id, g.gene, coalesce(n.value, 0) AS v FROM (SELECT DISTINCT cell_id FROM supp) c CROSS JOIN (SELECT DISTINCT gene FROM supp) g LEFT JOIN normed n ON n.cell_id = c.cell_id AND n.gene = g.gene) x
      JOIN (SELECT gene, sum(value) / k AS mu, sqrt((sum(value * value) - sum(value) * sum(value) / k) / (k - 1)) AS sd FROM normed, (SELECT count(DISTINCT cell_id) AS k FROM supp) GROUP BY gene, k) m ON m.gene = x.gene WHERE m.sd > 1e-9"""),
    "hops": (("linked_both",), """SELECT sample, min(pt_id) AS node, 0 AS d FROM cells GROUP BY sample UNION
      SELECT h.sample, l.b, h.d + 1 FROM hops h JOIN linked_both l ON l.sample = h.sample AND l.a = h.node WHERE h.d < (SELECT max(k) FROM (SELECT count(*) AS k FROM cells GROUP BY sample))"""),
    "efield": (("edges", "feats"), """SELECT e.sample, e.edge_id, f.dim, (x1_pt-x0_pt)/length_pt*(g.v-f.v) AS gx, (y1_pt-y0_pt)/length_pt*(g.v-f.v) AS gy FROM edges e
      JOIN feats f ON f.sample = e.sample AND f.pt_id = e.from_pt JOIN feats g ON g.sample = e.sample AND g.pt_id = e.to_pt AND g.dim = f.dim"""),
    "pfield": (("efield",), "SELECT e.sample, e.pt_id, f.dim, avg(gx) AS gx, avg(gy) AS gy FROM (SELECT sample, edge_id, unnest([from_pt, to_pt]) AS pt_id FROM edges) e JOIN efield f ON f.sample = e.sample AND f.edge_id = e.edge_id GROUP BY ALL"),
    "links": (("edges",), """SELECT sample, from_pt AS a, to_pt AS b, x1_pt-x0_pt AS dx, y1_pt-y0_pt AS dy FROM edges UNION ALL SELECT sample, to_pt, from_pt, x0_pt-x1_pt, y0_pt-y1_pt FROM edges"""),
    "linked": (("links", "pfield"), "SELECT * FROM links UNION ALL SELECT DISTINCT sample, pt_id, pt_id, 0.0, 0.0 FROM pfield"),
    "ppairs": (("linked",), """SELECT l.sample, l.a, l.b, any_value(dx) AS dx, any_value(dy) AS dy, sum(p.gx*p.gx) AS g11, sum(p.gx*p.gy) AS g12, sum(p.gy*p.gy) AS g22, sum(p.gx*q.gx+p.gy*q.gy) AS ip, sum(q.gx*q.gx+q.gy*q.gy) AS bb
      FROM linked l JOIN pfield p ON p.sample = l.sample AND p.pt_id = l.a JOIN pfield q ON q.sample = l.sample AND q.pt_id = l.b AND q.dim = p.dim GROUP BY l.sample, l.a, l.b"""),
    "ends": (("edges",), "SELECT sample, edge_id, from_pt AS at_pt, x1_pt AS px, y1_pt AS py FROM edges UNION ALL SELECT sample, edge_id, to_pt, x0_pt, y0_pt FROM edges"),
    "epairs": (("ends", "efield"), """SELECT i.sample, i.edge_id AS i, j.edge_id AS j, i.at_pt, any_value(j.px-i.px) AS dx, any_value(j.py-i.py) AS dy, sum(p.gx*p.gx) AS g11, sum(p.gx*p.gy) AS g12, sum(p.gy*p.gy) AS g22, sum(q.gx*q.gx+q.gy*q.gy) AS bb,
      sum(q.gx*p.gx) AS m11, sum(q.gx*p.gy) AS m12, sum(q.gy*p.gx) AS m21, sum(q.gy*p.gy) AS m22 FROM ends i JOIN ends j ON i.sample = j.sample AND i.at_pt = j.at_pt
      JOIN efield p ON p.sample = i.sample AND p.edge_id = i.edge_id JOIN efield q ON q.sample = j.sample AND q.edge_id = j.edge_id AND q.dim = p.dim GROUP BY i.sample, i.edge_id, j.edge_id, i.at_pt"""),
    "eweights": (("epairs",), """SELECT *, exp(-d*d/(2*sd*sd) - s*s/(2*ss*ss)) AS phi FROM (SELECT *, coalesce(nullif(avg(d) OVER w, 0), 1) AS sd, coalesce(nullif(avg(s) OVER w, 0), 1) AS ss FROM (
      SELECT sample, i, j, at_pt, sqrt(greatest(dx*dx*g11+2*dx*dy*g12+dy*dy*g22, 0))/2 AS d, greatest(0, 1 - sqrt(m11*m11+m12*m12+m21*m21+m22*m22+2*abs(m11*m22-m12*m21))/sqrt((g11+g22)*bb)) AS s FROM epairs) WINDOW w AS (PARTITION BY sample, i))"""),
    "esmooth": (("eweights",), "SELECT w.sample, w.i AS edge_id, f.dim, sum(phi*gx)/sum(phi) AS gx, sum(phi*gy)/sum(phi) AS gy FROM eweights w JOIN efield f ON f.sample = w.sample AND f.edge_id = w.j GROUP BY ALL"),
    "pts_g": (("esmooth", "xedges"), "SELECT e.sample, e.id AS pt_id, f.dim, avg(gx) AS gx, avg(gy) AS gy FROM (SELECT sample, edge_id, unnest([from_pt, to_pt]) AS id FROM xedges) e JOIN esmooth f ON f.sample = e.sample AND f.edge_id = e.edge_id GROUP BY ALL"),
    "tris_g": (("esmooth", "xedges"), "SELECT e.sample, e.id AS tri_id, f.dim, avg(gx) AS gx, avg(gy) AS gy FROM (SELECT sample, edge_id, unnest([from_tri, to_tri]) AS id FROM xedges) e JOIN esmooth f ON f.sample = e.sample AND f.edge_id = e.edge_id GROUP BY ALL"),
}


def _f(source: str, key: str) -> str:
    return f"SELECT sample, {key}, sqrt(g11+g22+2*sqrt(greatest(g11*g22-g12*g12, 0))) AS f FROM (SELECT sample, {key}, sum(gx*gx) AS g11, sum(gx*gy) AS g12, sum(gy*gy) AS g22 FROM {source} GROUP BY ALL)"


def _forest(name: str, nodes: str, key: str, a: str, b: str, sign: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Best edge of each node, parents, and roots by walking up."""
    return {
        f"{name}_best": (("ef", nodes, "xedges"), f"""SELECT sample, node, edge_id, other, first FROM (SELECT *, row_number() OVER (PARTITION BY sample, node ORDER BY f DESC, edge_id) AS r FROM (
          SELECT e.sample, e.edge_id, {sign}ef.f AS f, e.{a} AS node, e.{b} AS other, true AS first FROM xedges e JOIN ef USING (sample, edge_id) UNION ALL SELECT e.sample, e.edge_id, {sign}ef.f, e.{b}, e.{a}, false FROM xedges e JOIN ef USING (sample, edge_id))) WHERE r = 1"""),
        f"{name}_links": ((f"{name}_best",), f"""SELECT x.sample, x.node, CASE WHEN x.edge_id = y.edge_id AND (CASE WHEN x.first THEN {sign}n.f > {sign}m.f ELSE NOT ({sign}m.f > {sign}n.f) END) THEN NULL ELSE x.other END AS parent, x.edge_id
          FROM {name}_best x JOIN {name}_best y ON y.sample = x.sample AND y.node = x.other JOIN {nodes} n ON n.sample = x.sample AND n.{key} = x.node JOIN {nodes} m ON m.sample = x.sample AND m.{key} = x.other"""),
        f"{name}_up": ((f"{name}_links",), f"SELECT sample, node, node AS above FROM {name}_links UNION ALL SELECT u.sample, u.node, l.parent FROM {name}_up u JOIN {name}_links l ON l.sample = u.sample AND l.node = u.above WHERE l.parent IS NOT NULL"),
        name: ((f"{name}_up",), f"""SELECT l.sample, l.node, l.parent, CASE WHEN l.parent IS NOT NULL THEN l.edge_id END AS parent_edge, u.above AS root FROM {name}_links l JOIN {name}_up u ON u.sample = l.sample AND u.node = l.node
          JOIN {name}_links t ON t.sample = u.sample AND t.node = u.above AND t.parent IS NULL"""),
    }


FRAGMENTS |= {
    "pf": (("pts_g",), _f("pts_g", "pt_id")),
    "tf": (("tris_g",), _f("tris_g", "tri_id")),
    "ef": (("esmooth",), _f("esmooth", "edge_id")),
} | _forest("primal", "pf", "pt_id", "from_pt", "to_pt", "-") | _forest("dual", "tf", "tri_id", "from_tri", "to_tri", "")
FRAGMENTS |= {
    "prim_saddles": (("primal",), "SELECT e.sample, e.edge_id FROM xedges e JOIN primal p ON p.sample = e.sample AND p.node = e.from_pt JOIN primal q ON q.sample = e.sample AND q.node = e.to_pt WHERE p.root <> q.root"),
    "dual_saddles": (("dual",), "SELECT e.sample, e.edge_id FROM xedges e JOIN dual p ON p.sample = e.sample AND p.node = e.from_tri JOIN dual q ON q.sample = e.sample AND q.node = e.to_tri WHERE p.root <> q.root"),
    "saddles": (("prim_saddles", "dual_saddles"), "SELECT sample, edge_id FROM prim_saddles INTERSECT (SELECT sample, edge_id FROM dual_saddles UNION SELECT sample, edge_id FROM xedges WHERE boundary)"),
    "sep": (("saddles",), """SELECT sample, edge_id FROM saddles UNION SELECT d.sample, d.parent_edge FROM dual d WHERE d.parent_edge IS NOT NULL AND (d.sample, d.node) IN (SELECT (u.sample, u.above) FROM dual_up u
      JOIN (SELECT e.sample, unnest([e.from_tri, e.to_tri]) AS node FROM xedges e JOIN saddles s ON s.sample = e.sample AND s.edge_id = e.edge_id) t ON t.sample = u.sample AND t.node = u.node)"""),
    "inner_edges": (("sep",), "SELECT e.sample, e.from_pt AS a, e.to_pt AS b FROM xedges e WHERE (e.sample, e.edge_id) NOT IN (SELECT (sample, edge_id) FROM sep)"),
    "together": (("inner_edges",), "SELECT sample, pt_id AS node, pt_id AS other FROM cells UNION SELECT t.sample, t.node, CASE WHEN n.a = t.other THEN n.b ELSE n.a END FROM together t JOIN inner_edges n ON n.sample = t.sample AND (n.a = t.other OR n.b = t.other)"),
    "tiles_pt": (("together",), "SELECT sample, node AS pt_id, dense_rank() OVER (PARTITION BY sample ORDER BY min(other)) AS tile_id FROM together GROUP BY sample, node"),
    "tedges": (("tiles_pt",), "SELECT e.*, s.tile_id AS tile_from, t.tile_id AS tile_to FROM xedges e JOIN tiles_pt s ON s.sample = e.sample AND s.pt_id = e.from_pt JOIN tiles_pt t ON t.sample = e.sample AND t.pt_id = e.to_pt"),
    "turned": (("tedges",), """SELECT sample, tile_from, tile_to, boundary, l, CASE WHEN l THEN x0_tri ELSE x1_tri END AS rx, CASE WHEN l THEN y0_tri ELSE y1_tri END AS ry, CASE WHEN l THEN x1_tri ELSE x0_tri END AS lx, CASE WHEN l THEN y1_tri ELSE y0_tri END AS ly,
      x0_pt AS ax, y0_pt AS ay, x1_pt AS bx, y1_pt AS by_, x0_tri AS mx, y0_tri AS my FROM (SELECT *, (x1_pt-x0_pt)*(y1_tri-y0_pt)-(y1_pt-y0_pt)*(x1_tri-x0_pt) > 0 AS l FROM tedges)"""),
    "segments": (("turned",), """SELECT sample, tile_from AS tile_id, rx AS px, ry AS py, lx AS qx, ly AS qy FROM turned WHERE tile_from <> tile_to UNION ALL SELECT sample, tile_to, lx, ly, rx, ry FROM turned WHERE tile_from <> tile_to
      UNION ALL SELECT sample, tile_from, CASE WHEN l THEN ax ELSE mx END, CASE WHEN l THEN ay ELSE my END, CASE WHEN l THEN mx ELSE ax END, CASE WHEN l THEN my ELSE ay END FROM turned WHERE tile_from <> tile_to AND boundary
      UNION ALL SELECT sample, tile_to, CASE WHEN l THEN mx ELSE bx END, CASE WHEN l THEN my ELSE by_ END, CASE WHEN l THEN bx ELSE mx END, CASE WHEN l THEN by_ ELSE my END FROM turned WHERE tile_from <> tile_to AND boundary
      UNION ALL SELECT sample, tile_from, CASE WHEN l THEN ax ELSE bx END, CASE WHEN l THEN ay ELSE by_ END, CASE WHEN l THEN bx ELSE ax END, CASE WHEN l THEN by_ ELSE ay END FROM turned WHERE tile_from = tile_to AND boundary"""),
    "measures": (("segments",), "SELECT sample, tile_id, sum(px*qy-qx*py)/2 AS area, sum(sqrt((qx-px)**2+(qy-py)**2)) AS perimeter FROM segments GROUP BY ALL"),
    "tiles": (("measures",), "SELECT c.sample, t.tile_id, avg(x) AS x, avg(y) AS y, count(*) AS npts, any_value(area) AS area, any_value(perimeter) AS perimeter FROM cells c JOIN tiles_pt t USING (sample, pt_id) LEFT JOIN measures m ON m.sample = c.sample AND m.tile_id = t.tile_id GROUP BY c.sample, t.tile_id"),
    "tile_emb": (("tiles_pt", "feats"), "SELECT f.sample, t.tile_id, f.dim, avg(v) AS v FROM feats f JOIN tiles_pt t USING (sample, pt_id) GROUP BY ALL"),
    "borders": (("tiles",), """SELECT sample, least(tile_from, tile_to) AS from_tile, greatest(tile_from, tile_to) AS to_tile, sum(sqrt((x1_tri-x0_tri)**2+(y1_tri-y0_tri)**2)) AS edge_length FROM tedges WHERE tile_from <> tile_to GROUP BY ALL"""),
    "scored": (("borders", "tile_emb"), """SELECT b.*, s.npts AS n0, t.npts AS n1, s.area AS a0, t.area AS a1, s.perimeter AS p0, t.perimeter AS p1,
      (SELECT sqrt(sum((u.v-w.v)**2)) FROM tile_emb u JOIN tile_emb w ON w.sample = u.sample AND w.dim = u.dim WHERE u.sample = b.sample AND u.tile_id = b.from_tile AND w.tile_id = b.to_tile) AS d
      FROM borders b JOIN tiles s ON s.sample = b.sample AND s.tile_id = b.from_tile JOIN tiles t ON t.sample = b.sample AND t.tile_id = b.to_tile"""),
    "supp": ((), "SELECT l_suppkey AS cell_id, p_brand AS gene, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"),
    "normed": (("supp",), "SELECT cell_id, gene, ln(1 + (SELECT median(t) FROM (SELECT sum(n) AS t FROM supp GROUP BY cell_id)) * n / sum(n) OVER (PARTITION BY cell_id)) AS value FROM supp"),
    "ordered": (("borders",), """SELECT sample, node, row_number() OVER (PARTITION BY sample ORDER BY node) AS i
      FROM (SELECT sample, from_tile AS node FROM borders UNION SELECT sample, to_tile FROM borders)"""),
    "before": (("ordered",), """SELECT o.sample, o.i, list(DISTINCT p.i) AS js FROM ordered o
      JOIN borders b ON b.sample = o.sample AND o.node IN (b.from_tile, b.to_tile)
      JOIN ordered p ON p.sample = o.sample AND p.node IN (b.from_tile, b.to_tile) AND p.i < o.i
      GROUP BY o.sample, o.i"""),
    # a node a step, in order: the least colour that no neighbour before it has
    "painted": (("before",), """SELECT DISTINCT sample, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS colours FROM ordered
      UNION ALL
      SELECT p.sample, o.i, list_append(p.colours, list_min(list_filter(range(o.i), lambda c: NOT list_contains(list_transform(coalesce(b.js, []), lambda j: p.colours[j]), c))))
      FROM painted p JOIN ordered o ON o.sample = p.sample AND o.i = p.i + 1 LEFT JOIN before b ON b.sample = o.sample AND b.i = o.i"""),
    "knn10": (("feats",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM (
        SELECT a.pt_id AS id, b.pt_id AS other, round(1 - sum(a.v*b.v)/(sqrt(sum(a.v*a.v))*sqrt(sum(b.v*b.v))), 12) AS distance
        FROM feats a JOIN feats b ON a.dim = b.dim AND a.pt_id <> b.pt_id GROUP BY a.pt_id, b.pt_id)) WHERE rank <= 10"""),
    "beyond": (("knn10",), """SELECT *, greatest(distance - coalesce(min(CASE WHEN distance > 0 THEN distance END) OVER (PARTITION BY id), 0), 0) AS far FROM knn10"""),
    "far_lists": (("beyond",), "SELECT id, list(far ORDER BY rank) AS far, avg(distance) AS mean FROM beyond GROUP BY id"),
    # halving, until the memberships sum to the logarithm of the list's length
    "sigmas": (("far_lists",), """SELECT id, 0 AS n, CAST(0 AS DOUBLE) AS low, CAST('inf' AS DOUBLE) AS high, CAST(1 AS DOUBLE) AS sigma, false AS done FROM far_lists
      UNION ALL
      SELECT id, n + 1, CASE WHEN fits OR above THEN low ELSE sigma END, CASE WHEN above AND NOT fits THEN sigma ELSE high END,
        CASE WHEN fits THEN sigma WHEN above THEN (low + sigma) / 2 WHEN isinf(high) THEN sigma * 2 ELSE (sigma + high) / 2 END, fits
      FROM (SELECT g.*, abs(s - t) < 1e-5 AS fits, s > t AS above FROM (
        SELECT g.*, list_sum(list_transform(f.far, lambda x: exp(-x / g.sigma))) AS s, log2(greatest(len(f.far), 2)) AS t FROM sigmas g JOIN far_lists f USING (id) WHERE NOT done AND n < 64) g)"""),
    "members": (("sigmas",), """SELECT b.id, b.other, exp(-b.far / greatest(s.sigma, 1e-3 * f.mean, 1e-12)) AS w
      FROM beyond b JOIN far_lists f USING (id) JOIN (SELECT id, arg_max(sigma, n) AS sigma FROM sigmas GROUP BY id) s USING (id)"""),
    "border_lists": (("scored",), """SELECT sample, list(d ORDER BY d) AS ds, count(*) AS n, greatest(1e-8 * var_pop(d), 1e-300) AS floor_ FROM scored GROUP BY sample"""),
    # expectation and maximisation, a round a step, with equal and with free variances; shares s0, s1 of the two components
    "em": (("border_lists",), """SELECT sample, free, 0 AS round, list_transform(range(n), lambda i: CAST(i < n // 2 AS DOUBLE)) AS s0, list_transform(range(n), lambda i: CAST(i >= n // 2 AS DOUBLE)) AS s1,
        CAST(NULL AS DOUBLE) AS m0, CAST(NULL AS DOUBLE) AS m1, CAST(NULL AS DOUBLE) AS v0, CAST(NULL AS DOUBLE) AS v1, CAST('-inf' AS DOUBLE) AS likely, false AS done
      FROM border_lists, (SELECT unnest([false, true]) AS free) WHERE n >= 4 AND ds[1] <> ds[-1]
      UNION ALL
      SELECT sample, free, round + 1, list_transform(range(n), lambda i: exp(l0[i + 1] - l[i + 1])), list_transform(range(n), lambda i: exp(l1[i + 1] - l[i + 1])), m0, m1, v0, v1, list_sum(l),
        abs(list_sum(l) - before) < 1e-9 * abs(list_sum(l)) + 1e-12
      FROM (SELECT *, list_transform(range(n), lambda i: greatest(l0[i + 1], l1[i + 1]) + ln(exp(l0[i + 1] - greatest(l0[i + 1], l1[i + 1])) + exp(l1[i + 1] - greatest(l0[i + 1], l1[i + 1])))) AS l
      FROM (SELECT *, list_transform(ds, lambda d: ln(n0 / n) - 0.5 * (ln(2 * pi() * v0) + (d - m0) ** 2 / v0)) AS l0, list_transform(ds, lambda d: ln(n1 / n) - 0.5 * (ln(2 * pi() * v1) + (d - m1) ** 2 / v1)) AS l1
      FROM (SELECT * EXCLUDE (q0, q1), greatest(CASE WHEN free THEN q0 / n0 ELSE (q0 + q1) / n END, floor_) AS v0, greatest(CASE WHEN free THEN q1 / n1 ELSE (q0 + q1) / n END, floor_) AS v1
      FROM (SELECT *, list_dot_product(s0, list_transform(ds, lambda d: (d - m0) ** 2)) AS q0, list_dot_product(s1, list_transform(ds, lambda d: (d - m1) ** 2)) AS q1
      FROM (SELECT *, list_dot_product(s0, ds) / n0 AS m0, list_dot_product(s1, ds) / n1 AS m1
      FROM (SELECT e.sample, e.free, e.round, e.s0, e.s1, e.likely AS before, b.ds, b.n, b.floor_, greatest(list_sum(e.s0), 1e-12) AS n0, greatest(list_sum(e.s1), 1e-12) AS n1
      FROM em e JOIN border_lists b USING (sample) WHERE NOT e.done AND e.round < 500))))))"""),
    "mixed": (("em",), """SELECT b.sample, coalesce(m.mean, list_avg(b.ds)) AS mean, coalesce(m.sd, nullif(list_stddev_pop(b.ds), 0), 1) AS sd FROM border_lists b LEFT JOIN (
      SELECT sample, CASE WHEN m0 <= m1 THEN m0 ELSE m1 END AS mean, sqrt(CASE WHEN m0 <= m1 THEN v0 ELSE v1 END) AS sd FROM (
        SELECT *, 2 * likely - (CASE WHEN free THEN 5 ELSE 4 END) * ln(len(s0)) AS bic FROM em QUALIFY row_number() OVER (PARTITION BY sample, free ORDER BY round DESC) = 1)
      QUALIFY row_number() OVER (PARTITION BY sample ORDER BY bic DESC, free) = 1) m USING (sample)"""),
}
RECURSIVE = {"reached", "hops", "together", "primal_up", "dual_up", "painted", "sigmas", "em"}


def sql(select: str, *needs: str) -> str:
    """The statement with every fragment that it needs, each once and before its users."""
    order: list[str] = []

    def add(name):
        for n in FRAGMENTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({FRAGMENTS[n][1]})" for n in order]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def rounded(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def integration_sql(clusters: int, rounds: int, inner: int, theta: float = 2.0, lam: float = 1.0, sigma: float = 0.1) -> str:
    """Rounds of batch integration with the sample as the batch, one after another. With one variable the ridge's normal equations have a closed form: the level of a
    cluster is sum(S / (N + lam)) / sum(N / (N + lam)) over its batches, and a batch adds (S - N level) / (N + lam)."""
    steps = [
        f"""z0 AS MATERIALIZED (
  SELECT vec_id AS id, label AS b, list_transform(range({DIMS}), lambda d: CAST(embedding[d + 3] AS DOUBLE)) AS z FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
)""",
        "shares AS (SELECT b, count(*) / (SELECT count(*) FROM z0) AS share FROM z0 GROUP BY b)",
        f"""y0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256(CAST(id AS VARCHAR))) AS k, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS y FROM z0 QUALIFY k <= {clusters}
)""",
        "p0 AS (SELECT k, b, 1.0 AS pen FROM y0, shares)",
    ]

    def members(name: str, of: int, y: int) -> str:
        """Memberships by the vectors of correction ``of`` and the state of pass ``y``."""
        return f"""{name} AS MATERIALIZED (
  SELECT id, b, z, u, k, w / sum(w) OVER (PARTITION BY id) AS r FROM (
    SELECT c.id, c.b, c.z, c.u, y.k, exp(-2 * (1 - list_dot_product(c.u, y.y)) / {sigma}) * pen AS w FROM u{of} c JOIN p{y} p USING (b) JOIN y{y} y USING (k))
)"""

    at = 0
    for turn in range(rounds):
        now = "z" if turn == 0 else "now"
        steps.append(f"u{turn} AS MATERIALIZED (SELECT id, b, z, list_transform({now}, lambda x: x / sqrt(list_dot_product({now}, {now}))) AS u FROM z{turn})")
        for _ in range(inner):
            at += 1
            held = "n" if at == 1 else "(n + o) / 2"
            before = "" if at == 1 else f" JOIN o{at - 1} USING (k, b)"
            steps += [
                members(f"r{at}", turn, at - 1),
                f"v{at} AS (SELECT k, list(v ORDER BY j) AS v FROM (SELECT k, j, sum(r * u[j + 1]) AS v FROM r{at}, range({DIMS}) t(j) GROUP BY k, j) GROUP BY k)",
                f"y{at} AS MATERIALIZED (SELECT k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS y FROM v{at})",
                f"o{at} AS MATERIALIZED (SELECT k, b, {held} AS o FROM (SELECT k, b, sum(r) AS n FROM r{at} GROUP BY k, b){before})",
                f"p{at} AS MATERIALIZED (SELECT k, b, pow((sum(o) OVER (PARTITION BY k) * share + 1) / (o + 1), {theta}) AS pen FROM o{at} JOIN shares USING (b))",
            ]
        steps += [
            members(f"f{turn}", turn, at),
            f"""s{turn} AS MATERIALIZED (SELECT k, b, j, sum(r) AS n, sum(r * z[j + 1]) AS s FROM f{turn}, range({DIMS}) t(j) GROUP BY k, b, j)""",
            f"""b{turn} AS MATERIALIZED (
  SELECT k, b, list(m ORDER BY j) AS m FROM (
    SELECT k, b, j, (s - n * sum(s / (n + {lam})) OVER w / sum(n / (n + {lam})) OVER w) / (n + {lam}) AS m FROM s{turn} WINDOW w AS (PARTITION BY k, j)
  ) GROUP BY k, b
)""",
            f"""z{turn + 1} AS MATERIALIZED (
  SELECT id, b, any_value(z) AS z, list(v ORDER BY j) AS now FROM (
    SELECT id, b, j, any_value(z) AS z, any_value(z)[j + 1] - sum(r * m[j + 1]) AS v FROM f{turn} JOIN b{turn} USING (k, b), range({DIMS}) t(j) GROUP BY id, b, j
  ) GROUP BY id, b
)""",
        ]
    return f"WITH {', '.join(steps)} SELECT id AS cell_id, dim, round(now[dim + 1], 6) + 0.0 AS v FROM z{rounds}, range({DIMS}) d(dim)"
