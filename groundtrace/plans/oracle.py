"""The catalogue's queries as SQL for DuckDB, put together from named parts.

Written independently of the DataFrame code: relational joins where that uses arrays, Vincenty's series
where that uses quadrature.
"""

from __future__ import annotations

import re


from groundtrace.sources.targets import CATALOGUE

CAP = 10.0


def _segments() -> str:
    rows = []
    for name, shape in CATALOGUE.items():
        many = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
        for p, polygon in enumerate(many):
            for r, ring in enumerate(polygon):
                rows += [f"('{name}', {p}, {r}, {s}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for s, (a, b) in enumerate(zip(ring, ring[1:], strict=False))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(target_id, polygon, ring, segment, ax, ay, bx, by)"


A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)


def _vincenty(rounds: int = 9) -> dict[str, str]:
    """Distances of the distinct pairs of points in ``point_pairs``; equal points have 0."""
    parts = {
        "v_start": f"""SELECT *, radians(x1 - x0) AS l, radians(x1 - x0) AS lam, atan({1 - FLATTENING!r} * tan(radians(y0))) AS u1, atan({1 - FLATTENING!r} * tan(radians(y1))) AS u2
            FROM point_pairs WHERE x0 <> x1 OR y0 <> y1"""
    }
    before = "v_start"
    for k in range(rounds):
        parts[f"v_a{k}"] = f"""SELECT x0, y0, x1, y1, l, lam, u1, u2, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM {before}"""
        parts[f"v_b{k}"] = f"SELECT *, atan2(ss, cs) AS sigma, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM v_a{k}"
        parts[f"v_c{k}"] = f"SELECT *, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm FROM v_b{k}"
        parts[f"v_d{k}"] = f"""SELECT x0, y0, x1, y1, l, u1, u2, ss, cs, sigma, sa, ca2, cm, l + (1 - c) * {FLATTENING!r} * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm))) AS lam
            FROM (SELECT *, {FLATTENING / 16!r} * ca2 * (4 + {FLATTENING!r} * (4 - 3 * ca2)) AS c FROM v_c{k})"""
        before = f"v_d{k}"
    square = (A * A - B * B) / (B * B)
    parts["v_series"] = f"""SELECT *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) AS aa, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) AS bb
        FROM (SELECT *, ca2 * {square!r} AS k2 FROM {before})"""
    parts["distances"] = f"""SELECT x0, y0, x1, y1, {B!r} * aa * (sigma - bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm * cm) - bb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))) AS metres
        FROM v_series UNION ALL SELECT x0, y0, x1, y1, 0.0 FROM point_pairs WHERE x0 = x1 AND y0 = y1"""
    return parts


PARTS: dict[str, str] = {
    "samples": """SELECT user_id AS track_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS record_index, event_type <> 'error' AS positioned,
        CASE WHEN event_type <> 'error' THEN CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 - 8 AS DOUBLE) / 8 END AS lon,
        CASE WHEN event_type <> 'error' THEN CAST((37 * event_id) % 16 - 8 AS DOUBLE) / 8 END AS lat,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN epoch_us(ts) - CASE WHEN event_id % 41 = 0 THEN 172800000000 ELSE 0 END END AS us FROM events""",
    "marked": "SELECT *, CASE WHEN positioned AND NOT coalesce(lag(positioned) OVER (PARTITION BY track_id ORDER BY event_id), false) THEN 1 ELSE 0 END AS starts FROM samples",
    "placed": "SELECT *, sum(starts) OVER (PARTITION BY track_id ORDER BY event_id) - 1 AS part_index FROM marked",
    "obs": """SELECT track_id, part_index, row_number() OVER (PARTITION BY track_id, part_index ORDER BY event_id) - 1 AS observation_index,
        row_number() OVER (PARTITION BY track_id ORDER BY event_id) - 1 AS lineage_index, record_index, event_id, lon, lat, us FROM placed WHERE positioned""",
    "seen": """SELECT p.track_id, p.event_id, p.record_index, p.positioned, o.part_index AS op, o.observation_index AS oo FROM placed p LEFT JOIN obs o ON p.track_id = o.track_id AND p.event_id = o.event_id""",
    "diag": """SELECT track_id, event_id, record_index, prev_part, prev_obs, next_part, next_obs, row_number() OVER (PARTITION BY track_id ORDER BY event_id) - 1 AS diagnostic_index FROM (
        SELECT *, last_value(op IGNORE NULLS) OVER b AS prev_part, last_value(oo IGNORE NULLS) OVER b AS prev_obs, first_value(op IGNORE NULLS) OVER f AS next_part, first_value(oo IGNORE NULLS) OVER f AS next_obs FROM seen
        WINDOW b AS (PARTITION BY track_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY track_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ) WHERE NOT positioned""",
    "edges": """SELECT a.track_id, a.part_index, a.observation_index AS edge_index, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1, a.us AS us0, b.us AS us1, a.lineage_index AS lineage0, b.lineage_index AS lineage1
        FROM obs a JOIN obs b ON a.track_id = b.track_id AND a.part_index = b.part_index AND b.observation_index = a.observation_index + 1""",
    "point_pairs": "SELECT DISTINCT x0, y0, x1, y1 FROM edges",
    **_vincenty(),
    "decided": f"""SELECT e.*, d.metres, CASE WHEN us0 IS NULL OR us1 IS NULL THEN 'SPEED_TIME_MISSING' WHEN us1 <= us0 THEN 'SPEED_TIME_NONINCREASING'
        WHEN metres - 1e-6 > {CAP} * (us1 - us0) / 1e6 THEN 'IMPLIED_SPEED_EXCEEDS_POLICY' WHEN metres + 1e-6 > {CAP} * (us1 - us0) / 1e6 THEN 'SPEED_NUMERICALLY_INDETERMINATE' ELSE 'ADMITTED' END AS decision
        FROM edges e JOIN distances d USING (x0, y0, x1, y1)""",
    "runs": "SELECT *, sum(CASE WHEN decision = 'IMPLIED_SPEED_EXCEEDS_POLICY' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, part_index ORDER BY edge_index) AS run FROM decided",
    "usable": "SELECT * FROM runs WHERE decision <> 'IMPLIED_SPEED_EXCEEDS_POLICY'",
    "intervals": "SELECT track_id, part_index, min(edge_index) AS low, max(edge_index) + 1 AS high FROM usable GROUP BY track_id, part_index, run",
    "excluded": """SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY part_index, edge_index) - 1 AS excluded_index, part_index, edge_index, decision AS reason, lineage0, lineage1
        FROM decided WHERE decision = 'IMPLIED_SPEED_EXCEEDS_POLICY'""",
    "source_gaps": """SELECT track_id, prev_part AS start_part, prev_obs AS start_obs, next_part AS end_part, next_obs AS end_obs, 'source_gap' AS kind, 'POSITION_MISSING' AS causes,
        string_agg(CAST(diagnostic_index AS VARCHAR), ',' ORDER BY diagnostic_index) AS diagnostic_indices, min(diagnostic_index) AS first_diag, CAST(NULL AS BIGINT) AS excluded_index FROM diag GROUP BY ALL""",
    "quality_gaps": """SELECT track_id, part_index AS start_part, edge_index AS start_obs, part_index AS end_part, edge_index + 1 AS end_obs, 'quality_exclusion' AS kind, reason AS causes, '' AS diagnostic_indices, 0 AS first_diag, excluded_index FROM excluded""",
    "gaps": """SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(start_part, -1), coalesce(start_obs, -1), coalesce(end_part, 1000000000), coalesce(end_obs, 0), kind, first_diag) - 1 AS gap_index
        FROM (SELECT * FROM source_gaps UNION ALL SELECT * FROM quality_gaps)""",
    "segs": _segments(),
    "names": "SELECT DISTINCT target_id FROM segs",
    "pairs": "SELECT * FROM usable, names WHERE x0 <> x1 OR y0 <> y1",
    "products": """SELECT p.track_id, p.part_index, p.edge_index, p.target_id, x0, y0, x1, y1, ax, ay, bx, by, (x1 - x0) * (by - ay) - (y1 - y0) * (bx - ax) AS det,
        (ax - x0) * (by - ay) - (ay - y0) * (bx - ax) AS along, (ax - x0) * (y1 - y0) - (ay - y0) * (x1 - x0) AS across,
        CASE WHEN abs(x1 - x0) >= abs(y1 - y0) THEN (ax - x0) / (x1 - x0) ELSE (ay - y0) / (y1 - y0) END AS ta, CASE WHEN abs(x1 - x0) >= abs(y1 - y0) THEN (bx - x0) / (x1 - x0) ELSE (by - y0) / (y1 - y0) END AS tb
        FROM pairs p JOIN segs USING (target_id)""",
    "critical": """SELECT track_id, part_index, edge_index, target_id, t FROM (
        SELECT track_id, part_index, edge_index, target_id, along / det AS t FROM products WHERE det <> 0 AND across / det BETWEEN 0 AND 1
        UNION ALL SELECT track_id, part_index, edge_index, target_id, ta FROM products WHERE det = 0 AND across = 0 UNION ALL SELECT track_id, part_index, edge_index, target_id, tb FROM products WHERE det = 0 AND across = 0
        UNION ALL SELECT track_id, part_index, edge_index, target_id, 0.0 FROM pairs UNION ALL SELECT track_id, part_index, edge_index, target_id, 1.0 FROM pairs) WHERE t BETWEEN 0 AND 1 GROUP BY ALL""",
    "spans": "SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY track_id, part_index, edge_index, target_id ORDER BY t) AS hi FROM critical) WHERE hi IS NOT NULL",
    "classed": """SELECT s.track_id, s.part_index, s.edge_index, s.target_id, t + 0.0 AS lo, hi,
        coalesce(bool_or(det = 0 AND across = 0 AND least(ta, tb) <= t AND greatest(ta, tb) >= hi), false)
        OR sum(CASE WHEN (ay > y0 + (t + hi) / 2 * (y1 - y0)) <> (by > y0 + (t + hi) / 2 * (y1 - y0))
          AND x0 + (t + hi) / 2 * (x1 - x0) < (bx - ax) * (y0 + (t + hi) / 2 * (y1 - y0) - ay) / nullif(by - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS covered
        FROM spans s JOIN products m ON s.track_id = m.track_id AND s.part_index = m.part_index AND s.edge_index = m.edge_index AND s.target_id = m.target_id GROUP BY ALL""",
    "turns": "SELECT *, CASE WHEN lag(covered) OVER (PARTITION BY track_id, part_index, edge_index, target_id ORDER BY lo) = covered THEN 0 ELSE 1 END AS turn FROM classed",
    "islands": "SELECT *, sum(turn) OVER (PARTITION BY track_id, part_index, edge_index, target_id ORDER BY lo) AS island FROM turns",
    "frags": "SELECT track_id, target_id, part_index, edge_index, island - 1 AS fragment, min(lo) AS lo, max(hi) AS hi, covered FROM islands GROUP BY track_id, target_id, part_index, edge_index, island, covered",
    "still": """SELECT u.track_id, target_id, part_index, edge_index, run,
        bool_or((bx - ax) * (y0 - ay) - (by - ay) * (x0 - ax) = 0 AND x0 BETWEEN least(ax, bx) AND greatest(ax, bx) AND y0 BETWEEN least(ay, by) AND greatest(ay, by))
        OR sum(CASE WHEN (ay > y0) <> (by > y0) AND x0 < (bx - ax) * (y0 - ay) / nullif(by - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS covered
        FROM usable u, segs WHERE x0 = x1 AND y0 = y1 GROUP BY u.track_id, target_id, part_index, edge_index, run""",
    "relevance": """SELECT g.*, target_id, CASE WHEN target_id = 'T6' THEN 'covered' ELSE 'intersects' END AS classification,
        CASE WHEN kind = 'source_gap' THEN 'SOURCE_GAP_TARGET_UNRESOLVED' ELSE 'QUALITY_GAP_TARGET_UNRESOLVED' END AS reason, target_id <> 'T6' AS possible_outside FROM gaps g, names""",
    "facts": "SELECT track_id, target_id, bool_or(covered) AS has_in, bool_or(NOT covered) AS has_out FROM frags GROUP BY ALL",
    "doubts": "SELECT track_id, target_id, count(*) > 0 AS relevant, bool_or(possible_outside) AS maybe FROM relevance GROUP BY track_id, target_id",
    "told": """SELECT t.track_id, target_id, coalesce(has_in, false) AS i, coalesce(has_out, false) AS o, coalesce(relevant, false) AS r, coalesce(maybe, false) AS m
        FROM (SELECT DISTINCT track_id FROM obs) t CROSS JOIN names LEFT JOIN facts USING (track_id, target_id) LEFT JOIN doubts USING (track_id, target_id)""",
    "relations": """SELECT track_id, target_id, i OR o AS assessable, CASE WHEN NOT (i OR o) THEN NULL WHEN i AND o THEN 'partial' WHEN i AND NOT m THEN 'inside' WHEN o AND NOT r THEN 'outside' ELSE 'unknown' END AS relation,
        CASE WHEN NOT (i OR o) THEN NULL WHEN r THEN 'incomplete' ELSE 'complete' END AS completeness, CASE WHEN NOT (i OR o) THEN 'NO_POSITIVE_LENGTH_USABLE_GEOMETRY' END AS reason FROM told""",
    "coverage": """SELECT f.track_id, f.target_id, f.part_index, u.run, f.edge_index + lo AS a, f.edge_index AS so, lo AS sf, CASE WHEN hi = 1 THEN f.edge_index + 1 ELSE f.edge_index END AS eo, CASE WHEN hi = 1 THEN 0.0 ELSE hi END AS ef, 1 AS positive
        FROM frags f JOIN usable u ON f.track_id = u.track_id AND f.part_index = u.part_index AND f.edge_index = u.edge_index WHERE f.covered
        UNION ALL SELECT track_id, target_id, part_index, run, edge_index, edge_index, 0.0, edge_index + 1, 0.0, 0 FROM still WHERE covered""",
    "linked": """SELECT *, CASE WHEN lag(eo) OVER w = so AND lag(ef) OVER w = sf THEN 0 ELSE 1 END AS begins FROM coverage WINDOW w AS (PARTITION BY track_id, target_id, part_index, run ORDER BY so, sf, eo, ef)""",
    "grouped": "SELECT *, sum(begins) OVER (PARTITION BY track_id, target_id, part_index, run ORDER BY so, sf, eo, ef ROWS UNBOUNDED PRECEDING) AS island FROM linked",
    "bounds": """SELECT track_id, target_id, part_index, run, arg_min(so, so + sf) AS so, arg_min(sf, so + sf) AS sf, arg_max(eo, eo + ef) AS eo, arg_max(ef, eo + ef) AS ef, count(*) AS pieces
        FROM grouped GROUP BY track_id, target_id, part_index, run, island HAVING max(positive) = 1""",
    "segments": "SELECT *, row_number() OVER (PARTITION BY track_id, target_id ORDER BY part_index, so, sf) - 1 AS ordinal FROM bounds",
    "seg_edges": """SELECT s.track_id, s.target_id, s.ordinal, s.part_index, u.edge_index, u.edge_index - so AS fragment_ordinal, CASE WHEN u.edge_index = so THEN sf ELSE 0.0 END AS f0,
        CASE WHEN u.edge_index = eo AND ef > 0 THEN ef ELSE 1.0 END AS f1, x0, y0, x1, y1, us0, us1, decision
        FROM segments s JOIN usable u ON s.track_id = u.track_id AND s.part_index = u.part_index AND u.edge_index >= so AND (u.edge_index < eo OR (u.edge_index = eo AND ef > 0))""",
    "ends": """SELECT *, CASE WHEN f0 = 0 THEN x0 ELSE x0 + f0 * (x1 - x0) END AS px, CASE WHEN f0 = 0 THEN y0 ELSE y0 + f0 * (y1 - y0) END AS py,
        CASE WHEN f1 = 1 THEN x1 ELSE x0 + f1 * (x1 - x0) END AS qx, CASE WHEN f1 = 1 THEN y1 ELSE y0 + f1 * (y1 - y0) END AS qy FROM seg_edges""",
    "vertices": """SELECT track_id, target_id, ordinal, fragment_ordinal AS vertex, px AS x, py AS y FROM ends
        UNION ALL SELECT track_id, target_id, ordinal, max(fragment_ordinal) + 1, arg_max(qx, fragment_ordinal), arg_max(qy, fragment_ordinal) FROM ends GROUP BY track_id, target_id, ordinal""",
}


def _metric_parts() -> dict[str, str]:
    """The chain once more for the clipped pieces."""
    own = {"piece_pairs": "SELECT DISTINCT px AS x0, py AS y0, qx AS x1, qy AS y1 FROM ends"}
    for name, text in _vincenty().items():
        new = "w" + name[1:] if name.startswith("v_") else "piece_distances"
        own[new] = text.replace("point_pairs", "piece_pairs").replace(" v_", " w_")
    own["metrics"] = """SELECT e.*, metres, px = qx AND py = qy AS stationary, CASE WHEN us0 IS NULL OR us1 IS NULL THEN 'missing_timestamp' WHEN us1 <= us0 THEN 'nonincreasing_timestamp'
        WHEN (us1 - us0) / 1e6 * (f1 - f0) <= 0 THEN 'nonincreasing_subinterval' WHEN abs(e.x1 - e.x0) > 180 THEN 'planar_dateline_ambiguous' ELSE 'valid' END AS status, (us1 - us0) / 1e6 * (f1 - f0) AS dt,
        CASE decision WHEN 'ADMITTED' THEN 'passed' WHEN 'SPEED_NUMERICALLY_INDETERMINATE' THEN 'indeterminate' ELSE 'unavailable' END AS screening
        FROM ends e JOIN piece_distances d ON px = d.x0 AND py = d.y0 AND qx = d.x1 AND qy = d.y1"""
    return own


PARTS |= _metric_parts()
#: The parts that each part reads.
READS = {name: {other for other in PARTS if other != name and any(f" {other}{c}" in f" {text} " for c in " ,)\n;")} for name, text in PARTS.items()}


def query(text: str) -> str:
    """A query with the parts that it needs before it."""
    wanted, todo = set(), [n for n in PARTS if any(f" {n}{c}" in f" {text} " for c in " ,)\n;")]
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += READS[name]
    ordered: list[str] = []

    def place(name: str) -> None:
        if name not in ordered:
            for other in sorted(READS[name]):
                place(other)
            ordered.append(name)

    for name in PARTS:
        if name in wanted:
            place(name)
    whole = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in ordered) + "\n" + text
    return re.sub(r"\bby\b", '"by"', whole)  # a column; the keyword is in capitals throughout


