"""DuckDB statements that recompute every registered result on the raw tables.

``PARTS`` holds named sub-queries; ``statement`` puts those a query needs, in order, into one WITH.
The statements are written from the definitions, not from the Spark plans, and take other routes
where one exists (closed forms, self joins, recursive sums).
"""

from __future__ import annotations

import re

from orderloom.functions.expr import LARGE_WORDS, NON_PRODUCT_CODES, SMALL_WORDS
from orderloom.operators.assign import SIZE_RANGES

CODES = ", ".join(f"'{c}'" for c in NON_PRODUCT_CODES)
ITEM = {
    "name": "p_name",
    "brand_type": "p_brand || '|' || p_type",
    "part": "'P' || l_partkey",
}
EIGHT = "invoice, stock_code, description, quantity, invoice_ts, price, customer_id, country"

PARTS: dict[str, str] = {}


def txn_part(grain: str) -> str:
    return f"""
SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey AS invoice,
       CASE WHEN l_partkey % 83 = 0 THEN 'POST' ELSE {ITEM[grain]} END AS stock_code,
       CASE WHEN l_partkey % 71 = 0 THEN NULL ELSE p_name END AS description,
       CASE WHEN l_partkey % 79 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS quantity,
       CAST(o_orderdate AS TIMESTAMP) AS invoice_ts,
       CASE WHEN l_partkey % 89 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / l_quantity END AS price,
       CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN n_regionkey = 0 THEN 'United Kingdom' ELSE n_name END AS country,
       'lineitem' AS source
FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 97 = 0) l
JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey
JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey"""


PARTS["lines1"] = f"SELECT DISTINCT {EIGHT} FROM txn"
PARTS["judged"] = f"""
SELECT *, starts_with(invoice, 'C') AS cancelled,
       stock_code IN ({CODES}) OR starts_with(lower(stock_code), 'gift_') AS listed
FROM lines1"""
_DERIVED = """CAST(quantity * price AS DECIMAL(18,4)) AS revenue, CAST(invoice_ts AS DATE) AS date,
       CAST(isoyear(invoice_ts) AS INT) AS iso_year, CAST(week(invoice_ts) AS INT) AS iso_week"""
PARTS["sales"] = f"""
SELECT {EIGHT}, customer_id IS NOT NULL AS known_customer, {_DERIVED},
       CAST(date_trunc('week', invoice_ts) AS DATE) + 6 AS week
FROM judged WHERE NOT cancelled AND NOT listed AND price > 0 AND quantity > 0"""
PARTS["returned"] = f"SELECT {EIGHT}, {_DERIVED} FROM judged WHERE cancelled AND NOT listed"
PARTS["log_counts"] = """
SELECT (SELECT count(*) FROM txn) AS n0, count(*) AS n1,
       count(*) FILTER (NOT cancelled) AS n2,
       count(*) FILTER (NOT cancelled AND NOT listed) AS n3,
       count(*) FILTER (NOT cancelled AND NOT listed AND price > 0) AS n4,
       count(*) FILTER (NOT cancelled AND NOT listed AND price > 0 AND quantity > 0) AS n5,
       count(*) FILTER (NOT cancelled AND NOT listed AND price > 0 AND quantity > 0
                        AND customer_id IS NULL) AS unknown
FROM judged"""

PARTS["items"] = """
SELECT stock_code, revenue, row_number() OVER (ORDER BY revenue DESC, stock_code) AS rank
FROM (SELECT stock_code, sum(revenue) AS revenue FROM sales GROUP BY 1)
QUALIFY rank <= 200"""
PARTS["weeks"] = """
SELECT CAST(w AS DATE) AS week, row_number() OVER (ORDER BY w) - 1 AS idx
FROM (SELECT unnest(generate_series(min(week) + 7, max(week) - 7, INTERVAL 7 DAY)) AS w FROM sales)"""
PARTS["window_sales"] = """
SELECT s.* FROM sales s
WHERE s.stock_code IN (SELECT stock_code FROM items)
  AND s.week BETWEEN (SELECT min(week) FROM weeks) AND (SELECT max(week) FROM weeks)"""
PARTS["lines"] = "SELECT invoice, stock_code, quantity, invoice_ts, week FROM window_sales"
PARTS["grid"] = """
SELECT i.stock_code, w.week, CAST(coalesce(sum(l.quantity), 0) AS DOUBLE) AS units
FROM items i CROSS JOIN weeks w
LEFT JOIN lines l ON l.stock_code = i.stock_code AND l.week = w.week
GROUP BY 1, 2
QUALIFY w.week >= coalesce(min(w.week) FILTER (units <> 0) OVER (PARTITION BY i.stock_code), DATE '0001-01-01')"""
PARTS["demand"] = """
SELECT stock_code, week, units, row_number() OVER (PARTITION BY stock_code ORDER BY week) - 1 AS idx FROM grid"""
PARTS["win"] = """
WITH per AS (
  SELECT w.week, w.idx, count(l.week) AS n FROM weeks w LEFT JOIN lines l ON l.week = w.week GROUP BY 1, 2
), spans AS (
  SELECT a.week, (SELECT sum(b.n) FROM per b WHERE b.idx BETWEEN a.idx AND a.idx + 7) AS total
  FROM per a WHERE a.idx <= greatest(0, (SELECT count(*) FROM per) - 8)
), best AS (SELECT week FROM spans ORDER BY total DESC, week LIMIT 1)
SELECT w.week FROM weeks w, best WHERE w.week >= best.week AND w.week < best.week + 56"""
PARTS["win_lines"] = "SELECT * FROM lines WHERE week IN (SELECT week FROM win)"
PARTS["described"] = """
SELECT i.stock_code, coalesce(t.description, '') AS description
FROM items i LEFT JOIN (
  SELECT stock_code, description,
         row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) AS r
  FROM sales WHERE description IS NOT NULL GROUP BY 1, 2
) t ON t.stock_code = i.stock_code AND t.r = 1"""


def statement(final: str, grain: str = "name", **overrides: str) -> str:
    """``final`` with every part it names, directly or through other parts, in dependency order."""
    parts = {**PARTS, "txn": txn_part(grain), **overrides}
    done: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", sql)):
            if word in parts and word not in done and parts[word] is not sql:
                visit(parts[word])
                if word not in done:
                    done.append(word)

    visit(final)
    if not done:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]}\n)" for n in done) + "\n" + final


def u(seed: int, salt: str, key: str) -> str:
    """Keyed uniform draw: first 48 bits of md5('seed:salt:key') over 2^48."""
    return f"(CAST('0x' || substr(md5('{seed}:{salt}:' || {key}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


# ---- forecast
PARTS["classes"] = """
SELECT *, CASE WHEN nonzero = 0 THEN 'no-demand'
               WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic'
               WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS class,
       nonzero >= 5 AND n >= 38 AS eligible
FROM (
  SELECT stock_code, count(*) AS n, count(*) FILTER (units > 0) AS nonzero,
         count(*)::DOUBLE / nullif(count(*) FILTER (units > 0), 0) AS adi,
         CASE WHEN count(*) FILTER (units > 0) > 1
              THEN var_pop(units) FILTER (units > 0) / pow(avg(units) FILTER (units > 0), 2)
              WHEN count(*) FILTER (units > 0) = 1 THEN 0.0 END AS cv2
  FROM demand GROUP BY 1
)"""
PARTS["foldrows"] = """
SELECT stock_code, row_number() OVER (PARTITION BY stock_code ORDER BY k) AS fold, origin, origin AS train_weeks
FROM (SELECT stock_code, k, n - 8 - (2 - k) * 8 AS origin FROM classes, range(3) t(k) WHERE eligible)
WHERE origin >= 30"""
PARTS["origins"] = """
SELECT stock_code, fold, origin FROM foldrows
UNION ALL SELECT stock_code, 0, n FROM classes WHERE eligible"""
PARTS["points"] = """
SELECT stock_code, fold, units, k, idx - coalesce(before, -1) AS gap,
       count(*) OVER (PARTITION BY stock_code, fold) AS kk
FROM (
  SELECT o.stock_code, o.fold, d.units, d.idx,
         row_number() OVER w AS k, lag(d.idx) OVER w AS before
  FROM origins o JOIN demand d ON d.stock_code = o.stock_code AND d.idx < o.origin
  WHERE d.units > 0 WINDOW w AS (PARTITION BY o.stock_code, o.fold ORDER BY d.idx)
)"""
PARTS["rates"] = """
SELECT stock_code, fold, 0.95 * sum(w * units) / greatest(sum(w * gap), 1.0) AS rate
FROM (SELECT *, CASE WHEN k = 1 THEN pow(0.9, kk - 1) ELSE 0.1 * pow(0.9, kk - k) END AS w FROM points)
GROUP BY 1, 2"""
PARTS["preds"] = """
SELECT o.stock_code, o.fold, 'naive' AS model, i, greatest(d.units, 0.0) AS pred
FROM origins o JOIN demand d ON d.stock_code = o.stock_code AND d.idx = o.origin - 1, range(8) t(i)
UNION ALL
SELECT o.stock_code, o.fold, 'seasonal_naive', i, greatest(d.units, 0.0)
FROM origins o CROSS JOIN range(8) t(i)
JOIN demand d ON d.stock_code = o.stock_code
  AND d.idx = CASE WHEN o.origin < 52 THEN o.origin - 1 ELSE o.origin - 52 + i % 52 END
UNION ALL
SELECT o.stock_code, o.fold, 'croston_sba', i, coalesce(r.rate, 0.0)
FROM origins o LEFT JOIN rates r ON r.stock_code = o.stock_code AND r.fold = o.fold, range(8) t(i)"""
PARTS["scales"] = """
SELECT stock_code, fold, nullif(avg(abs(step)), 0) AS scale
FROM (
  SELECT o.stock_code, o.fold, d.units - lag(d.units) OVER (PARTITION BY o.stock_code, o.fold ORDER BY d.idx) AS step
  FROM foldrows o JOIN demand d ON d.stock_code = o.stock_code AND d.idx < o.origin
) GROUP BY 1, 2"""
PARTS["errs"] = """
SELECT p.stock_code, p.fold, p.model, p.i, d.units - p.pred AS e
FROM preds p JOIN foldrows f ON f.stock_code = p.stock_code AND f.fold = p.fold
JOIN demand d ON d.stock_code = p.stock_code AND d.idx = f.origin + p.i"""
PARTS["cv"] = """
SELECT e.stock_code, c.class, e.model, e.fold, any_value(f.train_weeks) AS train_weeks,
       avg(abs(e.e)) / any_value(s.scale) AS mase, avg(abs(e.e)) AS mae, list(e.e ORDER BY e.i) AS errors
FROM errs e JOIN classes c USING (stock_code) JOIN foldrows f USING (stock_code, fold)
JOIN scales s USING (stock_code, fold)
GROUP BY 1, 2, 3, 4"""
PARTS["winners"] = """
SELECT class, model, mean_mase, cells,
       row_number() OVER (PARTITION BY class ORDER BY mean_mase, model) = 1 AS winner
FROM (SELECT class, model, avg(mase) AS mean_mase, count(mase) AS cells FROM cv GROUP BY 1, 2)
WHERE mean_mase IS NOT NULL"""
PARTS["chosen"] = """
SELECT c.stock_code, c.class, coalesce(w.model, 'naive') AS model
FROM classes c LEFT JOIN (SELECT * FROM winners WHERE winner) w USING (class) WHERE eligible"""
PARTS["sigmas"] = """
SELECT e.stock_code, stddev_pop(e.e) AS sigma FROM errs e JOIN chosen USING (stock_code, model) GROUP BY 1"""
PARTS["forecasts"] = """
SELECT c.stock_code, last_week + 7 * (p.i::INT + 1) AS week, p.pred AS units, s.sigma, c.model, c.class
FROM chosen c JOIN preds p ON p.stock_code = c.stock_code AND p.model = c.model AND p.fold = 0
JOIN sigmas s ON s.stock_code = c.stock_code
JOIN (SELECT stock_code, max(week) AS last_week FROM demand GROUP BY 1) m ON m.stock_code = c.stock_code"""

# the regression: sums, elimination row by row, then one week after the other
_TERMS = ["1.0", "idx::DOUBLE / origin", "sin(2 * pi() * idx / (365.25 / 7))", "cos(2 * pi() * idx / (365.25 / 7))", "l1", "l2", "l3", "l4"]
PARTS["lagged"] = f"""
SELECT stock_code, fold, origin, [{', '.join(f'({t})::DOUBLE' for t in _TERMS)}, units] AS f FROM (
  SELECT o.stock_code, o.fold, o.origin, d.idx, d.units,
         lag(d.units, 1) OVER w AS l1, lag(d.units, 2) OVER w AS l2, lag(d.units, 3) OVER w AS l3, lag(d.units, 4) OVER w AS l4
  FROM origins o JOIN demand d ON d.stock_code = o.stock_code AND d.idx < o.origin
  WINDOW w AS (PARTITION BY o.stock_code, o.fold ORDER BY d.idx)
) WHERE idx >= 4"""
PARTS["normal0"] = "SELECT stock_code, fold, origin, [" + ", ".join(
    "[" + ", ".join(f"sum(f[{i}] * f[{j}])" for j in range(1, 10)) + "]" for i in range(1, 9)
) + "] AS m FROM lagged GROUP BY 1, 2, 3"
for _k in range(1, 9):
    PARTS[f"normal{_k}"] = f"""
SELECT stock_code, fold, origin, list_transform(m, lambda r, i: CASE WHEN i = {_k} THEN list_transform(r, lambda x: x / m[{_k}][{_k}])
       ELSE list_transform(r, lambda x, j: x - r[{_k}] * m[{_k}][j] / m[{_k}][{_k}]) END) AS m FROM normal{_k - 1}"""
_AHEAD = " + ".join(f"m[{k + 1}][9] * ({t})" for k, t in enumerate(_TERMS)).replace("idx", "(origin + i)")
for _k in range(1, 5):
    _AHEAD = _AHEAD.replace(f"(l{_k})", f"past[{_k}]")
PARTS["lag_paths"] = f"""
WITH RECURSIVE p AS (
  SELECT b.stock_code, b.fold, b.origin, b.m, 0 AS i, list(d.units ORDER BY d.idx DESC) AS past
  FROM normal8 b JOIN demand d ON d.stock_code = b.stock_code AND d.idx < b.origin AND d.idx >= b.origin - 4 GROUP BY ALL
  UNION ALL SELECT stock_code, fold, origin, m, i + 1, list_prepend({_AHEAD}, past[1:3]) FROM p WHERE i < 8
)
SELECT stock_code, fold, 'lag_linear' AS model, i - 1 AS i, greatest(past[1], 0.0) AS pred FROM p WHERE i > 0"""
ALL_PREDS = PARTS["preds"] + "\nUNION ALL SELECT stock_code, fold, model, i, pred FROM lag_paths"

# ---- replenishment and assigned attributes
Z = {0.90: "1.2815515655446004", 0.95: "1.6448536269514715", 0.99: "2.3263478740408408"}
PARTS["leads"] = f"""
SELECT i.stock_code, coalesce(f.class, 'unclassified') AS class,
       CASE f.class WHEN 'smooth' THEN 2 WHEN 'erratic' THEN 3 WHEN 'intermittent' THEN 4
                    WHEN 'lumpy' THEN 4 ELSE 3 END
       + CAST(floor({u(43, 'lead', 'i.stock_code')} * 2) AS INT) AS lead_time_weeks
FROM items i LEFT JOIN (SELECT DISTINCT stock_code, class FROM forecasts) f USING (stock_code)"""


def plan_sql(z: str, source: str = "forecasts") -> str:
    return f"""
SELECT stock_code, class, model, mu_weekly, sigma, lead_time_weeks,
       {z} * sqrt(lead_time_weeks + 1) * sigma AS safety_stock,
       mu_weekly * lead_time_weeks + {z} * sqrt(lead_time_weeks) * sigma AS reorder_point,
       mu_weekly * (lead_time_weeks + 1) + {z} * sqrt(lead_time_weeks + 1) * sigma AS order_up_to,
       mu_weekly * (lead_time_weeks + 1) + {z} * sqrt(lead_time_weeks + 1) * sigma AS order_qty,
       order_week, mu_weekly / 2 + {z} * sqrt(lead_time_weeks + 1) * sigma AS expected_stock
FROM (SELECT stock_code, any_value(class) AS class, any_value(model) AS model, avg(units) AS mu_weekly,
             any_value(sigma) AS sigma, min(week) AS order_week FROM {source} GROUP BY 1)
JOIN (SELECT stock_code, lead_time_weeks FROM leads) USING (stock_code)"""


PARTS["plan"] = plan_sql(Z[0.95])


def _draw(name: str, digits: int) -> str:
    lo = " ".join(f"WHEN '{c}' THEN {r[name][0]}" for c, r in SIZE_RANGES.items())
    hi = " ".join(f"WHEN '{c}' THEN {r[name][1]}" for c, r in SIZE_RANGES.items())
    a, b = f"(CASE size_class {lo} END)::DOUBLE", f"(CASE size_class {hi} END)::DOUBLE"
    return f"round({a} + ({b} - {a}) * {u(42, name, 'stock_code')}, {digits}) AS {name}"


_LARGE, _SMALL = "|".join(LARGE_WORDS), "|".join(SMALL_WORDS)
PARTS["sized"] = f"""
SELECT stock_code, CASE WHEN regexp_matches(upper(description), '{_LARGE}') THEN 'large'
                        WHEN regexp_matches(upper(description), '{_SMALL}') THEN 'small'
                        ELSE 'medium' END AS size_class
FROM described"""
PARTS["physical"] = f"""
SELECT stock_code, size_class, {_draw('length_cm', 1)}, {_draw('width_cm', 1)},
       {_draw('height_cm', 1)}, {_draw('weight_kg', 3)}
FROM sized"""
PARTS["slots"] = """
SELECT s::INT AS slot_id, (s // 25)::INT AS aisle, (s % 25)::INT AS bay,
       round(3.0::DOUBLE * (s // 25), 2) AS x_m, round(4.0::DOUBLE + 1.2::DOUBLE * (s % 25), 2) AS y_m,
       round(3.0::DOUBLE * (s // 25) + 4.0::DOUBLE + 1.2::DOUBLE * (s % 25), 2) AS distance_m
FROM (SELECT unnest(range(0, ceil(count(*) / 25.0)::BIGINT * 25)) AS s FROM items)"""
PARTS["lookup"] = """
SELECT invoice, coalesce('cust:' || arg_min(customer_id, (invoice_ts, customer_id)) FILTER (customer_id IS NOT NULL),
                         'guest:' || invoice) AS customer_key,
       arg_min(country, (invoice_ts, country)) FILTER (country IS NOT NULL) AS country
FROM sales GROUP BY 1"""


def xy(name: str, fn: str) -> str:
    r = (
        "sqrt(CASE WHEN country = 'United Kingdom' THEN 25.0::DOUBLE + (14400.0 - 25.0) * "
        f"{u(42, 'radius', 'customer_key')} ELSE 22500.0::DOUBLE + (90000.0 - 22500.0) * "
        f"{u(42, 'radius', 'customer_key')} END)"
    )
    return f"{r} * {fn}({u(42, 'angle', 'customer_key')} * 2 * pi()) AS {name}"


PARTS["placed"] = f"SELECT invoice, customer_key, country, {xy('x_km', 'cos')}, {xy('y_km', 'sin')} FROM lookup"

# ---- slotting and pick tours
PARTS["vel"] = """
SELECT i.stock_code, count(l.stock_code) AS velocity FROM items i LEFT JOIN lines l USING (stock_code) GROUP BY 1"""
PARTS["slotting"] = f"""
WITH near AS (SELECT slot_id, row_number() OVER (ORDER BY distance_m, slot_id) AS place FROM slots),
     mixed AS (SELECT slot_id, row_number() OVER (ORDER BY {u(44, 'slot', 'slot_id')}, slot_id) AS place FROM slots)
SELECT 'random' AS variant, stock_code, slot_id
FROM (SELECT stock_code, row_number() OVER (ORDER BY stock_code) AS place FROM vel) JOIN mixed USING (place)
UNION ALL
SELECT 'abc', stock_code, slot_id
FROM (SELECT stock_code, row_number() OVER (ORDER BY velocity DESC, stock_code) AS place FROM vel) JOIN near USING (place)
UNION ALL
SELECT 'optimal', stock_code, slot_id
FROM (SELECT stock_code, row_number() OVER (ORDER BY velocity DESC, stock_code DESC) AS place FROM vel)
JOIN near USING (place)"""
PARTS["tour_stops"] = """
SELECT s.variant, l.invoice,
       list(DISTINCT {'id': t.slot_id, 'px': round(t.x_m * 100)::BIGINT, 'py': round(t.y_m * 100)::BIGINT}) AS todo
FROM lines l JOIN slotting s USING (stock_code) JOIN slots t USING (slot_id) GROUP BY 1, 2"""
PARTS["tours"] = """
WITH RECURSIVE walk AS (
  SELECT variant, invoice, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS walked, todo FROM tour_stops
  UNION ALL
  SELECT variant, invoice, best.px, best.py, walked + best.d, list_filter(todo, lambda s: s.id <> best.id)
  FROM (
    SELECT *, list_min(list_transform(todo, lambda s: {
      'd': CASE WHEN s.px = x THEN abs(s.py - y) ELSE abs(s.px - x) + s.py + y END,
      'id': s.id, 'px': s.px, 'py': s.py})) AS best
    FROM walk WHERE len(todo) > 0
  )
)
SELECT variant, invoice, (walked + x + y) / 100.0::DOUBLE AS travel_m FROM walk WHERE len(todo) = 0"""
PARTS["evaluated"] = """
SELECT t.variant, t.invoice, n.lines, n.units, t.travel_m, (t.travel_m / 1.2 + n.lines * 10.0) / 60.0 AS time_min
FROM tours t
JOIN (SELECT invoice, count(*) AS lines, sum(quantity)::DOUBLE AS units FROM lines GROUP BY 1) n USING (invoice)"""
PARTS["layout_totals"] = """
SELECT variant, count(DISTINCT invoice) AS invoices, sum(lines)::BIGINT AS lines,
       avg(travel_m) AS mean_travel_m, sum(travel_m) AS total_travel_m
FROM evaluated GROUP BY 1"""

# ---- fulfilment
PARTS["unit_sizes"] = """
SELECT stock_code, length_cm * width_cm * height_cm AS unit_cm3, weight_kg AS unit_kg FROM physical"""
PARTS["quantities"] = """
SELECT invoice, stock_code, sum(quantity)::BIGINT AS quantity, any_value(unit_cm3) AS unit_cm3,
       any_value(unit_kg) AS unit_kg
FROM win_lines JOIN unit_sizes USING (stock_code) GROUP BY 1, 2"""
_TAKE = "least(a.n, floor(c.v / i.v + 1e-9), floor(c.w / i.w + 1e-9))::BIGINT"
_FRESH = "least(floor(96000.0::DOUBLE / i.v + 1e-9), floor(20.0::DOUBLE / i.w + 1e-9))::BIGINT"
PARTS["packed"] = f"""
SELECT invoice,
       coalesce(sum(quantity) FILTER (unit_cm3 > 96000 OR unit_kg > 20), 0)::BIGINT
       + len(list_reduce(
           coalesce(list({{'v': unit_cm3, 'w': unit_kg, 'q': quantity}} ORDER BY unit_cm3 DESC, unit_kg DESC)
                    FILTER (unit_cm3 <= 96000 AND unit_kg <= 20), []),
           lambda boxes, i: list_transform([list_reduce(boxes,
               lambda a, c: {{'n': a.n - {_TAKE},
                              'done': list_append(a.done, {{'v': c.v - {_TAKE} * i.v, 'w': c.w - {_TAKE} * i.w}})}},
               {{'n': i.q, 'done': []::STRUCT(v DOUBLE, w DOUBLE)[]}})],
             lambda r: list_concat(r.done, list_transform(range(ceil(r.n / {_FRESH})::BIGINT),
               lambda k: {{'v': 96000.0::DOUBLE - least({_FRESH}, r.n - k * {_FRESH}) * i.v,
                           'w': 20.0::DOUBLE - least({_FRESH}, r.n - k * {_FRESH}) * i.w}})))[1],
           []::STRUCT(v DOUBLE, w DOUBLE)[])) AS cartons
FROM quantities GROUP BY 1"""
PARTS["least_boxes"] = """
SELECT invoice, (sum(CASE WHEN big THEN quantity ELSE 0 END)
       + greatest(ceil(sum(CASE WHEN big THEN 0 ELSE quantity * unit_cm3 END) / 96000.0::DOUBLE - 1e-9),
                  ceil(sum(CASE WHEN big THEN 0 ELSE quantity * unit_kg END) / 20.0::DOUBLE - 1e-9)))::BIGINT AS least_cartons
FROM (SELECT *, unit_cm3 > 96000 OR unit_kg > 20 AS big FROM quantities) GROUP BY 1"""
PARTS["ord"] = """
SELECT a.invoice, a.arrival, e.time_min AS pick_minutes, e.lines, e.units, p.cartons, a.weight_kg
FROM (SELECT invoice, min(invoice_ts) AS arrival, sum(quantity * unit_kg) AS weight_kg
      FROM win_lines JOIN unit_sizes USING (stock_code) GROUP BY 1) a
JOIN evaluated e ON e.invoice = a.invoice AND e.variant = 'optimal'
JOIN packed p ON p.invoice = a.invoice"""
PARTS["queued"] = """
SELECT *, turn % 4 AS lane, turn // 4 AS k, epoch(arrival - arrival_day::TIMESTAMP) / 60.0 AS at_min
FROM (SELECT *, arrival::DATE AS arrival_day,
             row_number() OVER (PARTITION BY arrival::DATE ORDER BY arrival, invoice) - 1 AS turn FROM ord)"""
PARTS["worked"] = """
WITH RECURSIVE chain AS (
  SELECT *, at_min + pick_minutes AS ends FROM queued WHERE k = 0
  UNION ALL
  SELECT q.*, greatest(q.at_min, c.ends) + q.pick_minutes
  FROM chain c JOIN queued q ON q.arrival_day = c.arrival_day AND q.lane = c.lane AND q.k = c.k + 1
)
SELECT * FROM chain"""
PARTS["flog"] = """
SELECT invoice, arrival, arrival_day, lane, ends - pick_minutes AS start_of_day_min, ends AS finish_of_day_min,
       ends - pick_minutes + shift AS start_min, ends + shift AS finish_min, ends - pick_minutes - at_min AS wait_min,
       pick_minutes, lines, units, cartons, weight_kg, arrival_day + floor(ends / 1440)::INT AS day
FROM (SELECT *, epoch(arrival_day::TIMESTAMP - (SELECT min(arrival) FROM ord)) / 60.0 AS shift FROM worked)"""
PARTS["fday"] = """
SELECT day, count(*) AS orders, sum(lines)::BIGINT AS lines, sum(units) AS units,
       sum(pick_minutes) / 60.0 AS labour_hours, sum(cartons)::BIGINT AS cartons, sum(weight_kg) AS weight_kg
FROM flog GROUP BY 1"""
PARTS["moments"] = """
SELECT arrival_day, t, count(*) FILTER (up) AS started FROM (
  SELECT arrival_day, round(start_of_day_min, 6) AS t, true AS up FROM flog
  UNION ALL SELECT arrival_day, round(finish_of_day_min, 6), false FROM flog
) GROUP BY 1, 2"""
PARTS["busy"] = """
SELECT m.arrival_day, m.t, any_value(m.started) AS started,
       count(*) FILTER (round(l.start_of_day_min, 6) <= m.t) - count(*) FILTER (round(l.finish_of_day_min, 6) <= m.t) AS doing
FROM moments m JOIN flog l ON l.arrival_day = m.arrival_day GROUP BY 1, 2"""

# ---- delivery
PARTS["ship"] = """
SELECT *, rem > 0 OR full_trips = 0 AS is_node, 2 * away * full_trips AS direct_km
FROM (
  SELECT l.invoice, l.day, p.customer_key, p.country, p.x_km, p.y_km, l.cartons AS packed,
         greatest(1, l.cartons) AS cartons, greatest(1, l.cartons) // 80 AS full_trips,
         greatest(1, l.cartons) % 80 AS rem, sqrt(p.x_km * p.x_km + p.y_km * p.y_km) AS away
  FROM flog l JOIN placed p USING (invoice)
)"""
PARTS["stops"] = """
SELECT day, invoice, x_km, y_km, away, rem AS load, row_number() OVER (PARTITION BY day ORDER BY invoice) AS k
FROM ship WHERE is_node"""
PARTS["pairs"] = """
SELECT a.day, a.k AS i, b.k AS j, a.invoice AS invoice_i, b.invoice AS invoice_j,
       a.away + b.away - sqrt((a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km)) AS saving
FROM stops a JOIN stops b ON a.day = b.day AND a.k < b.k"""
PARTS["tried"] = """
SELECT s.day, s.alone, coalesce(p.pairs, []) AS pairs
FROM (SELECT day, list({'seq': [k], 'load': load::BIGINT} ORDER BY k) AS alone FROM stops GROUP BY 1) s
LEFT JOIN (SELECT day, list({'i': i, 'j': j} ORDER BY saving DESC, i DESC, j DESC) AS pairs
           FROM pairs WHERE saving > 0 GROUP BY 1) p USING (day)"""
PARTS["joined"] = """
SELECT day, list_reduce(pairs, lambda rs, p:
  list_transform([{'a': list_filter(rs, lambda r: r.seq[1] = p.i OR r.seq[-1] = p.i),
                   'b': list_filter(rs, lambda r: r.seq[1] = p.j OR r.seq[-1] = p.j)}],
    lambda m: CASE
      WHEN len(m.a) = 1 AND len(m.b) = 1 AND m.a[1].seq <> m.b[1].seq AND m.a[1].load + m.b[1].load <= 80
      THEN list_append(
        list_filter(rs, lambda r: r.seq <> m.a[1].seq AND r.seq <> m.b[1].seq),
        {'seq': list_concat(CASE WHEN m.a[1].seq[1] = p.i THEN list_reverse(m.a[1].seq) ELSE m.a[1].seq END,
                            CASE WHEN m.b[1].seq[-1] = p.j THEN list_reverse(m.b[1].seq) ELSE m.b[1].seq END),
         'load': m.a[1].load + m.b[1].load})
      ELSE rs END)[1], alone) AS routes
FROM tried"""
PARTS["tour_rows"] = """
SELECT r.day, r.route, r.pos, r.size, s.invoice, s.x_km, s.y_km, s.away
FROM (
  SELECT day, route, generate_subscripts(seq, 1) AS pos, len(seq) AS size, unnest(seq) AS k
  FROM (SELECT day, route, CASE WHEN seq[1] <= seq[-1] THEN seq ELSE list_reverse(seq) END AS seq
        FROM (SELECT day, generate_subscripts(routes, 1) AS route, unnest(routes).seq AS seq FROM joined))
) r JOIN stops s ON s.day = r.day AND s.k = r.k"""
PARTS["route_sums"] = """
SELECT day, route, count(*) AS stops, list(invoice ORDER BY pos) AS visits,
       sum(CASE WHEN pos = 1 THEN away ELSE leg END) + sum(CASE WHEN pos = size THEN away ELSE 0 END) AS km
FROM (SELECT *, sqrt(pow(x_km - lag(x_km) OVER w, 2) + pow(y_km - lag(y_km) OVER w, 2)) AS leg
      FROM tour_rows WINDOW w AS (PARTITION BY day, route ORDER BY pos))
GROUP BY 1, 2"""
PARTS["dday"] = """
SELECT s.day, s.drops, s.cartons, s.direct_trips, coalesce(r.km, 0) + s.direct_km AS km,
       coalesce(r.routes, 0) + s.direct_trips AS vehicles, s.lo_km, s.hi_km
FROM (
  SELECT day, count(*) AS drops, sum(packed)::BIGINT AS cartons, sum(full_trips)::BIGINT AS direct_trips,
         sum(direct_km) AS direct_km, sum(2 * away * cartons / 80) AS lo_km,
         sum(2 * away * (full_trips + is_node::INT)) AS hi_km
  FROM ship GROUP BY 1
) s LEFT JOIN (SELECT day, sum(km) AS km, count(*) AS routes FROM route_sums GROUP BY 1) r USING (day)"""

PARTS["sweep_walk"] = """
WITH RECURSIVE o AS (
  SELECT day, k, load, row_number() OVER (PARTITION BY day ORDER BY round(atan2(y_km, x_km), 9), k) AS n FROM stops
), w AS (
  SELECT day, k, n, load AS held, 0 AS route FROM o WHERE n = 1
  UNION ALL
  SELECT o.day, o.k, o.n, CASE WHEN w.held + o.load > 80 THEN o.load ELSE w.held + o.load END, w.route + (w.held + o.load > 80)::INT
  FROM w JOIN o ON o.day = w.day AND o.n = w.n + 1
)
SELECT w.day, w.route, w.n AS pos, s.invoice, s.x_km, s.y_km, s.away FROM w JOIN stops s ON s.day = w.day AND s.k = w.k"""
PARTS["sweep_sums"] = """
SELECT day, route, count(*) AS stops, list(invoice ORDER BY pos) AS visits, sum(coalesce(leg, away)) + arg_max(away, pos) AS km
FROM (SELECT *, sqrt(pow(x_km - lag(x_km) OVER w, 2) + pow(y_km - lag(y_km) OVER w, 2)) AS leg
      FROM sweep_walk WINDOW w AS (PARTITION BY day, route ORDER BY pos))
GROUP BY 1, 2"""
PARTS["plans"] = """
SELECT d.day, d.drops, d.km, d.vehicles, coalesce(r.km, 0) + s.direct_km AS sweep_km, coalesce(r.routes, 0) + d.direct_trips AS sweep_vehicles
FROM dday d JOIN (SELECT day, sum(direct_km) AS direct_km FROM ship GROUP BY 1) s USING (day)
LEFT JOIN (SELECT day, sum(km) AS km, count(*) AS routes FROM sweep_sums GROUP BY 1) r USING (day)"""

# ---- costs
PARTS["rev_lines"] = """
SELECT * FROM sales s WHERE EXISTS (SELECT 1 FROM win w WHERE w.week = s.week)
  AND EXISTS (SELECT 1 FROM items i WHERE i.stock_code = s.stock_code)"""
PARTS["inv_cost"] = """
SELECT l.invoice, l.day, r.revenue, l.pick_minutes / 60 * 14.5 AS labour_cost,
       l.cartons / d.cartons * d.km * 0.85 AS transport_cost,
       2500.0::DOUBLE * (SELECT count(*) FROM win) / (SELECT count(*) FROM flog) AS facility_cost
FROM flog l
LEFT JOIN (SELECT invoice, sum(revenue)::DOUBLE AS revenue FROM rev_lines GROUP BY 1) r USING (invoice)
JOIN dday d ON d.day = l.day"""
PARTS["item_cost"] = """
SELECT i.stock_code, coalesce(r.revenue, 0) AS revenue, coalesce(r.units, 0) AS units,
       coalesce(p.safety_stock, 0) AS safety_stock,
       coalesce(p.safety_stock, 0) * 0.02 * (SELECT count(*) FROM win) AS holding_cost
FROM items i
LEFT JOIN (SELECT stock_code, sum(revenue)::DOUBLE AS revenue, sum(quantity)::DOUBLE AS units FROM rev_lines GROUP BY 1) r
  USING (stock_code)
LEFT JOIN plan p USING (stock_code)"""
PARTS["cost_parts"] = """
SELECT (SELECT sum(pick_minutes) / 60 FROM flog) AS hours, (SELECT sum(km) FROM dday) AS km,
       (SELECT sum(safety_stock) FROM plan) AS stock, (SELECT count(*) FROM win) AS weeks,
       (SELECT sum(revenue)::DOUBLE FROM rev_lines) AS revenue"""
PARTS["booked"] = """
SELECT hours * 14.5 AS labour, km * 0.85 AS transport, stock * 0.02 * weeks AS holding, weeks * 2500.0::DOUBLE AS facility,
       hours * 14.5 + km * 0.85 + stock * 0.02 * weeks + weeks * 2500.0::DOUBLE AS total, revenue, hours, km, stock, weeks
FROM cost_parts"""
PARTS["cost_lines"] = """
SELECT u.item, u.gbp, u.basis, u.provenance FROM booked, LATERAL (VALUES
  ('labour', labour, printf('%.1f picking hours x 14.50/h', hours), 'synthetic-assigned'),
  ('transport', transport, printf('%.1f km x 0.85/km', km), 'synthetic-assigned'),
  ('holding', holding, printf('%.0f units x 0.02/unit-week x %d weeks', stock, weeks), 'synthetic-assigned'),
  ('facility', facility, printf('2500/week x %d weeks', weeks), 'synthetic-assigned'),
  ('total cost', total, 'sum of the four cost lines', 'synthetic-assigned'),
  ('window revenue', revenue, printf('sales of the same %d weeks', weeks), 'real')
) u(item, gbp, basis, provenance)"""
PARTS["raw_revenue"] = """
SELECT sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS v FROM (
  SELECT DISTINCT l_orderkey, p_name, l_partkey % 71 = 0 AS hidden, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_returnflag <> 'R' AND l_partkey % 83 <> 0 AND l_partkey % 89 <> 0 AND l_partkey % 79 <> 0)"""
_A, _R, _D = "'synthetic-assigned'", "'real'", "'derived'"
PARTS["ledger"] = f"""
SELECT u.* FROM booked, layout_pivot, LATERAL (VALUES
  ('ingest/revenue_gbp', (SELECT sum(revenue)::DOUBLE FROM sales), 'GBP', {_R}),
  ('published/revenue_gbp', (SELECT v FROM raw_revenue), 'GBP', {_R}),
  ('ingest/demand_units', (SELECT sum(units) FROM demand), 'units', {_R}),
  ('ingest/line_units', (SELECT sum(quantity)::DOUBLE FROM window_sales), 'units', {_R}),
  ('ingest/line_count', (SELECT count(*) FROM window_sales), 'lines', {_R}),
  ('invoice_stream/line_count', (SELECT count(*) FROM lines), 'lines', {_R}),
  ('forecast/rows', (SELECT count(*) FROM forecasts), 'rows', {_D}),
  ('forecast/items', (SELECT count(DISTINCT stock_code) FROM forecasts), 'items', {_D}),
  ('inventory/plan_items', (SELECT count(DISTINCT stock_code) FROM plan), 'items', {_A}),
  ('inventory/safety_stock_units', stock, 'units', {_A}),
  ('warehouse/velocity_lines', (SELECT sum(velocity)::DOUBLE FROM vel), 'lines', {_R}),
  ('warehouse/picked_lines_total', optimal_lines, 'lines', {_A}),
  ('warehouse/travel_mean_random', random_m, 'm/invoice', {_A}),
  ('warehouse/travel_mean_abc', abc_m, 'm/invoice', {_A}),
  ('warehouse/travel_mean_optimal', optimal_m, 'm/invoice', {_A}),
  ('warehouse/invoices_random', random_n, 'invoices', {_A}),
  ('warehouse/invoices_abc', abc_n, 'invoices', {_A}),
  ('warehouse/invoices_optimal', optimal_n, 'invoices', {_A}),
  ('warehouse/lines_random', random_lines, 'lines', {_A}),
  ('warehouse/lines_abc', abc_lines, 'lines', {_A}),
  ('warehouse/lines_optimal', optimal_lines, 'lines', {_A}),
  ('window/weeks', weeks, 'weeks', {_R}),
  ('window/stream_lines', (SELECT count(*) FROM win_lines), 'lines', {_R}),
  ('fulfil/picked_lines', (SELECT sum(lines)::DOUBLE FROM flog), 'lines', {_A}),
  ('fulfil/orders', (SELECT count(*) FROM flog), 'orders', {_A}),
  ('fulfil/cartons_packed', (SELECT sum(cartons)::DOUBLE FROM flog), 'cartons', {_A}),
  ('fulfil/cartons_shipped', (SELECT sum(cartons)::DOUBLE FROM fday), 'cartons', {_A}),
  ('fulfil/labour_hours', hours, 'hours', {_A}),
  ('transport/routed_drops', (SELECT count(*) FROM tour_rows) + (SELECT count(*) FROM ship WHERE NOT is_node), 'orders', {_A}),
  ('transport/savings_km', km, 'km', {_A}),
  ('transport/out_and_back_km', (SELECT sum(hi_km) FROM dday), 'km', {_A}),
  ('costing/labour', labour, 'GBP', {_A}), ('costing/transport', transport, 'GBP', {_A}),
  ('costing/holding', holding, 'GBP', {_A}), ('costing/facility', facility, 'GBP', {_A}),
  ('costing/total_cost', total, 'GBP', {_A}), ('costing/component_sum', total, 'GBP', {_A}),
  ('costing/window_revenue', revenue, 'GBP', {_R}),
  ('ingest/window_revenue', (SELECT sum(revenue)::DOUBLE FROM window_sales
      WHERE week BETWEEN (SELECT min(week) FROM win) AND (SELECT max(week) FROM win)), 'GBP', {_R})
) u(key, value, unit, provenance)"""
PARTS["layout_pivot"] = "SELECT " + ", ".join(
    f"max(CASE WHEN variant = '{v}' THEN mean_travel_m END) AS {v}_m, "
    f"max(CASE WHEN variant = '{v}' THEN invoices END) AS {v}_n, "
    f"max(CASE WHEN variant = '{v}' THEN lines END) AS {v}_lines"
    for v in ("random", "abc", "optimal")
) + " FROM layout_totals"

# ---- order economics
PARTS["econ"] = """
SELECT *, labour_cost + transport_cost + facility_cost AS delivered_cost,
       revenue - (labour_cost + transport_cost + facility_cost) AS gap FROM inv_cost"""
PARTS["cost_rank"] = """
SELECT *, row_number() OVER (ORDER BY delivered_cost, invoice DESC) AS up,
       row_number() OVER (ORDER BY delivered_cost DESC, invoice) AS down,
       ntile(10) OVER (ORDER BY delivered_cost DESC, invoice) AS decile, count(*) OVER () AS n FROM econ"""
PARTS["curve"] = """
SELECT invoice, gap, row_number() OVER (ORDER BY gap DESC, invoice) AS rank, count(*) OVER () AS n_rows,
       sum(gap) OVER (ORDER BY gap DESC, invoice ROWS UNBOUNDED PRECEDING) AS cum_gap FROM econ"""

# ---- identities; names, entries and tolerances are written out, so one lost from the code is missed here
PARTS["told"] = """
SELECT * FROM (VALUES
  ('(a) published revenue', 'ingest/revenue_gbp', 'published/revenue_gbp', 0.005::DOUBLE),
  ('(b) demand conservation', 'ingest/demand_units', 'ingest/line_units', 0.000001),
  ('(c) line conservation', 'invoice_stream/line_count', 'ingest/line_count', 0),
  ('(f) pick conservation', 'warehouse/picked_lines_total', 'invoice_stream/line_count', 0),
  ('(i) window pick conservation', 'fulfil/picked_lines', 'window/stream_lines', 0),
  ('(j) carton conservation', 'fulfil/cartons_shipped', 'fulfil/cartons_packed', 0),
  ('(k) drop conservation', 'transport/routed_drops', 'fulfil/orders', 0),
  ('(l) ledger additivity', 'costing/total_cost', 'costing/component_sum', 0.005),
  ('(m) window revenue', 'costing/window_revenue', 'ingest/window_revenue', 0.005)
) t(name, lhs_label, rhs_label, tolerance)"""
PARTS["compared"] = """
SELECT t.name, t.lhs_label, a.value AS lhs, t.rhs_label, b.value AS rhs, t.tolerance,
       coalesce(a.unit = b.unit AND abs(a.value - b.value) <= t.tolerance, false) AS passed, a.unit
FROM told t LEFT JOIN ledger a ON a.key = t.lhs_label LEFT JOIN ledger b ON b.key = t.rhs_label"""
PARTS["held"] = """
SELECT name, passed FROM compared
UNION ALL SELECT '(d)', count(*) = 0 FROM forecasts WHERE stock_code NOT IN (SELECT stock_code FROM items)
UNION ALL SELECT '(e)', count(*) = 0 FROM ((SELECT stock_code FROM plan EXCEPT SELECT stock_code FROM forecasts) UNION ALL
                                           (SELECT stock_code FROM forecasts EXCEPT SELECT stock_code FROM plan))
UNION ALL SELECT '(g)', min(lines) = max(lines) AND min(invoices) = max(invoices) FROM layout_totals
UNION ALL SELECT '(h)', count(*) = 6 FROM ledger
  WHERE (key IN ('ingest/demand_units', 'warehouse/velocity_lines') AND provenance = 'real')
     OR ((key LIKE 'warehouse/travel_mean_%' OR key = 'inventory/safety_stock_units') AND provenance = 'synthetic-assigned')"""

# ---- what-ifs
PARTS["top_class"] = """
SELECT class FROM forecasts GROUP BY 1 ORDER BY count(DISTINCT stock_code) DESC, class LIMIT 1"""
_SCENARIOS = (
    [("base", "none", 1.0, 1, 1, 1, 1), ("class surge", "class", 1.2, 1, 1, 1, 1), ("transport rate", "none", 1.0, 1, 1.1, 1, 1)]
    + [("erratic surge", "erratic", 1.2, 1, 1, 1, 1)]
    + [(f"book x{f:.2f}", "book", f, 1, 1, 1, 1) for f in (0.8, 0.9, 1.0, 1.1, 1.2)]
    + [("labour rate", "none", 1.0, 1.1, 1, 1, 1), ("holding rate", "none", 1.0, 1, 1, 1.1, 1),
       ("facility rate", "none", 1.0, 1, 1, 1, 1.1)]
)
PARTS["scenarios"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{s}', {f}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, s, f, a, b, c, d in _SCENARIOS
) + ") t(scenario_id, reach, f, lab, tra, hol, fac)"
PARTS["surged"] = """
SELECT s.scenario_id, p.stock_code, p.class,
       CASE WHEN s.reach = 'book' OR (s.reach = 'class' AND p.class = (SELECT class FROM top_class)) OR s.reach = p.class THEN s.f ELSE 1 END AS grow
FROM plan p, scenarios s"""
PARTS["scen"] = """
SELECT s.scenario_id, s.f AS demand_factor, t.ss_units, t.order_up_to_units, b.km, t.forecast_units,
       b.labour * s.lab AS labour, b.transport * s.tra AS transport, t.ss_units * 0.02 * b.weeks * s.hol AS holding,
       b.facility * s.fac AS facility,
       b.labour * s.lab + b.transport * s.tra + t.ss_units * 0.02 * b.weeks * s.hol + b.facility * s.fac AS total_cost,
       b.revenue AS window_revenue
FROM scenarios s, booked b, (
  SELECT scenario_id, sum(safety_stock * grow) AS ss_units, sum(order_up_to * grow) AS order_up_to_units,
         sum(CASE WHEN class = (SELECT class FROM top_class) THEN mu_weekly * 8 * grow ELSE 0 END) AS forecast_units
  FROM surged JOIN (SELECT stock_code, safety_stock, order_up_to, mu_weekly FROM plan) p USING (stock_code) GROUP BY 1
) t WHERE t.scenario_id = s.scenario_id"""

# ---- sampling
def _key(stratum: str) -> str:
    return (
        f"md5(concat_ws('|', '42:{stratum}', invoice, stock_code, coalesce(description, ''), quantity::VARCHAR, "
        "strftime(invoice_ts, '%Y-%m-%d %H:%M:%S'), coalesce(round(price * 10000)::BIGINT::VARCHAR, ''), "
        "coalesce(customer_id::VARCHAR, ''), coalesce(country, '')))"
    )


_LISTED = f"(stock_code IN ({CODES}) OR starts_with(lower(stock_code), 'gift_'))"
PARTS["busiest"] = f"""
SELECT stock_code FROM txn WHERE NOT {_LISTED} AND NOT starts_with(invoice, 'C')
GROUP BY 1 ORDER BY count(*) DESC, stock_code LIMIT 10"""
PARTS["sampled"] = f"""
SELECT {EIGHT}, 'focus' AS stratum FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY {_key('focus')}) AS r
  FROM txn WHERE stock_code IN (SELECT stock_code FROM busiest)) WHERE r <= 300
UNION ALL (SELECT {EIGHT}, 'random' FROM txn ORDER BY {_key('random')} LIMIT 1200)
UNION ALL (SELECT {EIGHT}, 'cancelled' FROM txn WHERE starts_with(invoice, 'C') ORDER BY {_key('cancelled')} LIMIT 120)
UNION ALL (SELECT {EIGHT}, 'non-product' FROM txn WHERE {_LISTED} ORDER BY {_key('non-product')} LIMIT 80)
UNION ALL (SELECT {EIGHT}, 'zero price' FROM txn WHERE price <= 0 ORDER BY {_key('zero price')} LIMIT 50)
UNION ALL
SELECT {EIGHT}, 'duplicate' FROM (
  SELECT {EIGHT}, unnest(range(n)) FROM (
    SELECT * FROM (SELECT {EIGHT}, count(*) AS n FROM txn GROUP BY ALL) WHERE n > 1
    ORDER BY {_key('duplicate')} LIMIT 15))"""
