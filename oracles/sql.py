"""DuckDB SQL for every registered query, over the sample tables.

Written apart from the Spark plans: thresholds come from window aggregates over
the records and the built-in deviation, medians from the built-in median.
Rounding goes through a decimal, which rounds halves away from zero.
"""

from __future__ import annotations

LINES = """lines AS (
  SELECT CAST(l_shipdate AS DATE) AS record_date, n_name AS store_id, p_brand AS product_id,
         p_type AS category, r_name AS region, n_name || '_' || r_name AS store_region_id,
         CAST(l_quantity AS INTEGER) + p_size AS inventory_level,
         CAST(l_quantity AS INTEGER) AS units_sold,
         l_linenumber AS units_ordered,
         CAST(greatest(CAST(l_quantity AS INTEGER) + 2 * (p_size - 25), 0) AS DECIMAL(10,2))
           AS demand_forecast,
         CAST(p_size * CAST(0.75 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS price,
         CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(5,2)) AS discount,
         o_orderpriority AS weather_condition,
         CAST(l_discount AS DECIMAL(4,2)) >= CAST(0.05 AS DECIMAL(4,2)) AS holiday_promotion,
         CAST(p_size * (CAST(0.75 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(4,2))
              - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS competitor_pricing,
         CASE l_orderkey % 4 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer'
              ELSE 'Autumn' END AS seasonality
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
       LEFT JOIN orders ON o_orderkey = l_orderkey
)"""

DAYS = """days AS (
  SELECT record_date, store_region_id, product_id,
         CAST(sum(inventory_level) AS INTEGER) AS inventory_level,
         CAST(sum(units_sold) AS INTEGER) AS units_sold,
         CAST(sum(units_ordered) AS INTEGER) AS units_ordered,
         CAST(sum(demand_forecast) AS DECIMAL(10,2)) AS demand_forecast,
         CAST(sum(inventory_level) - sum(units_sold) AS BIGINT) AS net,
         max(price) AS price, max(discount) AS discount,
         max(competitor_pricing) AS competitor_pricing
  FROM lines GROUP BY ALL
)"""

DIMS = """categories AS (
  SELECT product_id, category FROM lines
  QUALIFY row_number() OVER (PARTITION BY product_id
                             ORDER BY record_date, store_region_id, category) = 1
), seasons AS (
  SELECT product_id, seasonality FROM lines
  QUALIFY row_number() OVER (PARTITION BY product_id
                             ORDER BY record_date, store_region_id, seasonality) = 1
), places AS (
  SELECT DISTINCT store_region_id, store_id, region FROM lines
)"""

PAIR = "store_region_id, product_id"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + "\n" + select


def _r(expression: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def _big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _mean(column: str) -> str:
    return f"(CAST(sum({column}) * 100 AS DOUBLE) / (count({column}) * 100))"


def _marked(sigma: float, keys: str = PAIR, rows: str = "days") -> str:
    """Records with their group's threshold and a 0/1 understock flag.

    The threshold is rounded to nine places before the test: where it is a whole
    number, the last digit of a floating deviation must not flag a net equal to it.
    """
    return f"""marked AS (
  SELECT *, CASE WHEN net < round(edge, 9) THEN 1 ELSE 0 END AS short FROM (
    SELECT *, avg(net) OVER g - {sigma} * stddev_pop(net) OVER g AS edge FROM {rows}
    WINDOW g AS (PARTITION BY {keys})))"""


def _pairs(sigma: float) -> str:
    """One row per store-product with its means, deviations and short days."""
    return (
        _marked(sigma)
        + f""", pairs AS (
  SELECT {PAIR}, count(*) AS n, sum(short) AS k, avg(inventory_level) AS stock,
         avg(units_sold) AS sold, stddev_pop(units_sold) AS sold_sd, avg(net) AS net_mean,
         stddev_pop(net) AS net_sd, sum(inventory_level) AS stock_sum, sum(units_sold) AS sold_sum
  FROM marked GROUP BY ALL)"""
    )


POINTS = """CASE WHEN k * 100 > 5 * n THEN net_mean ELSE net_mean - 0.5 * net_sd END"""

# ---- load ------------------------------------------------------------------

_AMOUNTS = ["demand_forecast", "price", "discount", "competitor_pricing"]


def _plain(columns: list[str]) -> str:
    return ", ".join(f"{_dbl(c)} AS {c}" if c in _AMOUNTS else c for c in columns)


_STAGING = [
    "record_date", "store_id", "product_id", "category", "region", "store_region_id",
    "inventory_level", "units_sold", "units_ordered", "demand_forecast", "price", "discount",
    "weather_condition", "holiday_promotion", "competitor_pricing", "seasonality",
]
_FACT = [
    "record_date", "store_region_id", "product_id", "inventory_level", "units_sold",
    "units_ordered", "demand_forecast",
]
_PRICE = [
    "store_region_id", "product_id", "record_date", "price", "discount", "competitor_pricing",
]

# table -> (primary key, columns, whether the load offers distinct rows)
_OFFERED = {
    "stores": (["store_region_id"], ["store_region_id", "store_id", "region"], True),
    "products": (["product_id"], ["product_id", "category"], True),
    "seasonality": (["product_id"], ["product_id", "seasonality"], True),
    "inventory": (["record_date", "store_region_id", "product_id"], _FACT, False),
    "pricing": (["store_region_id", "product_id", "record_date"], _PRICE, True),
    "store_events": (
        ["store_region_id", "record_date"],
        ["store_region_id", "record_date", "weather_condition", "holiday_promotion"],
        True,
    ),
}


def _duplicate_keys() -> str:
    selects = []
    for table, (keys, columns, distinct) in _OFFERED.items():
        key, kind = ", ".join(keys), "DISTINCT" if distinct else ""
        absent = " OR ".join(f"{k} IS NULL" for k in keys)
        selects.append(
            f"""SELECT '{table}' AS table_name, {_big('sum(c)')} AS rows_offered,
  {_big(f'count(*) FILTER (NOT ({absent}))')} AS distinct_keys,
  {_big(f'count(*) FILTER (c > 1 AND NOT ({absent}))')} AS duplicated_keys,
  {_big(f'coalesce(sum(c - 1) FILTER (c > 1 AND NOT ({absent})), 0)')} AS surplus_rows,
  {_big(f'coalesce(sum(c) FILTER ({absent}), 0)')} AS null_key_rows
FROM (SELECT {key}, count(*) AS c FROM (SELECT {kind} {', '.join(columns)} FROM lines) GROUP BY ALL)"""
        )
    return _with(LINES, select="\nUNION ALL\n".join(selects))


def _load_warnings() -> str:
    """Wrong fields of raw lines, and keys that repeat among the lines that are right."""
    reasons = """reasons (units_sold, column_name, code) AS (
  VALUES (3, 'record_date', 'unreadable'), (5, 'inventory_level', 'blank'),
         (7, 'holiday_promotion', 'unreadable'), (9, 'price', 'unreadable'), (11, NULL, 'wrong_shape'))"""
    right = """fit AS (
  SELECT * REPLACE (CASE units_ordered WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Fair, mild' END
                    AS weather_condition)
  FROM lines WHERE units_sold NOT IN (SELECT units_sold FROM reasons))"""
    selects = [
        f"""SELECT 'staging' AS table_name, column_name, code, {_big('count(*)')} AS rows
FROM lines JOIN reasons USING (units_sold) GROUP BY ALL"""
    ]
    for table, (keys, columns, distinct) in _OFFERED.items():
        kind = "DISTINCT" if distinct else ""
        selects.append(
            f"""SELECT '{table}', '{', '.join(keys)}', 'repeated_key',
  {_big(f'count(*) - count(DISTINCT ROW({", ".join(keys)}))')} AS rows
FROM (SELECT {kind} {', '.join(columns)} FROM fit) HAVING rows > 0"""
        )
    return _with(LINES, reasons, right, select="\nUNION ALL\n".join(selects))


_SOURCES = {
    "inventory": "days",
    "pricing": "days",
    "store_events": "(SELECT DISTINCT store_region_id, record_date FROM lines)",
    "seasonality": "seasons",
    "stores": "places",
    "products": "categories",
}
_LINKS = [
    ("inventory", "stores", "store_region_id"),
    ("inventory", "products", "product_id"),
    ("pricing", "stores", "store_region_id"),
    ("pricing", "products", "product_id"),
    ("store_events", "stores", "store_region_id"),
    ("seasonality", "products", "product_id"),
]


def _orphans() -> str:
    selects = [
        f"""SELECT '{child}' AS child_table, '{parent}' AS parent_table, '{key}' AS key_column,
  {_big('count(*)')} AS rows_checked,
  {_big(f'count(DISTINCT {key}) FILTER ({key} NOT IN (SELECT {key} FROM {_SOURCES[parent]}))')}
    AS orphan_keys,
  {_big(f'count(*) FILTER ({key} NOT IN (SELECT {key} FROM {_SOURCES[parent]}))')} AS orphan_rows
FROM {_SOURCES[child]}"""
        for child, parent, key in _LINKS
    ]
    return _with(LINES, DAYS, DIMS, select="\nUNION ALL\n".join(selects))


def _domain() -> str:
    texts = {
        "store_id": 10, "product_id": 10, "category": 100, "region": 100,
        "store_region_id": 110, "weather_condition": 50, "seasonality": 50,
    }
    digits = {"demand_forecast": 8, "price": 8, "discount": 3, "competitor_pricing": 8}
    sizes = {c: (limit, f"length({c})") for c, limit in texts.items()}
    sizes |= {
        c: (limit, f"length(CAST(CAST(floor(abs({c})) AS BIGINT) AS VARCHAR))")
        for c, limit in digits.items()
    }
    selects = [
        f"""SELECT '{c}' AS column_name, CAST({limit} AS INTEGER) AS declared_limit,
  CAST(max({size}) AS INTEGER) AS longest_value,
  {_big(f'count(*) FILTER ({size} > {limit})')} AS rows_over_limit FROM lines"""
        for c, (limit, size) in sizes.items()
    ]
    return _with(LINES, select="\nUNION ALL\n".join(selects))


_KINDS = {
    "text_length": ["store_region_id", "store_id", "region", "product_id", "category", "seasonality",
                    "weather_condition"],
    "number_total": ["inventory_level", "units_sold", "units_ordered", *_AMOUNTS],
    "day_total": ["record_date"],
    "flag_total": ["holiday_promotion"],
}
_MEASURE = {
    "text_length": "length({})",
    "number_total": "CAST({} AS DECIMAL(20,2))",
    "day_total": "date_diff('day', DATE '1970-01-01', {})",
    "flag_total": "CAST({} AS BIGINT)",
}


def _star_tables() -> str:
    """Sums over all columns of a kind, in each table."""
    sources = {**_SOURCES, "store_events": "moods"}
    selects = []
    for table, (_, columns, _) in _OFFERED.items():
        sums = []
        for kind, names in _KINDS.items():
            parts = [f"coalesce(sum({_MEASURE[kind].format(c)}), 0)" for c in columns if c in names]
            total = " + ".join(parts) or "0"
            sums.append(f"{_dbl(total) if kind == 'number_total' else _big(total)} AS {kind}")
        selects.append(
            f"SELECT '{table}' AS table_name, {_big('count(*)')} AS rows, {', '.join(sums)} "
            f"FROM {sources[table]}"
        )
    moods = """moods AS (
  SELECT store_region_id, record_date, weather_condition, holiday_promotion FROM lines
  QUALIFY row_number() OVER (PARTITION BY store_region_id, record_date
                             ORDER BY weather_condition NULLS FIRST, holiday_promotion) = 1)"""
    return _with(LINES, DAYS, DIMS, moods, select="\nUNION ALL\n".join(selects))


def _raw(columns: list[str]) -> str:
    """Staging columns as the raw lines have them."""
    changed = {
        "category": """'Toys "' || category || '", big' AS category""",
        "weather_condition": """CASE units_ordered WHEN 1 THEN NULL WHEN 2 THEN ''
    ELSE 'Fair, mild' END AS weather_condition""",
    }
    return ", ".join(changed.get(c, _plain([c])) for c in columns)


def _broken(columns: list[str]) -> str:
    """Staging columns as raw lines with breaks have them."""
    changed = {
        "category": """CASE WHEN units_sold % 3 = 0
    THEN 'Toys ' || chr(10) || '"' || category || '",' || chr(10) || chr(10) || ' big'
    ELSE 'Toys "' || category || '", big' END AS category""",
        "weather_condition": """CASE WHEN units_sold % 3 = 0
    THEN 'Fair' || chr(13) || chr(10) || 'mild' || chr(10) WHEN units_ordered = 1 THEN NULL
    WHEN units_ordered = 2 THEN '' ELSE 'Fair, mild' END AS weather_condition""",
    }
    return ", ".join(changed.get(c, _plain([c])) for c in columns)


def _append_conflicts() -> str:
    """Counts of a second load, which repeats the last days of the first with other values."""
    daily = """daily AS (
  SELECT record_date, store_region_id, product_id, min(store_id) AS store_id,
         min(region) AS region, min(category) AS category, min(seasonality) AS seasonality,
         min({'w': weather_condition, 'h': holiday_promotion}) AS mood,
         record_date < DATE '1995-06-17' AS old
  FROM lines GROUP BY ALL
), later AS (
  SELECT * REPLACE (CASE WHEN old THEN category || ' again' ELSE category END AS category,
                    CASE WHEN old THEN 'Never' ELSE seasonality END AS seasonality),
         CASE WHEN old THEN '0-NONE' ELSE mood.w END AS weather, mood.h AS holiday
  FROM daily WHERE record_date >= DATE '1995-06-17' - 30
)"""
    offered = {
        "stores": ("store_region_id, store_id, region", "store_region_id"),
        "products": ("product_id, category", "product_id"),
        "seasonality": ("product_id, seasonality", "product_id"),
        "inventory": ("record_date, store_region_id, product_id", "record_date, store_region_id, product_id"),
        "pricing": ("record_date, store_region_id, product_id", "record_date, store_region_id, product_id"),
        "store_events": ("store_region_id, record_date, weather, holiday", "store_region_id, record_date"),
    }
    selects = [
        f"""SELECT '{name}' AS table_name, {_big('rows')} AS offered, CAST(0 AS BIGINT) AS no_key,
  {_big('rows - keys')} AS repeated, {_big('old_keys')} AS stored, {_big('keys - old_keys')} AS added
FROM (SELECT count(*) AS rows FROM (SELECT DISTINCT {columns} FROM later)),
     (SELECT count(*) AS keys, count(*) FILTER (k IN (SELECT ROW({keys}) FROM daily WHERE old)) AS old_keys
      FROM (SELECT DISTINCT ROW({keys}) AS k FROM later))"""
        for name, (columns, keys) in offered.items()
    ]
    return _with(LINES, daily, select="\nUNION ALL\n".join(selects))



LOAD = {
    "load_staging": _with(LINES, select=f"SELECT {_plain(_STAGING)} FROM lines"),
    "dim_stores": _with(LINES, DIMS, select="SELECT store_region_id, store_id, region FROM places"),
    "dim_products": _with(LINES, DIMS, select="SELECT product_id, category FROM categories"),
    "dim_seasonality": _with(LINES, DIMS, select="SELECT product_id, seasonality FROM seasons"),
    "fact_inventory": _with(LINES, DAYS, select=f"SELECT {_plain(_FACT)} FROM days"),
    "fact_pricing": _with(LINES, DAYS, select=f"SELECT {_plain(_PRICE)} FROM days"),
    "fact_store_events": _with(
        LINES,
        select="""SELECT store_region_id, record_date, weather_condition, holiday_promotion FROM lines
QUALIFY row_number() OVER (PARTITION BY store_region_id, record_date
                           ORDER BY weather_condition NULLS FIRST, holiday_promotion) = 1""",
    ),
    "star_tables": _star_tables(),
    "load_append": _star_tables(),
    "load_append_conflicts": _append_conflicts(),
    "load_quoted": _with(LINES, select=f"SELECT {_raw(_STAGING)} FROM lines"),
    "load_multiline": _with(LINES, select=f"SELECT {_broken(_STAGING)} FROM lines"),
    "load_tolerant": _with(
        LINES,
        select=f"""SELECT product_id, outcome, {_big('count(*)')} AS lines,
  {_big("coalesce(sum(inventory_level) FILTER (outcome = 'accepted'), 0)")} AS inventory_total
FROM (SELECT *, CASE WHEN units_sold IN (3, 5, 7, 9, 11) THEN 'rejected' ELSE 'accepted' END AS outcome
      FROM lines) GROUP BY product_id, outcome""",
    ),
    "load_warnings": _load_warnings(),
    "dq_duplicate_keys": _duplicate_keys(),
    "dq_orphans": _orphans(),
    "dq_domain": _domain(),
}

# ---- stock health ------------------------------------------------------------

STOCK_HEALTH = {
    "sales_profile": _with(
        LINES,
        DAYS,
        select=f"""SELECT {PAIR}, avg(units_sold) AS avg_sales, median(units_sold) AS median_sales,
  {_r('stddev_pop(units_sold)', 6)} AS stddev_sales FROM days GROUP BY ALL""",
    ),
    "stock_level": _with(
        LINES,
        DAYS,
        DIMS,
        _marked(1.0),
        select=f"""SELECT record_date, {PAIR}, category, net AS stock_level,
  {_r('edge', 6)} AS threshold,
  CASE short WHEN 1 THEN 'Understock' ELSE 'Normal' END AS stock_status
FROM marked JOIN categories USING (product_id)""",
    ),
    "movement": _with(
        LINES,
        DAYS,
        _pairs(1.3),
        select=f"""SELECT {PAIR}, {_big('k')} AS understock_days, {_big('n')} AS total_days,
  {_r('k * 100.0 / n')} AS understock_percentage,
  CASE WHEN k * 100 > n * 10 THEN 'Fast-selling' ELSE 'Slow-moving' END AS movement_type
FROM pairs""",
    ),
    "overstock": _with(
        LINES,
        DAYS,
        select=f"""SELECT {PAIR}, inventory_level, {_dbl('demand_forecast')} AS demand_forecast,
  {_dbl('inventory_level - demand_forecast')} AS overstock_amount
FROM days WHERE inventory_level > 2 * demand_forecast""",
    ),
    "stockout_by_store": _with(
        LINES,
        DAYS,
        _marked(1.0),
        select=f"""SELECT store_region_id, {_big('k')} AS stockout_days, {_big('n')} AS total_days,
  {_r('rate')} AS stockout_rate_percentage,
  CASE WHEN rate < (SELECT avg(s.rate) FROM (
      SELECT 100.0 * sum(short) / count(*) AS rate FROM marked GROUP BY store_region_id) s)
    THEN 'Good Performance' ELSE 'Poor Performance - High Stockouts' END AS region_performance
FROM (SELECT store_region_id, sum(short) AS k, count(*) AS n, 100.0 * sum(short) / count(*) AS rate
      FROM marked GROUP BY store_region_id)""",
    ),
}

# ---- replenishment -----------------------------------------------------------

_TARGET = "CASE WHEN k * 100 > n * 10 THEN sold + 1.5 * sold_sd ELSE sold + 0.5 * sold_sd END"
_KIND = "CASE WHEN k * 100 > n * 10 THEN 'Fast-selling' ELSE 'Slow-moving' END"
_LOW = f"""flagged AS (
  SELECT record_date, {PAIR}, category, inventory_level, {POINTS} AS reorder_point
  FROM days JOIN pairs USING ({PAIR}) JOIN categories USING (product_id))"""
_REORDER = f"""reorders AS (
  SELECT {PAIR}, category,
    CASE WHEN k * 100 > n * 10 THEN 'Fast-moving' ELSE 'Slow-moving' END AS movement_type,
    {_r(POINTS)} AS reorder_point, {_r('stock')} AS avg_inventory, {_r('sold')} AS avg_sales,
    {_r('net_sd')} AS stddev_inv_minus_sales, {_big('k')} AS understock_days,
    {_big('n')} AS total_days, {_r('k * 100.0 / n')} AS understock_percentage
  FROM pairs JOIN categories USING (product_id))"""

REPLENISHMENT = {
    "reorder_point": _with(LINES, DAYS, DIMS, _pairs(1.3), _REORDER, select="SELECT * FROM reorders"),
    "low_inventory": _with(
        LINES,
        DAYS,
        DIMS,
        _pairs(1.0),
        _LOW,
        select=f"""SELECT record_date, {PAIR}, category, inventory_level,
  {_r('reorder_point')} AS reorder_point,
  CASE WHEN inventory_level <= reorder_point THEN 'Low Inventory' ELSE 'Sufficient' END
    AS inventory_status
FROM flagged""",
    ),
    "safety_stock": _with(
        LINES,
        DAYS,
        _pairs(1.3),
        select=f"""SELECT {PAIR}, {_KIND} AS product_movement,
  {_r('greatest(1.65 * sold_sd * sqrt(7), sold * 3)')} AS safety_stock,
  {_r(_TARGET)} AS optimal_stock_level FROM pairs""",
    ),
    "stock_recommendations": _with(
        LINES,
        DAYS,
        DIMS,
        _pairs(1.3),
        f"""costs AS (
  SELECT {PAIR}, {_mean('price')} AS unit_price, avg(inventory_level) * {_mean('price')} AS cost
  FROM days GROUP BY ALL)""",
        f"""facts AS (
  SELECT *, {_KIND} AS kind, {_TARGET} AS target,
         greatest(stock * 0.3, stock - ({_TARGET})) AS cut
  FROM pairs JOIN costs USING ({PAIR}) JOIN categories USING (product_id)
       JOIN seasons USING (product_id))""",
        select=f"""SELECT {PAIR}, category, kind AS product_movement,
  {_r('stock')} AS current_avg_inventory, {_r('target')} AS recommended_stock_level,
  {_r('target - stock')} AS stock_adjustment, {_r('cost')} AS holding_cost,
  {_r('k * 100.0 / n')} AS understock_percentage,
  CASE WHEN kind = 'Slow-moving' THEN
         CASE WHEN cost > 1000 THEN 'REDUCE: High holding cost slow-mover. Reduce by '
                || CAST({_r('cut', 0)} AS BIGINT) || ' units to optimize costs'
              ELSE 'MAINTAIN: Low-cost slow-mover. Current level acceptable, monitor sales trends' END
       WHEN stock < target THEN 'INCREASE: Fast-seller understocked. Increase by '
                || CAST({_r('target - stock', 0)} AS BIGINT) || ' units to prevent stockouts'
       ELSE 'OPTIMIZE: Fast-seller well-stocked. Fine-tune to '
                || CAST({_r('target', 0)} AS BIGINT) || ' units for efficiency' END AS recommendation,
  CAST(CASE WHEN kind = 'Slow-moving' THEN
         CASE WHEN cost > 1000 THEN 5 WHEN cost > 500 THEN 2 ELSE 1 END
       WHEN k * 100 > n * 15 THEN 4 WHEN stock < target THEN 3 ELSE 1 END AS INTEGER)
    AS priority_score,
  CASE WHEN kind = 'Slow-moving' AND cost > 1000 THEN {_r('cut * unit_price * 0.25')}
       WHEN kind = 'Fast-selling' AND stock < target THEN {_r('(target - stock) * unit_price * 0.1')}
       ELSE 0 END AS estimated_cost_impact
FROM facts""",
    ),
}

# ---- demand ------------------------------------------------------------------

_CELL = "store_region_id, seasonality, category"
_GOODS = """goods AS (
  SELECT product_id, sum(units_sold) * (CAST(sum(price) AS DOUBLE) / count(price)) AS cogs,
         sum(inventory_level) AS stock_sum, count(inventory_level) AS stock_n
  FROM days GROUP BY product_id)"""

DEMAND = {
    "category_summary": _with(
        LINES,
        DAYS,
        DIMS,
        select=f"""SELECT category, {_r('avg(inventory_level)')} AS avg_inventory,
  {_big('sum(units_sold)')} AS total_units_sold, {_dbl('sum(demand_forecast)')} AS total_forecast
FROM days JOIN categories USING (product_id) GROUP BY category""",
    ),
    "forecast_accuracy": _with(
        LINES,
        DAYS,
        DIMS,
        select=f"""SELECT {PAIR}, category, {_r(_mean('demand_forecast'))} AS avg_forecast,
  {_r('avg(units_sold)')} AS avg_actual_sales,
  {_r('abs(sum(units_sold) - sum(demand_forecast)) / count(*)')} AS avg_forecast_error,
  CASE WHEN abs(sum(units_sold) - sum(demand_forecast)) < 10 * count(*) THEN 'Good Forecast'
       ELSE 'Poor Forecast' END AS forecast_quality
FROM days JOIN categories USING (product_id) GROUP BY ALL""",
    ),
    "competitor_pricing": _with(
        LINES,
        DAYS,
        DIMS,
        select=f"""SELECT i.product_id, c.category,
  {_mean('p.competitor_pricing')} AS avg_competitor_price,
  {_r('CAST(sum(p.price) - sum(p.competitor_pricing) AS DOUBLE) / count(*)', 6)} AS "Difference",
  avg(i.units_sold) AS avg_units_sold
FROM days i JOIN days p USING (record_date, {PAIR})
     JOIN categories c ON c.product_id = i.product_id
GROUP BY i.product_id, c.category""",
    ),
    "discount_effect": _with(
        LINES,
        DAYS,
        DIMS,
        select=f"""SELECT i.product_id, c.category, {_mean('p.discount')} AS avg_discount,
  avg(i.units_sold) AS avg_units_sold
FROM days i JOIN days p USING (record_date, {PAIR})
     JOIN categories c ON c.product_id = i.product_id
GROUP BY i.product_id, c.category""",
    ),
    "turnover": _with(
        LINES,
        DAYS,
        DIMS,
        _GOODS,
        select=f"""SELECT product_id, category, {_r('cogs')} AS approx_cogs,
  {_r('CAST(stock_sum AS DOUBLE) / stock_n')} AS avg_inventory,
  {_r('cogs / (CAST(stock_sum AS DOUBLE) / stock_n)')} AS inventory_turnover_ratio
FROM goods JOIN categories USING (product_id)""",
    ),
    "regional_summary": _with(
        LINES,
        DAYS,
        DIMS,
        "placed AS (SELECT * FROM days JOIN places USING (store_region_id))",
        _marked(1.0, keys="region, product_id", rows="placed"),
        select=f"""SELECT region, {_big('count(DISTINCT product_id)')} AS distinct_products,
  {_big('sum(inventory_level)')} AS total_inventory, {_big('sum(units_sold)')} AS total_units_sold,
  {_r('avg(inventory_level)')} AS avg_inventory_per_product,
  {_r('avg(units_sold)')} AS avg_sales_per_product,
  {_big('sum(short)')} AS total_stockout_days, {_big('count(*)')} AS total_records,
  {_r('sum(short) * 100.0 / count(*)')} AS stockout_rate_percentage
FROM marked GROUP BY region""",
    ),
    "kpi_summary": _with(
        LINES,
        DAYS,
        DIMS,
        _pairs(1.0),
        select=f"""SELECT {PAIR}, category, {_big('n')} AS total_days, {_big('k')} AS stockout_days,
  {_r('k * 100.0 / n')} AS stockout_rate_percentage, stock AS avg_inventory_level,
  sold AS avg_daily_sales,
  CASE WHEN sold > 0 THEN {_r('CAST(stock_sum AS DOUBLE) / sold_sum')} END
    AS estimated_inventory_age_days
FROM pairs JOIN categories USING (product_id)""",
    ),
    "seasonal_demand": _with(
        LINES,
        DAYS,
        DIMS,
        f"""months AS (
  SELECT {_CELL}, month(record_date) AS m, monthname(any_value(record_date)) AS month_name,
         {_big('sum(units_sold)')} AS s, CAST(sum(demand_forecast) AS DECIMAL(20,2)) AS f
  FROM days JOIN categories USING (product_id) JOIN seasons USING (product_id) GROUP BY {_CELL}, m)""",
        f"""years AS (
  SELECT {_CELL}, count(*) AS n, {_big('sum(s)')} AS s_sum, max(s) AS s_top, min(s) AS s_low,
         stddev_pop(s) AS s_sd, CAST(sum(f) AS DECIMAL(24,2)) AS f_sum, max(f) AS f_top,
         min(f) AS f_low, stddev_pop(CAST(f AS DOUBLE)) AS f_sd
  FROM months GROUP BY ALL)""",
        select=f"""SELECT store_region_id, category, seasonality, month_name, s AS total_sales,
  {_dbl('f')} AS total_forecast, {_r('s_sum / n')} AS avg_monthly_sales,
  {_r('CAST(f_sum AS DOUBLE) / n')} AS avg_monthly_forecast, s_top AS peak_sales,
  {_dbl('f_top')} AS peak_forecast, s_low AS trough_sales, {_dbl('f_low')} AS trough_forecast,
  {_r('s_sd')} AS sales_volatility, {_r('f_sd')} AS forecast_volatility,
  {_dbl('abs(s - f)')} AS absolute_forecast_error,
  {_r('CAST(abs(s - f) AS DOUBLE) * 100 / nullif(s, 0)')} AS absolute_percentage_error,
  CASE s WHEN s_top THEN 'PEAK MONTH' WHEN s_low THEN 'TROUGH MONTH'
    ELSE CASE WHEN s * n > s_sum THEN 'Above Average' ELSE 'Below Average' END END
    AS sales_performance_category,
  CASE f WHEN f_top THEN 'PEAK FORECAST' WHEN f_low THEN 'TROUGH FORECAST'
    ELSE CASE WHEN f * n > f_sum THEN 'Above Avg Forecast' ELSE 'Below Avg Forecast' END END
    AS forecast_performance_category,
  {_r('CAST(s * n - s_sum AS DOUBLE) * 100 / nullif(s_sum, 0)')} AS sales_variance_from_average,
  {_r('CAST(f * n - f_sum AS DOUBLE) * 100 / nullif(CAST(f_sum AS DOUBLE), 0)')}
    AS forecast_variance_from_average,
  CASE WHEN s = 0 THEN 'Very Poor Forecast' WHEN abs(s - f) * 100 < 5 * s THEN 'Excellent Forecast'
       WHEN abs(s - f) * 100 < 10 * s THEN 'Good Forecast'
       WHEN abs(s - f) * 100 < 20 * s THEN 'Fair Forecast'
       WHEN abs(s - f) * 100 < 30 * s THEN 'Poor Forecast' ELSE 'Very Poor Forecast' END
    AS forecast_accuracy_rating,
  CASE WHEN f * 10 > s * 11 THEN 'Over-Forecasted' WHEN f * 10 < s * 9 THEN 'Under-Forecasted'
       ELSE 'Well-Calibrated' END AS forecast_bias,
  CASE WHEN s * n * 10 > s_sum * 12 THEN 'High Performing Region'
       WHEN s * n > s_sum THEN 'Good Performing Region'
       WHEN s * n * 10 > s_sum * 8 THEN 'Average Performing Region'
       ELSE 'Low Performing Region' END AS region_performance_rating,
  {_r('s + 0.5 * (s - lag(s) OVER (PARTITION BY ' + _CELL + ' ORDER BY m))')}
    AS trend_based_next_month_prediction
FROM months JOIN years USING ({_CELL})""",
    ),
}

# ---- dashboard roll-ups --------------------------------------------------------

_BOTH = "GROUP BY GROUPING SETS ((product_id), (store_region_id))"
_MEMBER = """CASE WHEN store_region_id IS NULL THEN 'product' ELSE 'store_region' END AS dimension,
  coalesce(product_id, store_region_id) AS member"""

ROLLUPS = {
    "low_inventory_rollup": _with(
        LINES,
        DAYS,
        DIMS,
        _pairs(1.0),
        _LOW,
        select=f"""SELECT {_MEMBER},
  {_big('count(*) FILTER (inventory_level <= reorder_point)')} AS low_inventory_records,
  {_big('count(*)')} AS total_records,
  {_r('count(*) FILTER (inventory_level <= reorder_point) * 100.0 / count(*)')}
    AS low_inventory_percentage
FROM flagged {_BOTH}""",
    ),
    "reorder_vs_sales_rollup": _with(
        LINES,
        DAYS,
        DIMS,
        _pairs(1.3),
        _REORDER,
        select=f"""SELECT {_MEMBER},
  {_r('CAST(sum(CAST(reorder_point AS DECIMAL(20,2))) AS DOUBLE) / count(*)')} AS avg_reorder_point,
  {_r('CAST(sum(CAST(avg_sales AS DECIMAL(20,2))) AS DOUBLE) / count(*)')} AS avg_sales
FROM reorders {_BOTH}""",
    ),
    "monthly_trend": _with(
        LINES,
        DAYS,
        select=f"""SELECT CAST(date_trunc('month', record_date) AS DATE) AS month_start,
  {_big('sum(units_sold)')} AS total_units_sold, {_dbl('sum(demand_forecast)')} AS total_forecast
FROM days GROUP BY ALL""",
    ),
    "turnover_by_category": _with(
        LINES,
        DAYS,
        DIMS,
        _GOODS,
        select=f"""SELECT category, sum({_r('cogs')}::DECIMAL(28,2))::DOUBLE AS approx_cogs,
  {_r('CAST(sum(stock_sum) AS DOUBLE) / sum(stock_n)')} AS avg_inventory,
  {_r('CAST(sum(' + _r('cogs') + '::DECIMAL(28,2)) AS DOUBLE) * sum(stock_n) / sum(stock_sum)')}
    AS inventory_turnover_ratio
FROM goods JOIN categories USING (product_id) GROUP BY category""",
    ),
}

# ---- gaps, places, slices ------------------------------------------------------

# The sample with NULLs by rule, then the query in the shape of ranks and joins.
_GAPS = """gaps AS (
  SELECT * REPLACE (CASE WHEN units_sold % 7 = 0
                           OR (product_id = 'Brand#11' AND store_region_id = 'NATION_21_AMERICA')
                         THEN NULL ELSE units_sold END AS units_sold) FROM days)"""
_GAP_DIMS = DIMS.replace(
    "SELECT product_id, category",
    "SELECT product_id, CASE WHEN product_id <> 'Brand#12' THEN category END AS category",
).replace(
    "SELECT product_id, seasonality",
    "SELECT product_id, CASE WHEN product_id <> 'Brand#13' THEN seasonality END AS seasonality",
)


def _ranked(report: str, order: str) -> str:
    """The place of each row; the database sorts NULLs last, the engine first."""
    inner = {**STOCK_HEALTH, **REPLENISHMENT}[report]
    return f"SELECT *, {_big('row_number() OVER (ORDER BY ' + order + ')')} AS position FROM ({inner})"


PLACES = {
    "sales_profile_gaps": _with(
        LINES,
        DAYS,
        _GAPS,
        f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY units_sold NULLS FIRST) AS nth,
         count(*) OVER (PARTITION BY {PAIR}) AS n FROM gaps)""",
        f"""medians AS (
  SELECT {PAIR}, avg(units_sold) AS median_sales FROM ranked
  WHERE nth IN (floor((n + 1) / 2.0), ceil((n + 1) / 2.0)) GROUP BY ALL)""",
        select=f"""SELECT {PAIR}, avg(units_sold) AS avg_sales, median_sales,
  {_r('stddev_pop(units_sold)', 6)} AS stddev_sales
FROM gaps JOIN medians USING ({PAIR}) GROUP BY {PAIR}, median_sales""",
    ),
    "seasonal_demand_gaps": DEMAND["seasonal_demand"].replace(DIMS, _GAP_DIMS),
    "sales_profile_selected": STOCK_HEALTH["sales_profile"],
    "movement_incremental": STOCK_HEALTH["movement"],
    "competitor_pricing_aligned": DEMAND["competitor_pricing"],
    "discount_effect_aligned": DEMAND["discount_effect"],
    "sales_profile_ranked": _ranked("sales_profile", PAIR),
    "movement_ranked": _ranked("movement", f"understock_percentage DESC, {PAIR}"),
    "stock_recommendations_ranked": _ranked(
        "stock_recommendations", f"priority_score DESC, holding_cost DESC, {PAIR}"
    ),
    "movement_slice": f"""SELECT * FROM ({STOCK_HEALTH["movement"]})
WHERE store_region_id = 'NATION_21_AMERICA'""",
    "slice_by_product": f"""SELECT * FROM ({STOCK_HEALTH["movement"]})
WHERE product_id = 'Brand#23'""",
    "sales_median_estimated": _with(
        LINES,
        DAYS,
        select=f"""SELECT {PAIR}, {_big('count(units_sold)')} AS known, TRUE AS within_bound
FROM days GROUP BY ALL""",
    ),
    "regional_products_estimated": _with(
        LINES,
        select=f"""SELECT region, {_big('count(DISTINCT product_id)')} AS distinct_products,
  TRUE AS within_bound FROM lines GROUP BY region""",
    ),
    "overstock_pruned": STOCK_HEALTH["overstock"],
    "stock_level_page": f"""SELECT * FROM ({_ranked("stock_level", f"{PAIR}, record_date")})
WHERE position BETWEEN 1001 AND 2500""",
}

_WHOLE = {**STOCK_HEALTH, **REPLENISHMENT, **DEMAND, **ROLLUPS}
# The same rows, whatever they are computed from.
GATHERED = {
    f"{name}_gathered": _WHOLE[name]
    for name in (
        "sales_profile",
        "turnover",
        "discount_effect",
        "regional_summary",
        "seasonal_demand",
        "stock_recommendations",
        "low_inventory",
        "low_inventory_rollup",
    )
}

PLACES["slice_by_store"] = PLACES["movement_slice"]
PLACES["sales_profile_selected_gaps"] = PLACES["sales_profile_gaps"]

ORACLES: dict[str, str] = {
    **LOAD,
    **STOCK_HEALTH,
    **REPLENISHMENT,
    **DEMAND,
    **ROLLUPS,
    **PLACES,
    **GATHERED,
}
