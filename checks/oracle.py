"""The same results in SQL, for DuckDB over the same Parquet tables.

Written independently of the Spark jobs, with bounds and labels of its own. Rounding goes through the shortest text of a double, read as a DECIMAL:
Spark rounds that text half up, whatever the binary value behind it.
"""

from __future__ import annotations

from checks import limits as G
from checks.limits import AS_OF, DEFAULT_LIMITS, REGISTERED_LIMITS, ProductLimits

STAR = """
dim_customers AS (
  SELECT c_custkey AS customer_key,
         c_custkey + 11000 AS customer_id,
         c_name AS customer_number,
         split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         n_name AS country,
         CASE c_custkey % 2 WHEN 0 THEN 'Married' ELSE 'Single' END AS marital_status,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'n/a' END AS gender,
         CAST(DATE '1940-01-01' + CAST((c_custkey * 137) % 24000 AS INTEGER) AS DATE) AS birthdate,
         DATE '1994-01-01' AS create_date
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
),
dim_products AS (
  SELECT p_partkey AS product_key,
         p_partkey + 210 AS product_id,
         'P-' || p_partkey AS product_number,
         p_name || ' ' || p_partkey AS product_name,
         p_type || '_' || p_brand AS category_id,
         p_type AS category,
         p_brand AS subcategory,
         CASE p_partkey % 2 WHEN 0 THEN 'Yes' ELSE 'No' END AS maintenance,
         CAST((p_partkey * 7) % 2200 AS INTEGER) AS cost,
         p_type AS product_line,
         DATE '1994-01-01' AS start_date
  FROM part
),
fact_sales AS (
  SELECT 'SO' || l_orderkey AS order_number,
         l_partkey AS product_key,
         o_custkey AS customer_key,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(l_shipdate AS DATE) AS shipping_date,
         CAST(CAST(o_orderdate AS DATE) + 12 AS DATE) AS due_date,
         CAST(floor(l_extendedprice / 200) AS INTEGER) AS sales_amount,
         CAST(l_quantity AS SMALLINT) AS quantity,
         CAST(floor(l_extendedprice / 200 / l_quantity) AS INTEGER) AS price
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
),
dated AS (SELECT * FROM fact_sales WHERE order_date IS NOT NULL)
""".strip()

TODAY = f"DATE '{AS_OF.isoformat()}'"


def query(body: str, *steps: str) -> str:
    return "WITH " + ",\n".join([STAR, *(s.strip() for s in steps)]) + "\n" + body.strip()


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def integer(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def two_places(x: str) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


def over(x: str, y: str) -> str:
    """Plain ratio to two places."""
    return two_places(f"CAST({x} AS DOUBLE) / nullif({y}, 0)")


def pct(x: str, y: str) -> str:
    return two_places(f"CAST({x} AS DOUBLE) / nullif({y}, 0) * 100")


def mean(x: str, window: str = "") -> str:
    """Integer average, truncated."""
    return big(f"sum({x}) {window} // nullif(count({x}) {window}, 0)")


def total(x: str) -> str:
    return big(f"sum({x})")


def months(a: str, b: str) -> str:
    return integer(f"date_diff('month', {a}, {b})")


def years(a: str, b: str) -> str:
    return integer(f"date_diff('year', {a}, {b})")


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ladder(x: str, op: str, steps: G.Ladder, otherwise: str) -> str:
    rungs = " ".join(f"WHEN {x} {op} {bound} THEN {text(label)}" for bound, label in steps)
    return f"CASE {rungs} ELSE {text(otherwise)} END"


def performance(x: str, t: ProductLimits) -> str:
    high, mid, low = map(text, G.PERFORMANCE)
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {t.product_mid_sales} THEN {low} "
        f"WHEN {x} < {t.product_high_sales} THEN {mid} ELSE {high} END"
    )


def lifecycle(span: str, spent: str) -> str:
    vip, regular, new = map(text, G.LIFECYCLE)
    return (
        f"CASE WHEN coalesce({span}, 0) < {G.LOYAL_MONTHS} OR {spent} IS NULL THEN {new} "
        f"WHEN {spent} > {G.VIP_SPENDING} THEN {vip} ELSE {regular} END"
    )


AGE = years("birthdate", TODAY)
BY_PRODUCT = "fact_sales s LEFT JOIN dim_products p USING (product_key)"


def _profile() -> str:
    # fixed values: column types as Spark names them
    tables = {
        "Customers": (
            "dim_customers",
            "customer_key:bigint customer_id:bigint customer_number:string first_name:string "
            "last_name:string country:string marital_status:string gender:string birthdate:date "
            "create_date:date",
        ),
        "Products": (
            "dim_products",
            "product_key:bigint product_id:bigint product_number:string product_name:string "
            "category_id:string category:string subcategory:string maintenance:string cost:int "
            "product_line:string start_date:date",
        ),
        "Sales": (
            "fact_sales",
            "order_number:string product_key:bigint customer_key:bigint order_date:date "
            "shipping_date:date due_date:date sales_amount:int quantity:smallint price:int",
        ),
    }
    parts = []
    for shown, (table, columns) in tables.items():
        pairs = [c.split(":") for c in columns.split()]
        parts += [
            f"SELECT {text(shown)} AS table_name, {len(pairs)} AS number_of_columns, "
            f"{i} AS ordinal_position, {text(c)} AS column_name, {text(t)} AS data_type, "
            f"count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {table}"
            for i, (c, t) in enumerate(pairs, start=1)
        ]
    return query("\nUNION ALL ".join(parts))


def _distribution(table: str, by: str, counted: str, with_total: bool) -> str:
    step = f"g AS (SELECT {by}, count(*) AS {counted} FROM {table} GROUP BY {by})"
    body = (
        f"SELECT {by}, {counted}, "
        + pct(counted, f"(SELECT sum({counted}) FROM g)")
        + " AS percentage FROM g"
    )
    if with_total:
        body += f" UNION ALL SELECT 'Total', {total(counted)}, CAST(100 AS DOUBLE) FROM g"
    return query(body + f" ORDER BY {counted} DESC", step)


# Customers as the facts know them: unknown keys fall into one nameless customer.
CUSTOMER_TOTALS = f"""
known AS (SELECT c.customer_key, c.first_name, c.last_name, s.order_number, s.sales_amount, s.order_date
          FROM fact_sales s LEFT JOIN dim_customers c ON c.customer_key = s.customer_key),
per_customer AS (
  SELECT customer_key, first_name, last_name, {total('sales_amount')} AS total_sales,
         count(DISTINCT order_number) AS total_orders,
         {mean('sales_amount')} AS avg_transaction_value,
         {months('min(order_date)', 'max(order_date)')} AS lifespan
  FROM known GROUP BY ALL)
"""

PRODUCT_TOTALS = f"""
per_product AS (
  SELECT p.product_name, p.category, p.subcategory, {total('s.sales_amount')} AS total_sales,
         {total('s.quantity')} AS total_quantity_sold, count(DISTINCT s.order_number) AS total_orders
  FROM {BY_PRODUCT} GROUP BY ALL)
"""

SUBCATEGORY_TOTALS = f"""
per_subcategory AS (
  SELECT p.subcategory, p.category, {total('s.sales_amount')} AS total_sales,
         count(DISTINCT p.product_key) AS number_of_products
  FROM fact_sales s LEFT JOIN dim_products p ON p.product_key = s.product_key GROUP BY ALL)
"""


def _month_over_month(exact: bool) -> str:
    growth = (
        pct("now_sales - before_sales", "before_sales")
        if exact
        else big("(now_sales - before_sales) // nullif(before_sales, 0) * 100")
    )
    return query(
        f"""
SELECT strftime(m, '%Y-%m') AS order_month, now_sales AS monthly_total_sales,
       before_sales AS previous_month_sales, now_sales - before_sales AS month_over_month_diff,
       {growth} AS month_over_month_growth_pct, ytd_sales,
       buyers AS monthly_total_customers, yearly_total_customers
FROM w ORDER BY m""",
        f"""
g AS (SELECT date_trunc('month', order_date) AS m, {total('sales_amount')} AS now_sales,
             count(DISTINCT customer_key) AS buyers FROM dated GROUP BY 1)""",
        f"""
w AS (SELECT *, lag(now_sales) OVER (ORDER BY m) AS before_sales,
             {big('sum(now_sales) OVER (PARTITION BY year(m) ORDER BY m)')} AS ytd_sales,
             {big('sum(buyers) OVER (PARTITION BY year(m))')} AS yearly_total_customers FROM g)""",
    )


def _product_yoy(exact: bool) -> str:
    growth = (
        pct("now_sales - before_sales", "before_sales")
        if exact
        else big("(now_sales - before_sales) // nullif(before_sales, 0) * 100")
    )
    return query(
        f"""
SELECT y AS order_year, product_name, category, now_sales AS current_year_sales,
       before_sales AS previous_year_sales, now_sales - before_sales AS yoy_sales_diff,
       {growth} AS yoy_growth_pct,
       CASE coalesce(sign(now_sales - before_sales), 0)
            WHEN 1 THEN 'Growth' WHEN -1 THEN 'Decline' ELSE 'No Change' END AS yoy_trend,
       usual AS product_avg_sales, now_sales - usual AS diff_from_avg,
       CASE sign(now_sales - usual) WHEN 1 THEN 'Above Average' WHEN -1 THEN 'Below Average'
            ELSE 'At Average' END AS performance_vs_avg
FROM w ORDER BY product_name, y""",
        f"""
g AS (SELECT p.product_name, p.category, {integer('year(d.order_date)')} AS y,
             {total('d.sales_amount')} AS now_sales
      FROM dated d JOIN dim_products p USING (product_key) GROUP BY ALL)""",
        f"""
w AS (SELECT *, lag(now_sales) OVER (PARTITION BY product_name
                                     ORDER BY y, category NULLS FIRST) AS before_sales,
             {mean('now_sales', 'OVER (PARTITION BY product_name)')} AS usual FROM g)""",
    )


def _report_customers(body: str) -> str:
    money, n, span, idle = "value", "orders", "lifespan_months", "recency_months"
    health = " ".join(
        f"WHEN {rule} THEN {text(label)}"
        for rule, label in zip(
            (
                f"{money} >= 5000 AND {n} >= 5 AND {idle} <= 3",
                f"{money} >= 2000 AND {idle} <= 6",
                f"{money} >= 1000 OR {idle} <= 6",
                "TRUE",
            ),
            G.HEALTH,
        )
    )
    return query(
        body,
        f"""
m AS (
  SELECT c.customer_key, c.customer_number, c.first_name, c.last_name, c.gender, c.country, c.birthdate,
         count(DISTINCT d.order_number) AS orders, count(DISTINCT d.product_key) AS products,
         {total('d.sales_amount')} AS value, {total('d.quantity')} AS items,
         {mean('d.sales_amount')} AS usual_sale, {mean('d.price')} AS usual_price,
         min(d.price) AS low, max(d.price) AS high,
         min(d.order_date) AS first_day, max(d.order_date) AS last_day
  FROM dated d LEFT JOIN dim_customers c ON c.customer_key = d.customer_key
  GROUP BY ALL)""",
        f"""
t AS (SELECT *, {AGE} AS age, {months('first_day', 'last_day')} AS lifespan_months,
             {months('last_day', TODAY)} AS recency_months FROM m)""",
        f"""
report AS (
  SELECT customer_key, customer_number, first_name, last_name,
         coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS full_name,
         age, {ladder('age', '<', G.AGE_BELOW, G.AGE_OTHERWISE)} AS age_group,
         gender, country, birthdate,
         {lifecycle(span, money)} AS customer_segment,
         {ladder(idle, '<=', G.RECENCY_UP_TO, G.CUSTOMER_RECENCY_OTHERWISE)} AS engagement_status,
         {ladder(money, '>=', G.VALUE_FROM, G.VALUE_OTHERWISE)} AS value_tier,
         {ladder(n, '>=', G.FREQUENCY_FROM, G.FREQUENCY_OTHERWISE)} AS purchase_frequency_segment,
         first_day AS first_order_date, last_day AS last_order_date, recency_months,
         {integer(f"date_diff('day', last_day, {TODAY})")} AS recency_days, lifespan_months,
         orders AS total_orders, products AS total_products, items AS total_quantity,
         value AS customer_lifetime_value, usual_sale AS avg_transaction_value,
         {over(money, n)} AS avg_order_value, {over(money, span)} AS avg_monthly_spend,
         {over(n, span)} AS avg_orders_per_month, {over('items', n)} AS avg_items_per_order,
         {over('products', n)} AS product_diversity_score,
         high AS highest_price_paid, low AS lowest_price_paid, usual_price AS avg_price_paid,
         CASE {health} END AS customer_health_score,
         dense_rank() OVER (ORDER BY value DESC NULLS LAST) AS revenue_rank,
         dense_rank() OVER (ORDER BY orders DESC) AS order_frequency_rank,
         dense_rank() OVER (PARTITION BY country ORDER BY value DESC NULLS LAST) AS country_revenue_rank,
         ntile(10) OVER by_value AS revenue_decile, ntile(4) OVER by_value AS revenue_quartile
  FROM t
  WINDOW by_value AS (ORDER BY value DESC NULLS LAST, customer_key NULLS FIRST))""",
    )


def _product_performance(lim: ProductLimits) -> str:
    return query(
        f"""
SELECT {performance('sales', lim)} AS performance_segment,
       count(product_key) AS total_products, {mean('sales')} AS avg_sales_per_product,
       min(sales) AS min_sales, max(sales) AS max_sales,
       {pct('count(product_key)', '(SELECT count(product_key) FROM g)')} AS product_percentage
FROM g GROUP BY 1 ORDER BY 4 DESC""",
        f"""
g AS (SELECT p.product_key, p.product_name, p.category, {total('s.sales_amount')} AS sales
      FROM fact_sales s LEFT JOIN dim_products p ON p.product_key = s.product_key GROUP BY ALL)""",
    )


def _report_products(body: str, lim: ProductLimits = REGISTERED_LIMITS) -> str:
    health = " ".join(
        f"WHEN {rule} THEN {text(label)}"
        for rule, label in zip(
            (
                f"revenue >= {lim.product_high_sales} AND recency_months <= 3",
                f"revenue >= {lim.product_mid_sales} AND recency_months <= 6",
                f"revenue >= {lim.product_mid_sales} OR recency_months <= 6",
                "TRUE",
            ),
            G.HEALTH,
        )
    )
    return query(
        body,
        f"""
m AS (
  SELECT p.product_key, p.product_name, p.category, p.subcategory, p.cost,
         count(DISTINCT s.order_number) AS orders, count(DISTINCT s.customer_key) AS buyers,
         {total('s.sales_amount')} AS revenue, {mean('s.sales_amount')} AS usual_sale,
         {total('s.quantity')} AS items, min(s.order_date) AS first_day, max(s.order_date) AS last_day,
         {two_places('avg(CAST(s.sales_amount AS DOUBLE) / nullif(s.quantity, 0))')} AS unit_price,
         min(s.price) AS low, max(s.price) AS high
  FROM fact_sales s LEFT JOIN dim_products p ON p.product_key = s.product_key
  GROUP BY ALL)""",
        f"""
t AS (SELECT *, {months('first_day', 'last_day')} AS lifespan_months,
             {months('last_day', TODAY)} AS recency_months FROM m)""",
        f"""
report AS (
  SELECT product_key, product_name, category, subcategory, cost AS product_cost,
         {ladder('cost', '<', G.REPORT_COST_BELOW, G.REPORT_COST_OTHERWISE)} AS cost_range,
         first_day AS first_sale_date, last_day AS last_sale_date, recency_months, lifespan_months,
         {performance('revenue', lim)} AS performance_segment,
         {ladder('recency_months', '<=', G.RECENCY_UP_TO, G.PRODUCT_RECENCY_OTHERWISE)} AS recency_status,
         orders AS total_orders, buyers AS total_customers, items AS total_quantity,
         revenue AS total_sales, {pct('revenue', '(SELECT sum(revenue) FROM m)')} AS sales_percentage,
         usual_sale AS avg_transaction_value, {over('revenue', 'orders')} AS avg_order_revenue,
         {over('revenue', 'lifespan_months')} AS avg_monthly_revenue,
         {over('orders', 'buyers')} AS avg_orders_per_customer,
         unit_price AS avg_selling_price, low AS min_selling_price, high AS max_selling_price,
         {two_places('unit_price - cost')} AS avg_profit_margin,
         {pct('(unit_price - cost)', 'cost')} AS profit_margin_pct,
         CASE {health} END AS product_health_score,
         dense_rank() OVER (PARTITION BY category ORDER BY revenue DESC NULLS LAST) AS category_revenue_rank,
         dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS overall_revenue_rank
  FROM t)""",
    )


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}

    # --- exploration ---
    q["e01_schema_profile"] = _profile()
    q["e02_countries"] = query("SELECT country FROM dim_customers GROUP BY 1 ORDER BY 1 NULLS FIRST")
    q["e03_product_catalog"] = query(
        "SELECT product_id, product_name, category, subcategory FROM dim_products "
        "ORDER BY 3 NULLS FIRST, 4 NULLS FIRST, 2 NULLS FIRST, 1"
    )
    q["e04_hierarchy_depth"] = query(
        "SELECT category, count(DISTINCT subcategory) AS number_of_subcategories, "
        "count(*) AS number_of_products FROM dim_products GROUP BY category ORDER BY 2 DESC, 3 DESC"
    )
    q["e05_sales_preview"] = query(
        "SELECT * FROM fact_sales ORDER BY "
        + ", ".join(f"{i} NULLS FIRST" for i in range(1, 10))
        + " LIMIT 100"
    )
    q["e06_business_timeframe"] = query(
        f"SELECT a AS start_date, b AS end_date, {months('a', 'b')} AS duration_in_months, "
        f"{years('a', 'b')} AS duration_in_years FROM span",
        "span AS (SELECT min(order_date) AS a, max(order_date) AS b FROM fact_sales)",
    )
    q["e07_customer_ages"] = query(
        f"SELECT min(age) AS youngest_age, max(age) AS oldest_age, {mean('age')} AS average_age, "
        "min(birthdate) AS youngest_birthdate, max(birthdate) AS oldest_birthdate FROM aged",
        f"aged AS (SELECT birthdate, {AGE} AS age FROM dim_customers)",
    )
    kpis = {
        "Total Sales": "sales",
        "Items Sold": "items",
        "Average Price": "price",
        "Total Orders": "orders",
        "Total Products": "products",
        "Total Customers": "customers",
        "Customers With Orders": "buyers",
        "Customer Engagement Rate (%)": pct("buyers", "customers"),
        "Average Order Value": "sales // nullif(orders, 0)",
        "Revenue Per Customer": "sales // nullif(buyers, 0)",
    }
    q["e08_kpi_dashboard"] = query(
        "\nUNION ALL ".join(
            f"SELECT {text(k)} AS measure_name, CAST({v} AS DOUBLE) AS measure_value FROM k"
            for k, v in kpis.items()
        ),
        f"""
k AS (SELECT sum(sales_amount) AS sales, sum(quantity) AS items, {mean('price')} AS price,
             count(DISTINCT order_number) AS orders, count(DISTINCT customer_key) AS buyers,
             (SELECT count(*) FROM dim_products) AS products,
             (SELECT count(*) FROM dim_customers) AS customers FROM fact_sales)""",
    )
    q["e09_country_distribution"] = _distribution("dim_customers", "country", "total_customers", False)
    q["e10_gender_distribution"] = _distribution("dim_customers", "gender", "total_customers", True)
    q["e11_category_distribution"] = _distribution("dim_products", "category", "total_products", True)
    q["e12_cost_by_category"] = query(
        f"SELECT category, typical AS avg_cost, lo AS min_cost, hi AS max_cost FROM g UNION ALL "
        f"SELECT 'Overall Average', {mean('typical')}, min(lo), max(hi) FROM g ORDER BY 2 DESC",
        f"g AS (SELECT category, {mean('cost')} AS typical, min(cost) AS lo, max(cost) AS hi "
        "FROM dim_products GROUP BY category)",
    )
    by_category = f"""
g AS (SELECT p.category, {total('s.sales_amount')} AS sales, {total('s.quantity')} AS items,
             count(DISTINCT s.order_number) AS orders FROM {BY_PRODUCT} GROUP BY 1)"""
    q["e13_sales_by_category"] = query(
        f"""
SELECT category, sales AS total_sales, orders AS total_orders,
       {pct('sales', 'sum(sales) OVER ()')} AS sales_percentage,
       dense_rank() OVER (ORDER BY sales DESC) AS revenue_rank FROM g
UNION ALL SELECT 'Total', {total('sales')}, {total('orders')}, CAST(100 AS DOUBLE), NULL FROM g
ORDER BY 2 DESC""",
        by_category,
    )
    q["e14_items_by_country"] = query(
        f"""
SELECT country, items AS total_items_sold, sales AS total_sales,
       {pct('items', 'sum(items) OVER ()')} AS items_percentage,
       {pct('sales', 'sum(sales) OVER ()')} AS sales_percentage FROM g
UNION ALL SELECT 'Total', {total('items')}, {total('sales')}, CAST(100 AS DOUBLE), CAST(100 AS DOUBLE) FROM g
ORDER BY 2 DESC""",
        f"""
g AS (SELECT c.country, {total('s.quantity')} AS items, {total('s.sales_amount')} AS sales
      FROM fact_sales s LEFT JOIN dim_customers c USING (customer_key) GROUP BY 1)""",
    )
    q["e15_clv_summary"] = query(
        f"""
SELECT count(customer_key) AS total_customers, {mean('spent')} AS avg_customer_ltv,
       min(spent) AS min_customer_ltv, max(spent) AS max_customer_ltv,
       {mean('orders')} AS avg_orders_per_customer, {mean('usual')} AS avg_transaction_value FROM g""",
        f"""
g AS (SELECT s.customer_key, c.first_name, c.last_name, {total('s.sales_amount')} AS spent,
             count(DISTINCT s.order_number) AS orders, {mean('s.sales_amount')} AS usual
      FROM fact_sales s LEFT JOIN dim_customers c ON c.customer_key = s.customer_key GROUP BY ALL)""",
    )
    q["e16_top10_customers"] = query(
        "SELECT customer_key, first_name, last_name, total_sales, total_orders, avg_transaction_value "
        "FROM per_customer ORDER BY total_sales DESC NULLS LAST, customer_key NULLS FIRST LIMIT 10",
        CUSTOMER_TOTALS,
    )
    q["e17_bottom10_customers"] = query(
        "SELECT customer_key, first_name, last_name, total_orders, total_sales FROM per_customer "
        "ORDER BY total_orders, total_sales NULLS FIRST, customer_key NULLS FIRST LIMIT 10",
        CUSTOMER_TOTALS,
    )
    tie = "product_name NULLS FIRST, category NULLS FIRST, subcategory NULLS FIRST"
    q["e18_top10_products"] = query(
        f"SELECT * FROM per_product ORDER BY total_sales DESC NULLS LAST, {tie} LIMIT 10", PRODUCT_TOTALS
    )
    q["e19_top10_products_ranked"] = query(
        f"""
SELECT product_name, category, sales AS total_sales, {pct('sales', 'whole')} AS sales_percentage,
       place AS revenue_rank FROM ranked WHERE place <= 10""",
        f"""
g AS (SELECT p.product_name, p.category, {total('s.sales_amount')} AS sales FROM {BY_PRODUCT} GROUP BY ALL)""",
        """
ranked AS (SELECT *, sum(sales) OVER () AS whole,
                  dense_rank() OVER (ORDER BY sales DESC NULLS LAST) AS place FROM g)""",
    )
    q["e20_bottom10_products"] = query(
        "SELECT product_name, category, subcategory, total_sales, total_quantity_sold "
        f"FROM per_product ORDER BY total_sales NULLS FIRST, {tie} LIMIT 10",
        PRODUCT_TOTALS,
    )
    tie = "subcategory NULLS FIRST, category NULLS FIRST"
    share = pct("total_sales", "(SELECT sum(total_sales) FROM per_subcategory)")
    q["e21_top10_subcategories"] = query(
        f"SELECT *, {share} AS sales_percentage FROM per_subcategory "
        f"ORDER BY total_sales DESC NULLS LAST, {tie} LIMIT 10",
        SUBCATEGORY_TOTALS,
    )
    q["e22_bottom10_subcategories"] = query(
        f"SELECT * FROM per_subcategory ORDER BY total_sales NULLS FIRST, {tie} LIMIT 10",
        SUBCATEGORY_TOTALS,
    )

    # --- trends ---
    q["a01_monthly_trend"] = query(
        f"""
SELECT strftime(order_date, '%Y-%m') AS order_month, {total('sales_amount')} AS total_sales,
       count(DISTINCT customer_key) AS total_customers, {total('quantity')} AS total_quantity,
       {mean('price')} AS avg_price FROM dated GROUP BY 1 ORDER BY 1"""
    )
    q["a02_yearly_trend"] = query(
        f"""
SELECT {integer('year(order_date)')} AS order_year, {total('sales_amount')} AS total_sales,
       count(DISTINCT customer_key) AS total_customers, {total('quantity')} AS total_quantity,
       count(DISTINCT order_number) AS total_orders, {mean('price')} AS avg_price
FROM dated GROUP BY 1 ORDER BY 1"""
    )
    q["a03_seasonality"] = query(
        f"""
SELECT {integer('month(order_date)')} AS month_number, monthname(order_date) AS month_name,
       {total('sales_amount')} AS total_sales, count(DISTINCT customer_key) AS total_customers,
       {total('quantity')} AS total_quantity, count(DISTINCT order_number) AS total_orders
FROM dated GROUP BY 1, 2 ORDER BY 1"""
    )
    q["a04_month_over_month"] = _month_over_month(exact=False)
    q["a04x_month_over_month_exact"] = _month_over_month(exact=True)
    q["a05_monthly_running"] = query(
        f"""
SELECT m AS order_month, sales AS total_sales, {big('sum(sales) OVER t')} AS running_total_sales,
       {mean('sales', 'OVER (ORDER BY m ROWS 2 PRECEDING)')} AS rolling_3_month_avg_sales,
       {big('sum(sales) OVER (ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS rolling_3_month_total,
       price AS avg_price, {mean('price', 'OVER t')} AS cumulative_avg_price
FROM g WINDOW t AS (ORDER BY m) ORDER BY m""",
        f"""
g AS (SELECT strftime(order_date, '%Y-%m') AS m, {total('sales_amount')} AS sales,
             {mean('price')} AS price FROM dated GROUP BY 1)""",
    )
    q["a06_yearly_running"] = query(
        f"""
SELECT y AS order_year, sales AS total_sales, {big('sum(sales) OVER t')} AS running_total_sales,
       {mean('price', 'OVER t')} AS cumulative_avg_price
FROM g WINDOW t AS (ORDER BY y) ORDER BY y""",
        f"""
g AS (SELECT {integer('year(order_date)')} AS y, {total('sales_amount')} AS sales,
             {mean('price')} AS price FROM dated GROUP BY 1)""",
    )
    q["a07_product_yoy"] = _product_yoy(exact=False)
    q["a07x_product_yoy_exact"] = _product_yoy(exact=True)

    # --- contribution ---
    q["a08_category_contribution"] = query(
        f"""
SELECT category, sales AS category_sales, orders AS total_orders, items AS total_quantity,
       {big('sum(sales) OVER ()')} AS total_sales, {pct('sales', 'sum(sales) OVER ()')} AS sales_percentage,
       dense_rank() OVER (ORDER BY sales DESC) AS revenue_rank FROM g ORDER BY 2 DESC""",
        by_category,
    )
    q["a09_subcategory_contribution"] = query(
        f"""
SELECT category, subcategory, sales AS subcategory_sales, orders AS total_orders,
       {big('sum(sales) OVER ()')} AS total_sales, {pct('sales', 'sum(sales) OVER ()')} AS sales_percentage,
       {pct('sales', 'sum(sales) OVER (PARTITION BY category)')} AS category_percentage
FROM g ORDER BY 3 DESC""",
        f"""
g AS (SELECT p.category, p.subcategory, {total('s.sales_amount')} AS sales,
             count(DISTINCT s.order_number) AS orders FROM {BY_PRODUCT} GROUP BY ALL)""",
    )
    q["a10_product_contribution"] = query(
        f"""
SELECT product_name, category, subcategory, total_sales, total_quantity_sold AS total_quantity,
       {big('sum(total_sales) OVER ()')} AS overall_total_sales,
       {pct('total_sales', 'sum(total_sales) OVER ()')} AS sales_percentage,
       dense_rank() OVER (ORDER BY total_sales DESC NULLS LAST) AS revenue_rank
FROM per_product ORDER BY 4 DESC""",
        PRODUCT_TOTALS,
    )

    # --- segmentation ---
    q["a11_age_groups"] = query(
        f"""
SELECT {ladder('age', '<', G.AGE_BELOW, G.AGE_OTHERWISE)} AS age_group,
       count(customer_key) AS total_customers, {total('spent')} AS total_sales,
       {total('orders')} AS total_orders, {mean('spent')} AS avg_sales_per_customer,
       {pct('sum(spent)', '(SELECT sum(spent) FROM g)')} AS sales_percentage
FROM g GROUP BY 1 ORDER BY 3 DESC""",
        f"""
g AS (SELECT s.customer_key, {AGE} AS age, {total('s.sales_amount')} AS spent,
             count(DISTINCT s.order_number) AS orders
      FROM fact_sales s LEFT JOIN dim_customers c ON c.customer_key = s.customer_key GROUP BY ALL)""",
    )
    q["a12_cost_ranges"] = query(
        f"""
SELECT {ladder('cost', '<', G.COST_BELOW, G.COST_OTHERWISE)} AS cost_range, count(*) AS total_products,
       {pct('count(*)', '(SELECT count(*) FROM dim_products)')} AS product_percentage
FROM dim_products GROUP BY 1 ORDER BY min(cost)"""
    )
    for name, lim in (
        ("a13_product_performance", REGISTERED_LIMITS),
        ("a13d_product_performance_defaults", DEFAULT_LIMITS),
    ):
        q[name] = _product_performance(lim)
    q["a14_customer_lifecycle"] = query(
        f"""
SELECT {lifecycle('lifespan', 'total_sales')} AS customer_segment,
       count(customer_key) AS total_customers, {mean('total_sales')} AS avg_spending,
       {mean('total_orders')} AS avg_orders, {mean('lifespan')} AS avg_lifespan_months,
       {pct('count(customer_key)', '(SELECT count(customer_key) FROM per_customer)')} AS customer_percentage
FROM per_customer GROUP BY 1 ORDER BY 1 DESC""",
        CUSTOMER_TOTALS,
    )

    # --- reports ---
    q["r01_report_customers"] = _report_customers("SELECT * FROM report")
    q["r02_report_products"] = _report_products("SELECT * FROM report")
    q["r02d_report_products_defaults"] = _report_products("SELECT * FROM report", DEFAULT_LIMITS)
    q["r03_products_by_sales"] = _report_products(
        "SELECT * FROM report ORDER BY total_sales DESC NULLS LAST, product_key NULLS FIRST"
    )
    q["r04_customers_by_clv"] = _report_customers(
        "SELECT * FROM report ORDER BY customer_lifetime_value DESC NULLS LAST, customer_key NULLS FIRST"
    )
    q["r05_top10_report_products"] = _report_products(
        "SELECT product_name, category, total_sales FROM report "
        "ORDER BY total_sales DESC NULLS LAST, product_key NULLS FIRST LIMIT 10"
    )
    q["r06_at_risk_high_value"] = _report_customers(
        "SELECT full_name, customer_lifetime_value, recency_months FROM report "
        "WHERE engagement_status = 'At Risk' AND value_tier = 'High Value'"
    )

    # --- loads: what comes back is the table that went out ---
    q["l01_load_customers"] = query("SELECT * FROM dim_customers")
    q["l02_load_products"] = query("SELECT * FROM dim_products")
    q["l03_load_sales"] = query("SELECT * FROM fact_sales")
    return q
