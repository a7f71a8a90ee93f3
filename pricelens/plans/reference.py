"""Queries of the price-comparison operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import numbers, scores, text, units
from pricelens.operators import basket, dedup, matching, ranking, rules, serving
from pricelens.plans.offers import OFFERS_SQL, offers
from pricelens.schemas import PRODUCT, RENAMES, to_schema
from pricelens.session import Stage, table
from pricelens.sources.payloads import extract_products
from pricelens.sources.readers import card_prices, parse_rows

LISTINGS = "cba_premium_mejor_por_supermercado"
MARKETS = ["jumbo", "lider", "unimarc"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("@offers", OFFERS_SQL)
        return f

    return register


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, LISTINGS)


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with their basket item, seller and effective price."""
    price = units.effective_price(F.col("list_price_num"), F.col("price_num"))
    return listings(spark, sf_dir).select("listing_id", "cba_name", "supermarket", "brand", "unit", "premium_score", "subcategory", "price_num", price.alias("costo"))


PRICED_SQL = f"priced AS (SELECT listing_id, cba_name, supermarket, brand, unit, premium_score, subcategory, price_num, coalesce(list_price_num, price_num) AS costo FROM {LISTINGS})"
BEST_SQL = f"""{PRICED_SQL}, best AS (SELECT supermarket, cba_name, listing_id, costo FROM priced WHERE costo IS NOT NULL AND cba_name IS NOT NULL AND supermarket IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY supermarket, cba_name ORDER BY costo, listing_id) = 1)"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.best_offers(priced(spark, sf_dir), "cba_name", "supermarket", "costo", "listing_id")


# aggregations


@query(f"""SELECT supermarket, count(*) AS n, count(discount_price_num) AS en_oferta, count(DISTINCT cba_name) AS items FROM {LISTINGS} GROUP BY supermarket""")
def a1_market_counts(spark, sf_dir):
    """Listings, offers and items of each seller, null as one of its own."""
    return listings(spark, sf_dir).groupBy("supermarket").agg(F.count("*").alias("n"), F.count("discount_price_num").alias("en_oferta"), F.count_distinct("cba_name").alias("items"))


@query(f"""SELECT last_category, count(*) AS n FROM {LISTINGS} GROUP BY 1 ORDER BY n DESC, last_category NULLS FIRST LIMIT 12""")
def a1_top_categories(spark, sf_dir):
    """The twelve commonest categories, null among them."""
    return serving.counts_by(listings(spark, sf_dir), "last_category", 12)


@query(f"""SELECT DISTINCT supermarket FROM {LISTINGS} WHERE supermarket IS NOT NULL""")
def a2_distinct_values(spark, sf_dir):
    return serving.distinct_values(listings(spark, sf_dir), "supermarket")


_ORDER = "ORDER BY costo IS NULL, costo, listing_id"


@query(f"""WITH {PRICED_SQL} SELECT cba_name, first(brand {_ORDER}) FILTER (WHERE brand IS NOT NULL) AS brand, first(unit {_ORDER}) FILTER (WHERE unit IS NOT NULL) AS unit,
  first(subcategory {_ORDER}) FILTER (WHERE subcategory IS NOT NULL) AS subcategory FROM priced WHERE cba_name IS NOT NULL GROUP BY cba_name""")
def a3_first_known_values(spark, sf_dir):
    """Each column's own first known value in the order of price."""
    return ranking.first_known_values(priced(spark, sf_dir), ["cba_name"], [("costo", False), ("listing_id", False)], ["brand", "unit", "subcategory"])


@query(f"""WITH {PRICED_SQL} SELECT cba_name, listing_id, supermarket, brand, unit, costo FROM priced WHERE cba_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY cba_name ORDER BY costo ASC NULLS LAST, listing_id) = 1""")
def a3_coherent_rows(spark, sf_dir):
    """The whole row of the cheapest listing of each item."""
    rows = priced(spark, sf_dir).select("cba_name", "listing_id", "supermarket", "brand", "unit", "costo")
    return ranking.coherent_rows(rows, ["cba_name"], [("costo", False), ("listing_id", False)])


@query(f"""WITH {BEST_SQL} SELECT supermarket, count(DISTINCT cba_name) AS items_cubiertos, sum(costo) AS costo_total, 103 AS items_totales,
  round_even(count(DISTINCT cba_name) / 103 * 100, 2) AS cobertura_pct, replace(printf('%.2f%%', round_even(count(DISTINCT cba_name) / 103 * 100, 2)), '.', ',') AS cobertura_pct_fmt FROM best GROUP BY supermarket""")
def a4_market_summary(spark, sf_dir):
    """Items covered and basket cost of each seller."""
    return basket.market_summary(best(spark, sf_dir), "cba_name", "supermarket", "costo", 103)


@query(f"""WITH {BEST_SQL} SELECT cba_name, supermarket, listing_id, costo FROM best QUALIFY row_number() OVER (PARTITION BY cba_name ORDER BY costo, supermarket) = 1""")
def a5_optimal_basket(spark, sf_dir):
    """The cheapest seller of each item."""
    return basket.optimal_basket(best(spark, sf_dir), "cba_name", "supermarket", "costo").select("cba_name", "supermarket", "listing_id", "costo")


@query(f"""SELECT i.cba_name, count(l.price_num) AS candidatos_detectados, count(DISTINCT l.supermarket) AS supermercados_detectados, max(CASE WHEN l.price_num IS NOT NULL THEN 1 ELSE 0 END) AS tiene_match,
  CASE WHEN count(l.price_num) > 0 THEN 'cubierto' ELSE 'faltante' END AS estado FROM cba_items i LEFT JOIN {LISTINGS} l ON i.cba_name = l.cba_name GROUP BY i.cba_name""")
def a6_coverage(spark, sf_dir):
    """Offers, sellers and state of each item of the list."""
    return basket.coverage(table(spark, sf_dir, "cba_items"), listings(spark, sf_dir), "cba_name", "supermarket", "price_num")


@query(f"""WITH {PRICED_SQL} SELECT cba_name, min(costo) FILTER (WHERE supermarket = 'jumbo') AS precio_jumbo, min(costo) FILTER (WHERE supermarket = 'lider') AS precio_lider,
  min(costo) FILTER (WHERE supermarket = 'unimarc') AS precio_unimarc FROM priced WHERE cba_name IS NOT NULL GROUP BY cba_name""")
def a7_prices_by_market(spark, sf_dir):
    """One row an item with each chain's least price."""
    return ranking.prices_by_market(priced(spark, sf_dir), "cba_name", "supermarket", "costo", MARKETS)


@query(f"""WITH {PRICED_SQL} SELECT cba_name, count(DISTINCT supermarket) AS supermercados_encontrados FROM priced WHERE costo IS NOT NULL AND cba_name IS NOT NULL GROUP BY cba_name""")
def a8_markets_found(spark, sf_dir):
    return priced(spark, sf_dir).where("costo is not null and cba_name is not null").groupBy("cba_name").agg(F.count_distinct("supermarket").alias("supermercados_encontrados"))


@query("""SELECT count(*) AS items_carrito, count(precio_mas_bajo) AS items_con_match, sum(precio_mas_bajo) AS costo_total_mas_conveniente, sum(precio_mas_alto) AS costo_total_mas_alto,
  sum(precio_mas_alto) - sum(precio_mas_bajo) AS ahorro_total, round_even((sum(precio_mas_alto) - sum(precio_mas_bajo)) / sum(precio_mas_alto) * 100, 2) AS ahorro_pct_vs_mas_caro,
  (SELECT supermercado_mas_conveniente FROM carrito_resumen_ejecutivo WHERE supermercado_mas_conveniente IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS supermercado_que_gana_mas_items FROM carrito_resumen_ejecutivo""")
def a9_cart_totals(spark, sf_dir):
    """Totals over all cart lines and the seller that wins most of them."""
    lines = table(spark, sf_dir, "carrito_resumen_ejecutivo")
    wins = basket.winner(lines, "supermercado_mas_conveniente").first()
    high, low = F.sum("precio_mas_alto"), F.sum("precio_mas_bajo")
    return lines.agg(
        F.count("*").alias("items_carrito"), F.count("precio_mas_bajo").alias("items_con_match"), low.alias("costo_total_mas_conveniente"), high.alias("costo_total_mas_alto"),
        (high - low).alias("ahorro_total"), numbers.percent(high - low, high).alias("ahorro_pct_vs_mas_caro"), F.lit(wins[0] if wins else None).cast("string").alias("supermercado_que_gana_mas_items"),
    )


@query(f"""WITH {BEST_SQL} SELECT supermarket, string_agg(cba_name, '; ' ORDER BY cba_name) AS items, CAST(count(*) AS INTEGER) AS n_items FROM best GROUP BY supermarket""")
def a11_covered_items(spark, sf_dir):
    """The items that each seller covers."""
    return basket.covered_items(best(spark, sf_dir), "cba_name", "supermarket")


@query(f"""WITH {BEST_SQL} SELECT supermarket, cba_name, listing_id, costo FROM best ORDER BY costo DESC, supermarket, cba_name LIMIT 12""")
def a12_cost_drivers(spark, sf_dir):
    """The twelve dearest of the sellers' best offers."""
    return best(spark, sf_dir).select("supermarket", "cba_name", "listing_id", "costo").orderBy(F.desc("costo"), "supermarket", "cba_name").limit(12)


_EXECUTIVE = f"""WITH {BEST_SQL}, tot AS (SELECT supermarket, sum(costo) AS total, count(*) AS n FROM best GROUP BY supermarket), full_ AS (SELECT * FROM tot WHERE n >= 90),
  opt AS (SELECT sum(c) AS optimo FROM (SELECT min(costo) AS c FROM best GROUP BY cba_name))
  SELECT * FROM (SELECT 'mas_barato' AS indicador, (SELECT supermarket FROM full_ ORDER BY total, supermarket LIMIT 1) AS valor
  UNION ALL SELECT 'costo_mas_barato', (SELECT CAST(CAST(min(total) AS BIGINT) AS VARCHAR) FROM full_) UNION ALL SELECT 'mas_caro', (SELECT supermarket FROM full_ ORDER BY total DESC, supermarket LIMIT 1)
  UNION ALL SELECT 'costo_mas_caro', (SELECT CAST(CAST(max(total) AS BIGINT) AS VARCHAR) FROM full_) UNION ALL SELECT 'costo_optimo', (SELECT CAST(CAST(optimo AS BIGINT) AS VARCHAR) FROM opt))"""


@query(_EXECUTIVE)
def a13_executive_summary(spark, sf_dir):
    """Cheapest, dearest and optimal basket as indicators; sellers that have 90 items and more count."""
    of_market = best(spark, sf_dir)
    totals = of_market.groupBy("supermarket").agg(F.sum("costo").alias("total"), F.count("*").alias("n")).where("n >= 90")
    optimal = of_market.groupBy("cba_name").agg(F.min("costo").alias("c")).agg(F.sum("c")).first()[0]
    row = totals.agg(
        F.min_by("supermarket", F.struct("total", "supermarket")).alias("mas_barato"), F.min("total").cast("bigint").alias("costo_mas_barato"),
        F.min_by("supermarket", F.struct((-F.col("total")).alias("t"), "supermarket")).alias("mas_caro"), F.max("total").cast("bigint").alias("costo_mas_caro"),
        F.lit(optimal).cast("double").cast("bigint").alias("costo_optimo"),
    )
    return basket.key_values(row, row.columns)


@query(f"""WITH {BEST_SQL}, tot AS (SELECT supermarket, sum(costo) AS total, count(DISTINCT cba_name) AS encontrados FROM best GROUP BY supermarket)
  SELECT supermarket, total, encontrados, encontrados = 103 AS completo, encontrados = 103 AND total = (SELECT min(total) FROM tot WHERE encontrados = 103) AS mas_barato FROM tot""")
def a14_complete_totals(spark, sf_dir):
    """Which seller has the whole basket cheapest."""
    found = basket.complete_totals(best(spark, sf_dir), "cba_name", "supermarket", "costo", 103)
    return found


@query(f"""WITH {BEST_SQL}, s AS (SELECT supermarket, sum(costo) AS costo_total FROM best GROUP BY supermarket)
  SELECT supermarket, costo_total, (SELECT sum(c) FROM (SELECT min(costo) AS c FROM best GROUP BY cba_name)) AS costo_optimo, costo_total - (SELECT sum(c) FROM (SELECT min(costo) AS c FROM best GROUP BY cba_name)) AS sobrecosto,
  round_even((costo_total - (SELECT sum(c) FROM (SELECT min(costo) AS c FROM best GROUP BY cba_name))) / (SELECT sum(c) FROM (SELECT min(costo) AS c FROM best GROUP BY cba_name)) * 100, 2) AS sobrecosto_pct FROM s""")
def j6_overcost(spark, sf_dir):
    """Each seller's basket against the optimal mix."""
    of_market = best(spark, sf_dir)
    optimal = of_market.groupBy("cba_name").agg(F.min("costo").alias("c")).agg(F.sum("c")).first()[0]
    return basket.overcost(of_market.groupBy("supermarket").agg(F.sum("costo").alias("costo_total")), optimal)


# windows, orders and duplicates


@query(f"""SELECT supermarket, CAST(puesto AS INTEGER) AS puesto, listing_id FROM (SELECT supermarket, listing_id, row_number() OVER (PARTITION BY supermarket ORDER BY price_num ASC NULLS LAST, listing_id) AS puesto FROM {LISTINGS}) WHERE puesto <= 5""")
def w1_cheapest_of_market(spark, sf_dir):
    """The five cheapest listings of each seller, null as one of its own."""
    return ranking.top_per_group(listings(spark, sf_dir), ["supermarket"], [F.col("price_num").asc_nulls_last(), F.col("listing_id")], 5).select("supermarket", "puesto", "listing_id")


@query(f"""WITH {BEST_SQL}, s AS (SELECT supermarket, sum(costo) AS costo_total FROM best WHERE supermarket IN ('jumbo', 'lider', 'unimarc') GROUP BY supermarket)
  SELECT supermarket, costo_total, costo_total - min(costo_total) OVER () AS ahorro_vs_mas_barato, round_even((costo_total - min(costo_total) OVER ()) / min(costo_total) OVER () * 100, 2) AS ahorro_pct_vs_mas_barato,
  CAST(row_number() OVER (ORDER BY costo_total, supermarket) AS INTEGER) AS ranking FROM s""")
def w2_ranked_by_cost(spark, sf_dir):
    """The chains by basket cost with the distance to the cheapest."""
    totals = best(spark, sf_dir).where(F.col("supermarket").isin(MARKETS)).groupBy("supermarket").agg(F.sum("costo").alias("costo_total"))
    return ranking.ranked_by_cost(totals, "costo_total", "supermarket")


@query(f"""SELECT split_part(archivo, '_', 1) AS market, max(archivo) AS archivo FROM {LISTINGS} WHERE archivo IS NOT NULL GROUP BY 1""")
def s3_last_file_by_name(spark, sf_dir):
    """The last file name of each seller."""
    files = listings(spark, sf_dir).select(F.split("archivo", "_")[0].alias("market"), "archivo")
    return dedup.latest_files(files, "market", "archivo")


@query(f"""SELECT market, archivo FROM (SELECT split_part(archivo, '_', 1) AS market, archivo, extracted_at FROM {LISTINGS} WHERE archivo IS NOT NULL AND extracted_at IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY market ORDER BY extracted_at DESC, archivo DESC) = 1""")
def s4_last_file_by_time(spark, sf_dir):
    """The file of each seller's last capture."""
    files = listings(spark, sf_dir).where("extracted_at is not null").select(F.split("archivo", "_")[0].alias("market"), "archivo", "extracted_at")
    return dedup.latest_files(files, "market", "archivo", "extracted_at")


@query(f"""SELECT l.supermarket, count(*) AS n, sum(l.listing_id) AS ids FROM {LISTINGS} l JOIN (SELECT supermarket, last_category, max(archivo) AS archivo FROM {LISTINGS} WHERE archivo IS NOT NULL GROUP BY 1, 2) m
  ON l.supermarket = m.supermarket AND l.last_category = m.last_category AND l.archivo = m.archivo GROUP BY l.supermarket""")
def s1_latest_snapshots(spark, sf_dir):
    """Rows in the last file of each seller and category."""
    last = dedup.latest_snapshot(listings(spark, sf_dir).select("supermarket", "last_category", "archivo", "listing_id"), ["supermarket", "last_category"], "archivo")
    return last.groupBy("supermarket").agg(F.count("*").alias("n"), F.sum("listing_id").alias("ids"))


@query(f"""SELECT archivo, strptime(regexp_extract(archivo, '(20[0-9]{{6}}_[0-9]{{6}})', 1), '%Y%m%d_%H%M%S') AS timestamp_archivo, regexp_replace(archivo, '_?20[0-9]{{6}}_[0-9]{{6}}.*$', '') AS prefijo, count(*) AS n
  FROM {LISTINGS} WHERE archivo IS NOT NULL GROUP BY ALL""")
def proj2_file_timestamps(spark, sf_dir):
    """The time and prefix that each file name carries."""
    files = listings(spark, sf_dir).where("archivo is not null").groupBy("archivo").agg(F.count("*").alias("n"))
    return files.select("archivo", dedup.file_timestamp(F.col("archivo")).cast("timestamp_ntz").alias("timestamp_archivo"), dedup.file_prefix(F.col("archivo")).alias("prefijo"), "n")


@query(f"""SELECT supermarket, sku, listing_id, price_num FROM {LISTINGS} QUALIFY row_number() OVER (PARTITION BY supermarket, sku ORDER BY extracted_at DESC NULLS LAST, listing_id DESC) = 1""")
def d2_keep_last(spark, sf_dir):
    """Each seller's article as last captured."""
    rows = listings(spark, sf_dir).select("supermarket", "sku", "listing_id", "price_num", "extracted_at")
    return dedup.keep_last(rows, ["supermarket", "sku"], ["extracted_at", "listing_id"]).select("supermarket", "sku", "listing_id", "price_num")


@query(f"""SELECT supermarket, sku, listing_id, q AS calidad FROM (SELECT supermarket, sku, listing_id, CASE WHEN length(trim(name)) > 0 THEN 1 ELSE 0 END + CASE WHEN length(trim(brand)) > 0 THEN 1 ELSE 0 END
  + CASE WHEN price_num IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN list_price_num IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN length(trim(detail_url)) > 0 THEN 1 ELSE 0 END + CASE WHEN length(trim(subcategory)) > 0 THEN 1 ELSE 0 END AS q
  FROM {LISTINGS}) QUALIFY row_number() OVER (PARTITION BY supermarket, sku ORDER BY q DESC, listing_id) = 1""")
def d3_keep_best(spark, sf_dir):
    """Each seller's article in its fullest capture (K7 counts what is there)."""
    quality = scores.presence_score(*[F.col(c) for c in ("name", "brand", "price_num", "list_price_num", "detail_url", "subcategory")])
    rows = listings(spark, sf_dir).withColumn("calidad", quality).select("supermarket", "sku", "listing_id", "calidad")
    return dedup.keep_best(rows, ["supermarket", "sku"], F.col("calidad"), ["listing_id"])


@query(f"""SELECT url, min(listing_id) AS listing_id FROM (SELECT regexp_replace(regexp_replace(trim(detail_url), '[?#].*$', ''), '/+$', '') AS url, listing_id FROM {LISTINGS} WHERE detail_url IS NOT NULL) GROUP BY url""")
def d4_keep_first_url(spark, sf_dir):
    """The first listing of each address."""
    rows = listings(spark, sf_dir).where("detail_url is not null").select(text.normal_url(F.col("detail_url")).alias("url"), "listing_id")
    return dedup.keep_first(rows, ["url"], ["listing_id"])


@query("""SELECT status, count(*) AS corridas, round(sum(duration_sec), 2) AS segundos, max(duration_sec) AS mas_larga FROM runs_summary GROUP BY status""")
def s25_run_summary(spark, sf_dir):
    """Runs by status."""
    return dedup.run_summary(table(spark, sf_dir, "runs_summary"))


@query("""SELECT cba_item_id, string_agg(x, '|' ORDER BY i) AS partes, count(*) AS n FROM (SELECT cba_item_id, trim(x) AS x, i FROM (SELECT cba_item_id, unnest(str_split(alias, ';')) AS x, generate_subscripts(str_split(alias, ';'), 1) AS i FROM cba_items WHERE alias IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY cba_item_id, trim(x) ORDER BY i) = 1) WHERE x <> '' GROUP BY cba_item_id""")
def d5_split_lines(spark, sf_dir):
    """The distinct parts of a list typed into one field."""
    parts = table(spark, sf_dir, "cba_items").where("alias is not null").select("cba_item_id", dedup.split_lines(F.col("alias")).alias("xs"))
    return parts.where(F.size("xs") > 0).select("cba_item_id", F.array_join("xs", "|").alias("partes"), F.size("xs").cast("bigint").alias("n"))


@query("""SELECT fuente, count(*) AS n, count(estado) AS con_estado, count(producto_buscado) AS con_producto FROM (SELECT 'cobertura' AS fuente, estado, NULL AS producto_buscado FROM cba_cobertura
  UNION ALL SELECT 'carrito', NULL, producto_buscado FROM carrito_resumen_ejecutivo) GROUP BY fuente""")
def d1_union_by_name(spark, sf_dir):
    """Two tables of differing columns as one."""
    a = table(spark, sf_dir, "cba_cobertura").select(F.lit("cobertura").alias("fuente"), "estado")
    b = table(spark, sf_dir, "carrito_resumen_ejecutivo").select(F.lit("carrito").alias("fuente"), "producto_buscado")
    return dedup.union_all(a, b).groupBy("fuente").agg(F.count("*").alias("n"), F.count("estado").alias("con_estado"), F.count("producto_buscado").alias("con_producto"))


# text, numbers, units


@query(r"""SELECT cba_item_id, trim(regexp_replace(regexp_replace(strip_accents(lower(cba_name)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS limpio,
  trim(regexp_replace(strip_accents(lower(cba_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, strip_accents(cba_name) AS sin_acentos FROM cba_items""")
def c1_clean_text(spark, sf_dir):
    """Names folded, cleaned and as slugs."""
    name = F.col("cba_name")
    return table(spark, sf_dir, "cba_items").select("cba_item_id", text.clean_text(name).alias("limpio"), text.slug(name).alias("slug"), text.fold_accents(name).alias("sin_acentos"))


@query(r"""WITH w AS (SELECT p_partkey, list_filter(str_split(trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS ws, lower(p_brand) AS b FROM part)
  SELECT p_partkey, array_to_string(ws[1:3], ' ') AS firma, substr(trim(regexp_replace(regexp_replace(b, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), 1, 4) AS marca4 FROM w""")
def c8_signatures(spark, sf_dir):
    """Signature of the name and prefix of the brand."""
    return table(spark, sf_dir, "part").select("p_partkey", text.name_signature(F.concat_ws(" ", "p_name", "p_brand")).alias("firma"), text.brand_prefix(F.col("p_brand")).alias("marca4"))


@query(f"""SELECT listing_id, regexp_replace(regexp_replace(trim(detail_url), '[?#].*$', ''), '/+$', '') AS url, split_part(regexp_replace(regexp_replace(trim(detail_url), '[?#].*$', ''), '/+$', ''), '/', -1) AS ultimo,
  coalesce(nullif(regexp_extract(detail_url, '/p/(\\d+)', 1), ''), nullif(regexp_extract(detail_url, '[?&]sku=(\\w+)', 1), ''), nullif(regexp_extract(detail_url, '/(\\d{{5,}})(?:[/?#]|$)', 1), ''), nullif(regexp_extract(detail_url, '-(\\d{{5,}})(?:[/?#]|$)', 1), ''), 'hash_' || substr(md5(detail_url), 1, 16)) AS id
  FROM {LISTINGS} WHERE detail_url IS NOT NULL""")
def c11_addresses(spark, sf_dir):
    """Normal address, its last part and the article number in it, by any of the patterns, or a hash."""
    url = F.col("detail_url")
    return listings(spark, sf_dir).where(url.isNotNull()).select("listing_id", text.normal_url(url).alias("url"), text.last_path_part(url).alias("ultimo"), text.stable_id(url).alias("id"))


@query("""SELECT o_orderkey, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS punto_decimal, CASE WHEN printf('%.2f', o_totalprice) LIKE '%.00' THEN o_totalprice ELSE CAST(replace(printf('%.2f', o_totalprice), '.', '') AS DOUBLE) END AS punto_miles, CAST(replace(printf('%.2f', o_totalprice), '.', '') AS BIGINT) AS digitos,
  CAST(o_totalprice AS DOUBLE) AS chileno, replace(printf('%.2f%%', floor(o_totalprice) / 100), '.', ',') AS porcentaje FROM orders""")
def c13_prices_in_text(spark, sf_dir):
    """Prices read out of texts by either rule."""
    plain = F.format_string("%.2f", "o_totalprice")
    chilean = F.translate(F.format_string("%,.2f", F.col("o_totalprice")), ",.", ".,")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.price_dot_decimal(F.concat(F.lit("$ "), plain)).alias("punto_decimal"), numbers.price_dot_thousands(F.concat(F.lit("$"), plain)).alias("punto_miles"), numbers.digits_only(plain).alias("digitos"),
        numbers.number_cl(chilean).alias("chileno"), numbers.percent_text(F.floor("o_totalprice") / 100).alias("porcentaje"),
    )


_STD = "CASE WHEN unit IN ('kg', 'l') THEN amount * 1000 ELSE amount END"
_FAMILY = "CASE WHEN unit IN ('kg', 'g') THEN 'mass' WHEN unit IN ('l', 'ml', 'cc') THEN 'volume' WHEN unit = 'un' THEN 'unit' END"


@query(f"""WITH @offers, s AS (SELECT *, {_STD} AS size_std, {_FAMILY} AS unit_family FROM offers) SELECT idx, size_std, unit_family,
  CASE WHEN size_std <= 50 THEN '0_50' WHEN size_std <= 100 THEN '51_100' WHEN size_std <= 250 THEN '101_250' WHEN size_std <= 500 THEN '251_500' WHEN size_std <= 1000 THEN '501_1000' WHEN size_std <= 2000 THEN '1001_2000' ELSE '2000_plus' END AS bucket,
  price / size_std AS precio_unidad, list_price AS precio_efectivo, size_std AS size_en_texto FROM s""")
def u1_units(spark, sf_dir):
    """Family, size in common units, bucket, unit price; the size read out of the name is the same."""
    o = sized(offers(spark, sf_dir))
    found = units.size_in_text(text.clean_text(F.col("name"), keep=".,"))
    return o.select("idx", "size_std", "unit_family", units.size_bucket(F.col("size_std")).alias("bucket"), units.price_per_unit(F.col("price"), F.col("size_std")).alias("precio_unidad"),
                    units.effective_price(F.col("list_price"), F.col("price")).alias("precio_efectivo"), found["size"].alias("size_en_texto"))


def sized(o: DataFrame) -> DataFrame:
    return o.withColumns({"size_std": units.to_standard(F.col("amount"), F.col("unit")), "unit_family": units.unit_family(F.col("unit"))})


@query("""SELECT cba_item_id, daily_qty * 30 AS cantidad_mes, CASE WHEN daily_qty * 30 > 0 THEN 2.5 * (daily_qty * 30) ELSE 990 END AS costo FROM cba_items""")
def u10_item_cost(spark, sf_dir):
    """Monthly quantity and cost of each item at a given unit price."""
    month = units.month_quantity(F.col("daily_qty"))
    return table(spark, sf_dir, "cba_items").select("cba_item_id", month.alias("cantidad_mes"), units.item_cost(F.lit(2.5), month, F.lit(990.0)).alias("costo"))


# searches, rules, matching


@query("""WITH @offers SELECT sku, supermarket, name, price FROM offers WHERE contains(lower(name), 'red') AND contains(lower(name), 'widget')""")
def f9_search(spark, sf_dir):
    """Offers in which every word of a search occurs."""
    return serving.search(offers(spark, sf_dir), "red widget", ["name", "brand"]).select("sku", "supermarket", "name", "price")


@query("""SELECT cba_item_id, cba_name FROM cba_items WHERE contains(strip_accents(lower(cba_name || ' ' || coalesce(alias, ''))), 'azucar') OR contains(strip_accents(lower(cba_name || ' ' || coalesce(alias, ''))), 'cana')""")
def f10_search_folded(spark, sf_dir):
    """Two searches without accents."""
    hay = F.concat_ws(" ", "cba_name", "alias")
    return table(spark, sf_dir, "cba_items").where(text.matches_search(hay, F.lit("azúcar"), True) | text.matches_search(hay, F.lit("de CAÑA"), True)).select("cba_item_id", "cba_name")


@query("""WITH @offers SELECT supermarket, sku, price, CAST(puesto AS INTEGER) AS puesto FROM (SELECT *, row_number() OVER (PARTITION BY supermarket ORDER BY price, name, sku) AS puesto FROM offers WHERE contains(lower(name), 'bolt')) WHERE puesto <= 5""")
def o6_compare_markets(spark, sf_dir):
    """The five cheapest hits of each market."""
    return serving.compare(offers(spark, sf_dir), "bolt", ["name"], 5).select("supermarket", "sku", "price", "puesto")


# Rules of the example queries.
_RULES = [
    ("pernos rojos", ["bolt"], ["red"], ["brand 1"], None, None, None),
    ("azules por kilo", [], ["blue"], [], "mass", 5000.0, 40000.0),
    ("engranajes chicos", ["gear", "widget"], [], ["green"], "unit", None, 10.0),
    ("nada", ["inexistente"], [], [], None, None, None),
]


@query(rf"""WITH @offers, s AS (SELECT *, {_STD} AS size_std, {_FAMILY} AS unit_family, ' ' || trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS t FROM offers),
  m AS (SELECT 'pernos rojos' AS rule, idx FROM s WHERE contains(t, ' bolt ') AND contains(t, ' red ') AND NOT contains(t, ' brand 1 ')
  UNION ALL SELECT 'azules por kilo', idx FROM s WHERE contains(t, ' blue ') AND unit_family = 'mass' AND size_std BETWEEN 5000 AND 40000
  UNION ALL SELECT 'engranajes chicos', idx FROM s WHERE (contains(t, ' gear ') OR contains(t, ' widget ')) AND NOT contains(t, ' green ') AND unit_family = 'unit' AND size_std <= 10)
  SELECT r.rule, m.idx FROM (VALUES ('pernos rojos'), ('azules por kilo'), ('engranajes chicos'), ('nada')) r(rule) LEFT JOIN m ON r.rule = m.rule""")
def j3_rules_with_missing(spark, sf_dir):
    """Offers that meet a rule of words, family and size; a rule without offers has a null one."""
    listed = spark.createDataFrame(_RULES, rules.RULE_SCHEMA)
    products = sized(offers(spark, sf_dir)).withColumn("clean", text.clean_text(F.col("name"))).select("idx", "clean", "unit_family", "size_std")
    return rules.with_missing(listed, rules.match_rules(products, listed, "clean", "unit_family", "size_std")).select("rule", "idx")


# Wanted items of the example cart.
_CART = [("red bolt 10 kg", ["red", "bolt"], "mass", 10000.0), ("blue widget 5 l", ["blue", "widget"], "volume", 5000.0), ("green gear", ["green", "gear"], None, None)]
_SCORE = """3 * h + 2 * h + 5 * h / 2 + CASE WHEN unit_family = family THEN 2 ELSE 0 END + CASE WHEN size_std > 0 AND wanted > 0 THEN greatest(0, 4 - 4 * abs(size_std - wanted) / greatest(wanted, 1)) ELSE 0 END"""


@query(rf"""WITH @offers, s AS (SELECT *, {_STD} AS size_std, {_FAMILY} AS unit_family, ' ' || trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS t FROM offers WHERE price > 100 AND price < 500000),
  c AS (SELECT * FROM (VALUES ('red bolt 10 kg', 'red', 'bolt', 'mass', 10000.0), ('blue widget 5 l', 'blue', 'widget', 'volume', 5000.0), ('green gear', 'green', 'gear', NULL, NULL)) v(item, a, b, family, wanted)),
  x AS (SELECT item, idx, supermarket, price, CAST(contains(t, ' ' || a || ' ') AS INTEGER) + CAST(contains(t, ' ' || b || ' ') AS INTEGER) AS h, unit_family, family, size_std, wanted FROM s JOIN c ON contains(t, ' ' || a || ' ') OR contains(t, ' ' || b || ' '))
  SELECT item, supermarket, CAST(puesto AS INTEGER) AS puesto, idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item, supermarket ORDER BY score DESC, price, idx) AS puesto FROM (SELECT *, {_SCORE} AS score FROM x)) WHERE puesto <= 5""")
def k4_cart_candidates(spark, sf_dir):
    """The five best offers of each market for each item of a cart."""
    wanted = spark.createDataFrame(_CART, "item string, tokens array<string>, family string, wanted double").withColumn("lead", F.explode("tokens"))
    o = sized(offers(spark, sf_dir)).where("price > 100 and price < 500000").withColumn("clean", text.clean_text(F.col("name")))
    met = o.withColumn("lead", F.explode(F.array_distinct(text.words(F.col("clean"))))).join(F.broadcast(wanted), "lead").where(rules.first_met(F.col("clean"), F.col("tokens"), F.col("lead")))
    score = scores.cart_score(F.col("tokens"), F.col("clean"), F.col("clean"), F.lit(""), F.lit(""), F.coalesce(F.col("unit_family") == F.col("family"), F.lit(False)), F.col("size_std"), F.col("wanted"), F.array().cast("array<string>"))
    scored = met.withColumn("score", score).where("score > 0")
    return ranking.top_per_group(scored, ["item", "supermarket"], [F.desc("score"), F.col("price"), F.col("idx")], 5).select("item", "supermarket", "puesto", "idx", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT p_partkey, replace(lower(p_brand), '#', ' ') AS x FROM part), p AS (SELECT a.p_partkey, a.x AS a, b.x AS b FROM c a JOIN c b ON b.p_partkey = a.p_partkey + 1)
  SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE len(list_intersect(str_split(a, ' '), str_split(b, ' '))) / len(list_distinct(list_concat(str_split(a, ' '), str_split(b, ' ')))) END, 6) AS parecido FROM p""")
def k1_brand_scores(spark, sf_dir):
    """Likeness of each part's brand to that of the next."""
    brands = table(spark, sf_dir, "part").select("p_partkey", text.clean_text(F.col("p_brand")).alias("a"))
    after = brands.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return brands.join(after, "p_partkey").select("p_partkey", F.round(scores.brand_score(F.col("a"), F.col("b")), 6).alias("parecido"))


_PREP = rf"""@offers, s AS (SELECT *, {_STD} AS size_std, {_FAMILY} AS unit_family, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS clean,
    trim(regexp_replace(regexp_replace(lower(brand), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cb FROM offers),
  p0 AS (SELECT *, array_to_string((list_filter(str_split(clean, ' '), lambda x: length(x) >= 3))[1:3], ' ') AS sig,
    CASE WHEN size_std <= 50 THEN 1 WHEN size_std <= 100 THEN 2 WHEN size_std <= 250 THEN 3 WHEN size_std <= 500 THEN 4 WHEN size_std <= 1000 THEN 5 WHEN size_std <= 2000 THEN 6 ELSE 7 END AS bucket FROM s),
  p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY category_std, unit_family, bucket, sig) > 300 THEN substr(cb, 1, 4) END AS split FROM p0),
  k AS (SELECT *, dense_rank() OVER (ORDER BY category_std, unit_family, bucket, sig, split) AS block FROM p),
  n AS (SELECT block, count(*) AS n FROM k GROUP BY block HAVING count(*) > 1 AND min(supermarket) <> max(supermarket)),
  t AS (SELECT k.block, n.n, idx, supermarket, list_filter(str_split(clean, ' '), lambda x: length(x) >= 2) AS w FROM k JOIN n ON k.block = n.block),
  g AS (SELECT block, n, idx, supermarket, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS gram FROM t),
  tf AS (SELECT block, n, idx, supermarket, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT block, gram, count(*) AS df FROM tf GROUP BY ALL),
  w AS (SELECT tf.block, tf.gram, idx, supermarket, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.block = df.block AND tf.gram = df.gram WHERE df <= 0.95 * n),
  u AS (SELECT block, gram, idx, supermarket, w / sqrt(sum(w * w) OVER (PARTITION BY block, idx)) AS w FROM w),
  sim AS (SELECT a.idx AS idx_1, b.idx AS idx_2, sum(a.w * b.w) AS text_similarity FROM u a JOIN u b ON a.block = b.block AND a.gram = b.gram AND a.idx < b.idx AND a.supermarket <> b.supermarket GROUP BY ALL),
  e AS (SELECT idx_1, idx_2, x.supermarket AS supermarket_1, y.supermarket AS supermarket_2, text_similarity, CASE WHEN x.cb = y.cb THEN 1.0 WHEN contains(x.cb, y.cb) OR contains(y.cb, x.cb) THEN 0.9
    ELSE len(list_intersect(str_split(x.cb, ' '), str_split(y.cb, ' '))) / len(list_distinct(list_concat(str_split(x.cb, ' '), str_split(y.cb, ' ')))) END AS brand_score
    FROM sim JOIN k x ON x.idx = idx_1 JOIN k y ON y.idx = idx_2 WHERE text_similarity >= 0.6 AND abs(x.size_std - y.size_std) / greatest(x.size_std, y.size_std) <= 0.08),
  edges AS (SELECT idx_1, idx_2, supermarket_1, supermarket_2, round(text_similarity, 4) AS text_similarity, round(brand_score, 4) AS brand_score, round(0.75 * text_similarity + 0.25 * brand_score, 4) AS final_score FROM e WHERE 0.75 * text_similarity + 0.25 * brand_score >= 0.75)"""


def prepared(spark: SparkSession, sf_dir: str, priced: bool = True) -> DataFrame:
    return matching.prepare(sized(offers(spark, sf_dir)).select("idx", "supermarket", "name", "brand", "category_std", "unit_family", "size_std", *["price"] * priced))


@query(f"WITH {_PREP} SELECT * FROM edges")
def j1_match_edges(spark, sf_dir):
    """Matching offers of different markets by TF-IDF within blocks, size and brand."""
    return matching.match_offers(prepared(spark, sf_dir, priced=False))


_EDGES = """reach(x, y) AS (SELECT a, b FROM arcs UNION SELECT r.x, c.b FROM reach r JOIN arcs c ON c.a = r.y),
  comp AS (SELECT x AS idx, least(x, min(y)) AS component FROM reach GROUP BY x)"""
_COMPONENTS = f"WITH RECURSIVE {_PREP}, arcs(a, b) AS (SELECT idx_1, idx_2 FROM edges UNION SELECT idx_2, idx_1 FROM edges), {_EDGES}"


@query(f"{_COMPONENTS} SELECT idx, component FROM comp")
def g1_components(spark, sf_dir):
    """Components of the match graph."""
    return matching.match_components(prepared(spark, sf_dir))


@query(f"""{_COMPONENTS}, gr AS (SELECT o.*, dense_rank() OVER (ORDER BY component) AS group_id FROM s o JOIN comp ON comp.idx = o.idx)
  SELECT group_id, first(name ORDER BY price, idx) AS producto_referencia, first(brand ORDER BY price, idx) AS marca_referencia, first(supermarket ORDER BY price, idx) AS supermercado_mas_barato, min(price) AS precio_mas_barato,
  count(*) AS cantidad_opciones_comparadas, string_agg(DISTINCT supermarket, ', ' ORDER BY supermarket) AS supermercados_presentes FROM gr WHERE price IS NOT NULL GROUP BY group_id HAVING count(DISTINCT supermarket) > 1""")
def a10_group_prices(spark, sf_dir):
    """Price comparison of the groups of matching offers (G2, G3, W4)."""
    return matching.compare_prices(matching.match_groups(prepared(spark, sf_dir)))


# sources


@query()
def s12_payload_products(spark, sf_dir):
    """Product lists out of captured payloads."""
    return extract_products(table(spark, sf_dir, "bff_calefacci_n"), "payload_id", "payload")


@query("""SELECT anexo_fila_id, unidad, cantidad_dia, calorias_dia, valor_mensual FROM cba_anexo1_diciembre2025 WHERE alimento IS NOT NULL AND trim(alimento) <> '' AND unidad IN ('G', 'CC', 'UN') AND cantidad_dia IS NOT NULL AND calorias_dia IS NOT NULL AND valor_mensual IS NOT NULL""")
def s11_parse_rows(spark, sf_dir):
    """Rows of a printed table read back into typed columns."""
    full = table(spark, sf_dir, "cba_anexo1_diciembre2025").where("alimento is not null and trim(alimento) <> '' and unidad in ('G', 'CC', 'UN') and cantidad_dia is not null and calorias_dia is not null and valor_mensual is not null")
    printed = F.concat_ws(" ", F.regexp_replace(F.trim("alimento"), r"\s+", " "), "unidad", *[F.replace(F.col(c).cast("decimal(18,4)").cast("string"), F.lit("."), F.lit(",")) for c in ("cantidad_dia", "calorias_dia", "valor_mensual")])
    parsed = parse_rows(full.select("anexo_fila_id", printed.alias("row")))
    return parsed.select("anexo_fila_id", "unidad", "cantidad_dia", "calorias_dia", "valor_mensual")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 0.9) AS BIGINT) AS price, CAST(floor(l_extendedprice) AS BIGINT) AS list_price FROM lineitem""")
def s15_card_prices(spark, sf_dir):
    """Least and greatest amount in the text of a product card."""
    low, high = F.floor(F.col("l_extendedprice") * 0.9), F.floor("l_extendedprice")
    card = F.concat(F.lit("Oferta $ "), F.replace(F.format_number(high, 0), F.lit(","), F.lit(".")), F.lit(" ahora $"), low.cast("string"), F.lit(" c/u"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", card_prices(card).alias("x")).select("l_orderkey", "l_linenumber", "x.price", "x.list_price")


@query(f"""SELECT supermarket, count(*) AS n, count(name) AS con_nombre, count(last_category) AS con_categoria, count(category_std) AS con_estandar, count(price) AS con_precio FROM (SELECT supermarket, name, last_category, NULL AS category_std, NULL AS price FROM {LISTINGS}) GROUP BY supermarket""")
def proj5_standard_relation(spark, sf_dir):
    """Listings in the 26 columns of the standard relation; what they lack is null."""
    rows = listings(spark, sf_dir).withColumnRenamed("last_category", "subcat_name").drop("category_std")
    standard = to_schema(rows, PRODUCT, RENAMES["jumbo"])
    return standard.groupBy("supermarket").agg(*[F.count("*").alias("n")], *[F.count(c).alias(a) for c, a in (("name", "con_nombre"), ("last_category", "con_categoria"), ("category_std", "con_estandar"), ("price", "con_precio"))])


# carts and winners


_LINES = f"""lines AS (SELECT cba_name, supermarket, name, brand, detail_url, price_num, premium_score AS score, listing_id FROM {LISTINGS} WHERE cba_name IS NOT NULL AND supermarket IS NOT NULL AND price_num IS NOT NULL AND NOT isnan(price_num)
  QUALIFY row_number() OVER (PARTITION BY cba_name, supermarket ORDER BY price_num, listing_id) = 1),
  low AS (SELECT *, coalesce(nullif(score, 'NaN'::DOUBLE), '-inf'::DOUBLE) AS q FROM lines)"""


@query(f"""WITH {_LINES}, l AS (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY cba_name ORDER BY price_num, q DESC, listing_id) = 1), h AS (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY cba_name ORDER BY price_num DESC, q DESC, listing_id) = 1),
  c AS (SELECT cba_name, count(DISTINCT supermarket) AS n, min(price_num) FILTER (WHERE supermarket = 'jumbo') AS j, min(price_num) FILTER (WHERE supermarket = 'lider') AS i, min(price_num) FILTER (WHERE supermarket = 'unimarc') AS u FROM low GROUP BY cba_name)
  SELECT l.cba_name AS producto_buscado, c.n AS supermercados_encontrados, l.supermarket AS supermercado_mas_conveniente, l.name AS producto_mas_conveniente, l.brand AS marca_mas_conveniente, l.price_num AS precio_mas_bajo, h.supermarket AS supermercado_mas_caro,
  h.name AS producto_mas_caro, h.brand AS marca_mas_caro, h.price_num AS precio_mas_alto, h.price_num - l.price_num AS ahorro_abs, CASE WHEN h.price_num > 0 THEN round_even((h.price_num - l.price_num) / h.price_num * 100, 2) END AS ahorro_pct_vs_mas_caro,
  c.j AS precio_jumbo, c.i AS precio_lider, c.u AS precio_unimarc, l.detail_url AS url_mas_conveniente, h.detail_url AS url_mas_caro FROM l JOIN h ON l.cba_name = h.cba_name JOIN c ON c.cba_name = l.cba_name""")
def j5_cart_summary(spark, sf_dir):
    """Winner, dearest market and every chain's price of each item, in the cart summary's 17 columns."""
    rows = listings(spark, sf_dir).where("price_num is not null and not isnan(price_num)").withColumn("score", F.nanvl("premium_score", F.lit(None).cast("double")))
    rows = rows.select("cba_name", "supermarket", "name", "brand", "detail_url", "price_num", "score", "listing_id")
    best_of_market = basket.best_offers(rows, "cba_name", "supermarket", "price_num", "listing_id")
    return basket.cart_summary(best_of_market, "cba_name", "supermarket", "price_num", "score", "listing_id", MARKETS)


@query(f"""SELECT cba_name, supermarket, listing_id, premium_score, price_num FROM {LISTINGS} WHERE cba_name IS NOT NULL AND premium_score IS NOT NULL AND NOT isnan(premium_score)
  QUALIFY row_number() OVER (PARTITION BY cba_name ORDER BY premium_score DESC, price_num ASC NULLS LAST, listing_id) = 1""")
def o3_premium_winner(spark, sf_dir):
    """The listing of each item with the highest score; the price only tells equal scores apart."""
    rows = listings(spark, sf_dir).where("premium_score is not null and not isnan(premium_score)").select("cba_name", "supermarket", "listing_id", "premium_score", "price_num")
    return ranking.coherent_rows(rows, ["cba_name"], [("premium_score", True), ("price_num", False), ("listing_id", False)])


@query(f"""SELECT cba_name, supermarket, listing_id, price_num FROM {LISTINGS} WHERE cba_name IS NOT NULL AND price_num IS NOT NULL AND NOT isnan(price_num)
  QUALIFY row_number() OVER (PARTITION BY cba_name ORDER BY price_num DESC, coalesce(nullif(premium_score, 'NaN'::DOUBLE), '-inf'::DOUBLE) DESC, listing_id) = 1""")
def o4_dearest_offer(spark, sf_dir):
    """The dearest listing of each item, the better score first among equal prices."""
    rows = listings(spark, sf_dir).where("price_num is not null and not isnan(price_num)").withColumn("q", F.nanvl("premium_score", F.lit(None).cast("double")))
    return ranking.coherent_rows(rows.select("cba_name", "supermarket", "listing_id", "price_num", "q"), ["cba_name"], [("price_num", True), ("q", True), ("listing_id", False)]).drop("q")


# Odd inputs, and what the rules make of them.
_ODD_SIZES = [
    ("Pack 6 un 1,5 L", 1500.0, "volume", 1500.0, "volume"), ("Harina 1 kilo", 1000.0, "mass", None, None), ("Pan", None, None, None, None), ("Leche 1 L", 1000.0, "volume", 1000.0, "volume"), ("Pan x 6", None, None, 6.0, "unit"),
    ("Agua 2 lts", 2000.0, "volume", None, None), ("Huevos 12 unidades", 12.0, "unit", 12.0, "unit"), ("500 g y 2 kg", 2000.0, "mass", 500.0, "mass"), ("Bebida 350ml x 6", 350.0, "volume", 350.0, "volume"), ("", None, None, None, None), (None, None, None, None, None),
    ("Té 20un 40 gr", 40.0, "mass", 40.0, "mass"), ("1.5 l", 1500.0, "volume", 1500.0, "volume"), ("3 unid", None, None, None, None), ("2 kgs", None, None, None, None),
]


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"


_ODD_SQL = ", ".join(f"({i}, {', '.join(map(_literal, row[1:]))})" for i, row in enumerate(_ODD_SIZES))


@query(f"SELECT CAST(n AS BIGINT) AS n, CAST(a AS DOUBLE) AS ultimo, CAST(b AS VARCHAR) AS ultimo_familia, CAST(c AS DOUBLE) AS primero, CAST(d AS VARCHAR) AS primero_familia FROM (VALUES {_ODD_SQL}) v(n, a, b, c, d)")
def u4_sizes_in_text(spark, sf_dir):
    """Sizes in odd texts by both rules: the last amount with a unit, and the first that a pattern finds."""
    given = spark.createDataFrame([(i, row[0]) for i, row in enumerate(_ODD_SIZES)], "n bigint, name string")
    cleaned = text.clean_text(F.col("name"), keep=".,")
    last, first = units.size_in_text(cleaned), units.size_by_pattern(cleaned)
    return given.select("n", last["size"].alias("ultimo"), last["family"].alias("ultimo_familia"), first["size"].alias("primero"), first["family"].alias("primero_familia"))


@query(f"""WITH u AS (SELECT listing_id, lower(trim(unit)) AS u, size_std AS v FROM {LISTINGS}) SELECT listing_id, CASE WHEN u IN ('kg', 'g', 'gr') THEN 'mass' WHEN u IN ('l', 'lt', 'ml', 'cc') THEN 'volume' WHEN u IN ('un', 'unidad', 'unidades') THEN 'unit' END AS familia,
  CASE WHEN u IN ('kg', 'l', 'lt') THEN v * 1000 WHEN u IN ('g', 'gr', 'ml', 'cc', 'un', 'unidad', 'unidades') THEN v END AS std FROM u""")
def u2_listing_units(spark, sf_dir):
    """Family and size in common units of every listing by the fixed spellings, dirt and all."""
    unit = F.col("unit")
    return listings(spark, sf_dir).select("listing_id", units.unit_family(unit).alias("familia"), units.to_standard(F.col("size_std"), unit).alias("std"))


@query(r"""WITH c AS (SELECT cba_item_id, trim(regexp_replace(regexp_replace(strip_accents(lower(cba_name)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM cba_items),
  w AS (SELECT *, list_filter(str_split(x, ' '), lambda y: length(y) >= 4 AND y NOT IN ('de', 'del', 'la', 'las', 'el', 'los', 'y')) AS ws FROM c) SELECT cba_item_id, CASE WHEN len(ws) > 0 THEN array_to_string(ws[1:4], '|') ELSE x END AS palabras FROM w""")
def f3_name_patterns(spark, sf_dir):
    """The words that stand for each item of the basket list."""
    return table(spark, sf_dir, "cba_items").select("cba_item_id", F.array_join(text.name_patterns(text.clean_text(F.col("cba_name"))), "|").alias("palabras"))
