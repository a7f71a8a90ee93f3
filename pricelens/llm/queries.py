"""Queries of this folder's operators and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm.canonical_names import map_to_list
from pricelens.llm.encoding_repair import find_damaged
from pricelens.llm.mixing import mix_sources, share_report, target_entropy_of
from pricelens.llm.packing import fill_report, pack_documents
from pricelens.llm.same_product import product_pairs
from pricelens.llm.sentences import split_sentences
from pricelens.llm.top_items import top_n
from pricelens.session import table

LISTINGS = "cba_premium_mejor_por_supermercado"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of the same product."""
    return product_pairs(table(spark, sf_dir, LISTINGS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrongly decoded names and subcategories of the listings and names of the annex."""
    listings = find_damaged(table(spark, sf_dir, LISTINGS), LISTINGS, "listing_id", ["name", "subcategory"])
    annex = "cba_anexo1_diciembre2025"
    return listings.unionByName(find_damaged(table(spark, sf_dir, annex), annex, "anexo_fila_id", ["alimento"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names of the coverage sheets and carts with the basket item that they mean."""
    items = table(spark, sf_dir, "cba_items")
    typed = {"cba_cobertura": ("cobertura_id", "cba_name"), "carrito_resumen_ejecutivo": ("carrito_fila_id", "producto_buscado")}
    parts = [map_to_list(table(spark, sf_dir, t), t, key, value, items, "cba_item_id", "cba_name", "alias") for t, (key, value) in typed.items()]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best listings of each basket item and seller."""
    return top_n(table(spark, sf_dir, LISTINGS), ["cba_name", "supermarket"], "premium_score", [("price_num", False)], "listing_id", n=3)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every document for every kind of container."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "contenedores"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p8_containers(spark, sf_dir), table(spark, sf_dir, "contenedores"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their repetitions and the shares reached."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mezcla_objetivos"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return share_report(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mezcla_objetivos"))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture whose sources weigh their natural share to an exponent: the shares' entropy is that of the target shares."""
    targets = table(spark, sf_dir, "mezcla_objetivos")
    return mix_sources(table(spark, sf_dir, "documents"), targets, target_entropy=target_entropy_of(targets))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents."""
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_tempered": p9_tempered, "p10_found": p10_found}

ORACLES = {
    "p5_found": """
        SELECT cba_name, supermarket, CAST(puesto AS INTEGER) AS puesto, listing_id FROM (
          SELECT cba_name, supermarket, listing_id, row_number() OVER (
            PARTITION BY cba_name, supermarket
            ORDER BY premium_score DESC, CASE WHEN isnan(price_num) THEN NULL ELSE price_num END ASC NULLS LAST, listing_id ASC) AS puesto
          FROM cba_premium_mejor_por_supermercado
          WHERE cba_name IS NOT NULL AND supermarket IS NOT NULL AND premium_score IS NOT NULL AND NOT isnan(premium_score))
        WHERE puesto <= 3""",
}
