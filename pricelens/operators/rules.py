"""Rules of words against names: a rule is a row (rule, any_of, all_of, none_of, family, least, most).

A rule and a product only meet if the product has one of the rule's first words, so that the theta condition is checked
on the outcome of an equi-join on words; the list of rules is short and goes to every worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import contains_all, contains_all_words, contains_any, contains_any_word, contains_word, words

RULE_SCHEMA = "rule string, any_of array<string>, all_of array<string>, none_of array<string>, family string, least double, most double"
#: More rules than this aren't a rule list.
MOST_RULES = 100_000


def rule_holds(text: Column, whole_words: bool = True) -> Column:
    """any_of (unless empty), all_of and not none_of, by whole words or by substrings."""
    some, every = (contains_any_word, contains_all_words) if whole_words else (contains_any, contains_all)
    return ((F.size("any_of") == 0) | some(text, F.col("any_of"))) & every(text, F.col("all_of")) & ~some(text, F.col("none_of"))


def size_allowed(family: Column, size: Column) -> Column:
    """The rule's family must be met where it names one; its bounds count only for a known size."""
    right = F.col("rule_family").isNull() | (family == F.col("rule_family"))
    inside = size.isNull() | (((size >= F.col("least")) | F.col("least").isNull()) & ((size <= F.col("most")) | F.col("most").isNull()))
    return F.coalesce(right & inside, F.lit(False))


def first_met(text: Column, leads: Column, lead: Column) -> Column:
    """The lead is the first of its list that the text has: each pair then meets once, without a distinct."""
    return F.try_element_at(F.filter(leads, lambda w: contains_word(text, w)), F.lit(1)) == lead


def match_rules(products: DataFrame, rules: DataFrame, text: str, family: str, size: str) -> DataFrame:
    """Every (rule, product) that meet; ``text`` is a cleaned text. A product with null text meets none.

    A phrase of any_of (or all_of, where any_of is empty) is found by its first word.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError("too many rules")
    named = rules.withColumnRenamed("family", "rule_family")
    phrases = F.when(F.size("any_of") > 0, F.col("any_of")).otherwise(F.slice("all_of", 1, 1))
    keyed = named.withColumn("leads", F.array_distinct(F.transform(phrases, lambda p: F.split(p, " ")[0]))).withColumn("lead", F.explode("leads"))
    spread = products.withColumn("lead", F.explode(F.array_distinct(words(F.col(text)))))
    met = spread.join(F.broadcast(keyed), "lead").where(first_met(F.col(text), F.col("leads"), F.col("lead")))
    met = met.where(rule_holds(F.col(text)) & size_allowed(F.col(family), F.col(size)))
    return met.drop("lead", "leads", "any_of", "all_of", "none_of", "rule_family", "least", "most")


def with_missing(rules: DataFrame, met: DataFrame) -> DataFrame:
    """The matches and a row with null product columns for each rule without any."""
    return rules.select("rule").join(met, "rule", "left")
