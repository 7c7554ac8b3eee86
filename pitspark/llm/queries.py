"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitspark.llm import codebooks, decontam, disclosure, exact, language, nearmatch, packing, periodic, quality, substrings, toxicity, urlrules, vectortree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_substrings": substrings.query,
    "op3_near_dedup": nearmatch.query,
    "op4_exact_dedup": exact.query,
    "op5_url_rules": urlrules.query,
    "op6_toxicity": toxicity.query,
    "op7_decontamination": decontam.query,
    "op8_quality": quality.query,
    "op9_disclosure": disclosure.query,
    "op10_language": language.query,
    "op11_periodic_runs": periodic.query,
    "op12_nearest": vectortree.query,
    "op13_codebooks": codebooks.query,
}

ORACLES: dict[str, str] = {
    "op3_near_dedup": nearmatch.ORACLE,
    "op4_exact_dedup": exact.ORACLE,
    "op5_url_rules": urlrules.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op13_codebooks": codebooks.ORACLE,
}
