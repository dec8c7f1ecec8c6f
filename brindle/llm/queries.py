"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import divergence, html, idfile, langid, merkle, minhash, mixing, packing, pairwise, quality, toxicity, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": html.op1,
    "op7_warc": warc.op7,
    "op2_quality": quality.op2,
    "op3_langid": langid.op3,
    "op5_merkle": merkle.op5,
    "op4_mixing": mixing.op4,
    "op6_minhash": minhash.op6,
    "op8_idfile": idfile.op8,
    "op9_packing": packing.op9,
    "op10_toxicity": toxicity.op10,
    "op11_divergence": divergence.op11,
    "op12_trie": trie.op12,
    "op13_pairwise": pairwise.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc.ORACLE,
    "op2_quality": quality.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_trie": trie.ORACLE,
}
