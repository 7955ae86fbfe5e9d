"""The queries of the training-data operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bwt import op5_bwt
from .decontaminate import op3_decontaminate
from .manifest import OP12_SQL, op12_manifest
from .merkle import op1_merkle
from .mixing import op8_mixing
from .neighbours import op13_neighbours
from .quality import op10_quality
from .runs import op11_runs
from .secrets import OP2_SQL, op2_secrets
from .sharding import op4_sharding
from .simhash import op7_simhash
from .suffix_tree import OP6_SQL, op6_suffix_tree
from .warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle": op1_merkle,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_bwt": op5_bwt,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_runs": op11_runs,
    "op12_manifest": op12_manifest,
    "op13_neighbours": op13_neighbours,
}
SQL: dict[str, str] = {
    "op2_secrets": OP2_SQL,
    "op6_suffix_tree": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op12_manifest": OP12_SQL,
}
