"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.decontaminate import op2_decontaminate
from quillon.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from quillon.llm.html_extract import op1_html_extract
from quillon.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from quillon.llm.language_id import op10_language_id
from quillon.llm.license_scan import op8_license_scan
from quillon.llm.personal_data import op7_personal_data
from quillon.llm.piece_codec import op9_piece_codec
from quillon.llm.secret_scan import op6_secret_scan
from quillon.llm.token_store import op5_token_store

ALL = (op1_html_extract, op2_decontaminate, op3_jaccard_join, op4_exact_dedup, op5_token_store, op6_secret_scan, op7_personal_data, op8_license_scan, op9_piece_codec, op10_language_id)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op4_exact_dedup": OP4_SQL}
