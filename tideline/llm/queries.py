"""The driver's queries of this subpackage: op1 to op10, each over its whole table, and the pipeline."""

from __future__ import annotations

from importlib import import_module

#: By number: the query's name, its module and the tables that it reads.
OPERATORS = {
    1: ("decontamination", "decontam", ("documents", "benchmark")),
    2: ("language_id", "langid", ("documents",)),
    3: ("substring_dedup", "substrings", ("documents",)),
    4: ("simhash", "simhash", ("documents",)),
    5: ("suffix_array_dedup", "suffixes", ("documents",)),
    6: ("sharding", "sharding", ("documents",)),
    7: ("warc", "warc", ("pages",)),
    8: ("mixing", "mixing", ("documents", "labels")),
    9: ("quality_rules", "rules", ("documents",)),
    10: ("line_quality", "linecrf", ("documents", "labels")),
}


def _query(module: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        return import_module(f"{__package__}.{module}").query(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

    return run


def queries() -> dict:
    import corpus_pipeline

    return {f"op{n}_{name}": _query(module, tables) for n, (name, module, tables) in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {f"op{n}_{name}": getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for n, (name, module, _) in OPERATORS.items()}
    found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v for k, v in found.items() if v}
