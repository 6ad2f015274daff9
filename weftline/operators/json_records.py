"""Records from model output: an array, a repaired array, or single objects salvaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import between_brackets, repair_quotes
from weftline.model import CHUNK_JSON, REQUIRED


def objects(text: Column) -> Column:
    """All flat {...} stretches of a text."""
    return F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1)


def _complete(records: Column, required: tuple[str, ...]) -> Column:
    def whole(r: Column) -> Column:
        ok = r.isNotNull()
        for name in required:
            ok = ok & r[name].isNotNull()
        return ok

    return F.filter(records, whole)


def parse_records(raw: Column, schema: str = CHUNK_JSON, required: tuple[str, ...] = REQUIRED) -> Column:
    """Array of records, null if nothing can be read; an empty array stays empty.

    A whole array counts if every record has its required fields; else it is tried with inner quotes escaped; else its
    objects are read one by one and the complete ones kept.
    """
    body = between_brackets(raw)

    def whole(text: Column) -> Column:
        got = F.from_json(text, f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in schema.split(', ')))}>>")
        return F.when(F.size(_complete(got, required)) == F.size(got), got)

    single = F.transform(objects(repair_quotes(body)), lambda o: F.from_json(o, schema))
    saved = _complete(single, required)
    return F.when(body == "", None).otherwise(F.coalesce(whole(body), whole(repair_quotes(body)), F.when(F.size(saved) > 0, saved)))


def explode_records(x: DataFrame, raw: str = "raw") -> DataFrame:
    """One row a record, with its place in the answer."""
    keys = [c for c in x.columns if c != raw]
    return x.select(*keys, F.posexplode(parse_records(F.col(raw))).alias("pos", "r")).select(*keys, "pos", "r.*")
