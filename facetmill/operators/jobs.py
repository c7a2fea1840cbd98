"""Batch jobs: spreadsheet rows to records, imports against stored records, replay of snapshots, rule overlays."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gazetteer as g
from ..functions.classify import cohort
from ..functions.gazetteer import Gazetteer
from ..functions.text import clean_value, labelled, normalize_name
from .extract import Extractor
from . import resolve
from .resolve import CORE, FIELDS, finalize, import_report, normalize_city, normalize_province
from .tables import stable_ids, upsert


def regions(text: Column, gazetteer: Gazetteer | None = None) -> Column:
    """struct(province, city) that a text names."""
    known = gazetteer or Gazetteer()

    @F.pandas_udf("province string, city string")
    def find(texts: pd.Series) -> pd.DataFrame:
        extractor = Extractor(known)
        return pd.DataFrame([extractor.region(t or "") for t in texts], columns=["province", "city"])

    return find(text)


def build_records(rows: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Normalised records of spreadsheet rows (FIELDS as text and source_row); rows without a name go.

    A missing province or city is inferred from organisation, city, province and position. A
    municipality is both.
    """
    value = {f: clean_value(F.col(f)) for f in ("college", "major", "destination_org", "city", "province", "position", "degree", "note", "cohort")}
    out = rows.withColumn("_name", normalize_name(F.col("name"))).filter(F.col("_name").isNotNull() & (F.col("_name") != ""))
    out = out.select("source_row", F.col("_name").alias("name"), *[c.alias(f) for f, c in value.items()])
    province, city = normalize_province(F.col("province")), normalize_city(F.col("city"))
    out = out.withColumns({"_province": province, "_city": city}).withColumn("_found", regions(F.concat_ws(" ", "destination_org", "_city", "_province", "position"), gazetteer))
    out = out.withColumns({"_province": F.coalesce("_province", normalize_province(F.col("_found.province"))), "_city": F.coalesce("_city", normalize_city(F.col("_found.city")))})
    single = list(g.MUNICIPALITIES)
    out = out.withColumns({"_city": F.coalesce("_city", F.when(F.col("_province").isin(single), F.col("_province"))), "_province": F.coalesce("_province", F.when(F.col("_city").isin(single), F.col("_city")))})
    year = cohort(F.coalesce("cohort", F.lit("")))
    out = out.withColumns({"province": F.col("_province"), "city": F.col("_city"), "cohort_year": year["year"], "cohort": year["cohort"]})
    return out.select("source_row", *FIELDS)


def described(records: DataFrame, source_name: str) -> DataFrame:
    """With field count, raw text and evidence; ``records`` has FIELDS and source_rows."""
    filled = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in CORE), F.lit(0))
    rows = F.array_join(F.transform("source_rows", lambda x: x.cast("string")), "、")
    return records.withColumns({"field_count": filled.cast("int"), "raw_text": labelled([(label, F.col(c)) for label, c in g.RECORD_LABELS]), "evidence": F.concat(F.lit(f"手工整理自《{source_name}》第 "), rows, F.lit(" 行"))})


@dataclass
class Import:
    """What an import would store: all records of its source, the decisions, and their counts."""

    records: DataFrame
    decisions: DataFrame
    report: DataFrame


def import_rows(rows: DataFrame, stored: DataFrame, image: str, source_name: str, gazetteer: Gazetteer | None = None) -> Import:
    """Resolves the rows of one file against stored records of other sources. Nothing is written: a dry run is the same call.

    ``stored`` has FIELDS, id and image; a repeated import replaces the source's own records, so it
    is compared with the others only.
    """
    decisions = resolve.resolve(build_records(rows, gazetteer), stored.filter(F.col("image") != image))
    return Import(described(finalize(decisions, image), source_name), decisions, import_report(decisions))


def store(stored: DataFrame, done: Import) -> DataFrame:
    """Stored records with the import's source replaced."""
    return upsert(stored, done.records.select("image", "block_index", *FIELDS, "field_count", "confidence", "raw_text", "evidence"), ["image"])


def prune_orphans(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """Without records of manual sources that aren't in ``sources`` (image) any more."""
    gone = stored.filter(F.startswith("image", F.lit("manual:"))).select("image").distinct().join(sources.select("image").distinct(), "image", "left_anti")
    return stored.join(gone, "image", "left_anti")


def replay(stored: DataFrame, snapshots: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Stored records after replaying snapshots in the order of ``source_file`` (of ``image`` without that column).

    Manual sources become what their snapshots hold, without records that duplicate a stored one, one
    of a source replayed before or an earlier one of the same source; nothing is merged. ``block_index``
    counts a source's kept records from 0.
    """
    rest = stored.filter(~F.startswith("image", F.lit("manual:")))
    kept = snapshots if keep_duplicates else without_duplicates(snapshots, rest)
    number = F.row_number().over(Window.partitionBy("image").orderBy("block_index")) - 1
    return rest.unionByName(kept.withColumn("block_index", number.cast(snapshots.schema["block_index"].dataType)).drop("source_file"), allowMissingColumns=True)


def without_duplicates(snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshot records that duplicate neither ``stored`` nor one kept before, in the order of sources and of their records."""
    source = "source_file" if "source_file" in snapshots.columns else "image"
    types = {f: "int" if f == "cohort_year" else "string" for f in FIELDS}
    fields = lambda d: [(F.col(f) if f in d.columns else F.lit(None)).cast(t).alias(f) for f, t in types.items()]
    # The number of a record is its place among all, in the order in which they are replayed.
    numbered = stable_ids(snapshots, [source, "image", "block_index"], "_at")
    new = numbered.select(F.col("_at").alias("at"), *fields(snapshots))
    kept = resolve.without_duplicates(new, stored.select("id", *fields(stored)), ["at"])
    return numbered.join(kept.withColumnRenamed("at", "_at"), "_at", "left_semi").select(*snapshots.columns)


def override_records(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields set by rules (ord, image, name or block_index, field, value); of several for a field the last decides.

    A rule by name is held against the extracted name, also where another rule changes it.
    """
    fields = [f for f in FIELDS if f in records.columns]
    hit = records.select("image", "block_index", "name").join(rules.withColumnsRenamed({"name": "rule_name", "block_index": "rule_index"}), "image")
    hit = hit.filter(F.coalesce(F.col("rule_name") == F.col("name"), F.lit(False)) | F.coalesce(F.col("rule_index") == F.col("block_index"), F.lit(False)))
    last = hit.groupBy("image", "block_index").agg(*[F.max_by(F.when(F.col("field") == f, F.struct(F.col("value").alias("v"))), F.when(F.col("field") == f, F.col("ord"))).alias(f"_{f}") for f in fields])
    out = records.join(last, ["image", "block_index"], "left")
    return out.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").cast(records.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else c for c in records.columns])


def unknown_rule_images(rules: DataFrame, images: DataFrame) -> DataFrame:
    return rules.select("image").filter("image IS NOT NULL").distinct().join(images.select("image").distinct(), "image", "left_anti")
