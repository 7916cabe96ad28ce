"""Sections of descriptions: which are present, changed or unchanged in a sample, what is in them, and drawing samples by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators import sampling as X
from stayline.operators.common import cut_lineage
from stayline.operators.visits import ADM, ED, ICU

#: Sections by name: the part of the visit, the section and the category that belong to it. Fixed values.
SECTIONS = {
    "ED_Stay": [(ED, None, None)],
    "HS_General__HA_PatientLocation__HA_CareTaker": [(ADM, "General", None), (ADM, "Patient Location", None), (ADM, "Care Taker", None)],
    "HS_OutpatientMeasurements": [(ADM, "Outpatient Measurements", None)],
    "HS_LabResults": [(ADM, "Lab Results", None)],
    "HS_RadiologyNotes": [(ADM, "Radiology Notes", None)],
    "HS_Prescriptions": [(ADM, "Prescriptions", None)],
    "HS_Procedures": [(ADM, "Procedures", None)],
    "HS_Microbiology": [(ADM, "Microbiology Growth Results", None)],
    "ICU_Medication": [(ICU, "Medication", None)],
    "ICU_Output": [(ICU, "Output", None)],
    "ICU_Procedures": [(ICU, "Procedures", None)],
    "ICU_CE_VitalSigns": [(ICU, "Chart Events", "RoutineVitalSigns")],
    "ICU_CE_AdmHistory": [(ICU, "Chart Events", "AdmHistory_FHPA")],
    "ICU_CE_MDProgressNote": [(ICU, "Chart Events", "MDProgressNote")],
    "ICU_CE_Respiratory": [(ICU, "Chart Events", "Respiratory")],
    "ICU_CE_Pulmonary": [(ICU, "Chart Events", "Pulmonary")],
    "ICU_CE_SkinAssessment": [(ICU, "Chart Events", "Skin-Assessment")],
    "ICU_CE_SkinImpairment": [(ICU, "Chart Events", "Skin-Impairment")],
    "ICU_CE_SkinIncisions": [(ICU, "Chart Events", "Skin-Incisions")],
    "ICU_CE_CardioPulses": [(ICU, "Chart Events", "Cardiovascular(Pulses)")],
    "ICU_CE_Neurological": [(ICU, "Chart Events", "Neurological")],
    "ICU_CE_Hemodynamics": [(ICU, "Chart Events", "Hemodynamics")],
    "ICU_CE_Alarms": [(ICU, "Chart Events", "Alarms")],
    "ICU_CE_PainSedation": [(ICU, "Chart Events", "Pain_Sedation")],
    "ICU_CE_GIGU": [(ICU, "Chart Events", "GI_GU")],
    "ICU_CE_Cardio": [(ICU, "Chart Events", "Cardiovascular")],
    "ICU_CE_CardioPacerData": [(ICU, "Chart Events", "Cardiovascular(PacerData)")],
    "ICU_CE_IABP": [(ICU, "Chart Events", "IABP")],
    "ICU_CE_Dialysis": [(ICU, "Chart Events", "Dialysis")],
    "ICU_CE_Toxicology": [(ICU, "Chart Events", "Toxicology")],
    "ICU_CE_NICOM": [(ICU, "Chart Events", "NICOM")],
}
#: Sections that don't change over a visit: one sample of each is enough. Fixed values.
STATIC = ("HS_General__HA_PatientLocation__HA_CareTaker", "HS_OutpatientMeasurements", "HS_RadiologyNotes", "ICU_CE_MDProgressNote", "ICU_CE_AdmHistory")


def dimension(spark: SparkSession, sections: dict = SECTIONS) -> DataFrame:
    """``section_name, part, section, category``: a null stands for all."""
    return spark.createDataFrame([(n, *x) for n, xs in sections.items() for x in xs], "section_name string, part string, section string, category string")


def tagged(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with the section they belong to and their ICU stay (empty for the other parts): adds ``section_name, sub``. Facts of no section fall out."""
    in_icu = F.get("path", F.lit(0)) == ICU
    f = facts.withColumn("part", F.get("path", F.lit(0))).withColumn("sub", F.when(in_icu, F.get("path", F.lit(1))).otherwise(F.lit("")))
    f = f.withColumn("__s", F.get("path", F.when(in_icu, 2).otherwise(1))).withColumn("__c", F.get("path", F.when(in_icu, 3).otherwise(2)))
    d = F.broadcast(dim.withColumnRenamed("section", "__ds").withColumnRenamed("category", "__dc"))
    hit = (f["part"] == d["part"]) & (F.col("__ds").isNull() | (F.col("__ds") == F.col("__s"))) & (F.col("__dc").isNull() | (F.col("__dc") == F.col("__c")))
    return f.join(d, hit).select("visit", "timepoint", "sub", "section_name", "path", "value")


def section_index(described: DataFrame, changes: DataFrame, dim: DataFrame) -> DataFrame:
    """Which samples hold which section: ``section_name, visit, sub, timepoint, state``.

    ``state``: ``changed`` if the next hour's changes touch it, else ``empty``; static sections appear once per visit, at their first point, as ``static``. Sections
    without content aren't listed. Everything is grouped by keys, so that what is kept once per visit is so over all tasks.
    """
    key = ["section_name", "visit", "sub", "timepoint"]
    there = tagged(described, dim).select(*key).distinct()
    moved = tagged(changes, dim).select(*key).distinct().withColumn("__m", F.lit(True))
    static = F.col("section_name").isin(*STATIC)
    once = there.where(static).groupBy("section_name", "visit").agg(F.min(F.struct("timepoint", "sub")).alias("x")).select("section_name", "visit", "x.sub", "x.timepoint", F.lit("static").alias("state"))
    rest = there.where(~static).join(moved, key, "left").select(*key, F.when(F.col("__m"), "changed").otherwise("empty").alias("state"))
    return rest.unionByName(once)


def section_content(described: DataFrame, changes: DataFrame, index: DataFrame, dim: DataFrame) -> DataFrame:
    """Per indexed section its facts before and after: ``section_name, visit, sub, timepoint, desc, change``; of static ones only the description."""
    key = ["section_name", "visit", "sub", "timepoint"]
    fold = lambda df, name: tagged(df, dim).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias(name))
    j = index.join(fold(described, "desc"), key, "left").join(fold(changes, "change"), key, "left")
    return j.select(*key, "desc", F.when(F.col("state") != "static", F.coalesce("change", F.expr("CAST(ARRAY() AS ARRAY<STRUCT<path: ARRAY<STRING>, value: STRING>>)"))).alias("change"))


def sections_of_samples(index: DataFrame) -> DataFrame:
    """The other way round: per sample the list of its sections with their ICU stay: ``visit, timepoint, sections``."""
    return index.groupBy("visit", "timepoint").agg(F.array_sort(F.collect_set(F.struct("section_name", "sub"))).alias("sections"))


def draw_sections(index: DataFrame, k: int, seed: str, extra: float = 0.1) -> DataFrame:
    """``k`` draws, with repetition, of indexed samples: a section with probability by ln(its samples), then one of its samples evenly; beside that, without
    repetition, of each section's unchanged samples a tenth as many as it was drawn: ``section_name, visit, sub, timepoint, draw`` (null for these extras).

    A draw by weight ln(n) / n over all rows is the same as the two steps, so no section is numbered through.
    """
    row = index.withColumn("__key", F.concat_ws("|", "section_name", "visit", "sub", F.col("timepoint").cast("string")))
    full = row.where("state <> 'empty'")
    n = full.groupBy("section_name").agg(F.count(F.lit(1)).alias("__n"))
    weighted = full.join(F.broadcast(n), "section_name").withColumn("__w", F.log("__n") / F.col("__n"))
    drawn = cut_lineage(X.weighted_with_replacement(weighted, "__key", "__w", k, seed).join(row, "__key").select("section_name", "visit", "sub", "timepoint", "draw"))
    want = drawn.groupBy("section_name").agg(F.floor(F.count(F.lit(1)) * extra).alias("__k"))
    more = X.take(row.where("state = 'empty'"), "section_name", ["__key"], f"{seed}|empty", want).select("section_name", "visit", "sub", "timepoint", F.lit(None).cast("bigint").alias("draw"))
    return drawn.unionByName(more)
