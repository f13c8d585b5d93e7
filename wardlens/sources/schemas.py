"""Declared layouts. Raw tables are all text; types are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Column names of the three raw tables, in file order.
GENERAL_COLUMNS = (
    "facility_id", "facility_name", "address", "city_town", "state", "zip_code", "county_parish", "phone_number",
    "hospital_type", "hospital_ownership", "emergency_services", "birthing_friendly",
    "overall_rating", "overall_rating_footnote",
    "mort_group_measure_count", "count_facility_mort_measures", "count_mort_measures_better",
    "count_mort_measures_no_different", "count_mort_measures_worse", "mort_group_footnote",
    "safety_group_measure_count", "count_facility_safety_measures", "count_safety_measures_better",
    "count_safety_measures_no_different", "count_safety_measures_worse", "safety_group_footnote",
    "readm_group_measure_count", "count_facility_readm_measures", "count_readm_measures_better",
    "count_readm_measures_no_different", "count_readm_measures_worse", "readm_group_footnote",
    "pt_exp_group_measure_count", "count_facility_pt_exp_measures", "pt_exp_group_footnote",
    "te_group_measure_count", "count_facility_te_measures", "te_group_footnote",
)
TIMELY_COLUMNS = (
    "facility_id", "facility_name", "address", "city_town", "state", "zip_code", "county_parish", "phone_number",
    "condition_name", "measure_id", "measure_name", "score", "sample_size", "footnote", "start_date", "end_date",
)
SURVEY_COLUMNS = (
    "facility_id", "facility_name", "address", "city_town", "state", "zip_code", "county_parish", "phone_number",
    "hcahps_measure_id", "hcahps_question", "hcahps_answer_description",
    "patient_survey_star_rating", "patient_survey_star_rating_footnote",
    "hcahps_answer_percent", "hcahps_answer_percent_footnote", "hcahps_linear_mean_value",
    "number_of_completed_surveys", "number_of_completed_surveys_footnote",
    "survey_response_rate_percent", "survey_response_rate_percent_footnote", "start_date", "end_date",
)

# Column headings of the published files behind each field, first match wins.
GENERAL_FIELDS = {
    "facility_id": ("Facility ID",),
    "facility_name": ("Facility Name",),
    "state": ("State",),
    "county_parish": ("County/Parish", "County Name"),
    "hospital_type": ("Hospital Type",),
    "hospital_ownership": ("Hospital Ownership",),
    "emergency_services": ("Emergency Services",),
    "overall_rating": ("Hospital overall rating",),
    "count_mort_measures_worse": ("Count of MORT Measures Worse",),
    "count_safety_measures_worse": ("Count of Safety Measures Worse",),
    "count_readm_measures_worse": ("Count of READM Measures Worse",),
}
SURVEY_FIELDS = {
    "facility_id": ("Facility ID",),
    "patient_survey_star_rating": ("Patient Survey Star Rating",),
    "survey_response_rate_percent": ("Survey Response Rate Percent",),
    "number_of_completed_surveys": ("Number of Completed Surveys",),
}
TIMELY_FIELDS = {"facility_id": ("Facility ID",), "score": ("Score",)}

# Names of the published files, lower-cased.
RELEASE_FILES = {
    "general": "hospital_general_information.csv",
    "timely": "timely_and_effective_care-hospital.csv",
    "survey": "hcahps-hospital.csv",
}
RELEASE_FIELDS = {"general": GENERAL_FIELDS, "timely": TIMELY_FIELDS, "survey": SURVEY_FIELDS}
PREBUILT_FILE = "hospital_features.csv"


def text_schema(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


GENERAL = text_schema(GENERAL_COLUMNS)
TIMELY = text_schema(TIMELY_COLUMNS)
SURVEY = text_schema(SURVEY_COLUMNS)

FEATURES = StructType(
    [StructField(c, StringType()) for c in
     ("facility_id", "facility_name", "state", "county", "hospital_type", "hospital_ownership")]
    + [StructField("emergency_services", IntegerType())]
    + [StructField(c, DoubleType()) for c in
       ("overall_rating", "_mort_worse", "_safety_worse", "_readm_worse", "patient_star_avg",
        "survey_response_rate", "completed_surveys", "timely_care_avg", "composite_risk_score")]
    + [StructField("is_underperformer", IntegerType())]
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
