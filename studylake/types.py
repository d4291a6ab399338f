"""Value types, seed rows and the schemas of the catalog tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

INTEGER, FLOAT, STRING, DATE, DATETIME, TIME, CATEGORY, MULTIRESPONSE = range(1, 9)

# The eight value types and their schema names.
VALUE_TYPES = [
    (INTEGER, "xsd:integer", "integer"),
    (FLOAT, "xsd:float", "float"),
    (STRING, "xsd:string", "string"),
    (DATE, "xsd:date", "ISO Date yyyy-mm-dd"),
    (DATETIME, "xsd:dateTime", "ISO Datetime yyyy-mm-ddTHH:mm:ss.sss"),
    (TIME, "xsd:time", "ISO Time HH:mm:ss.sss"),
    (CATEGORY, "enumeration", "Category represented by a Vocabulary with integer value and string code, stored as Integer"),
    (MULTIRESPONSE, "multiresponse", "Multi-response enumeration with multiple values, stored as an array of integers"),
]

# Study type ids (9 is unused), names, descriptions, and the ontology class each stands for.
STUDY_TYPES = [
    (1, "HDSS", "Health and Demographic Surveillance System", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "population_surveillance"),
    (2, "COHORT", "Cohort Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "cohort_study"),
    (3, "SURVEY", "Cross-sectional Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "cross_sectional_study"),
    (4, "PANEL", "Longitudinal/Panel Survey", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "panel_study"),
    (5, "CASE_CONTROL", "Case-Control Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "case_control_design"),
    (6, "RCT", "Randomized Controlled Trial", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "randomized_controlled_trial"),
    (7, "QUASI_EXPERIMENTAL", "Quasi-experimental Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "quasi_experimental_design"),
    (8, "NATURAL_EXPERIMENT", "Natural Experiment", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "natural_experiment"),
    (10, "LAB_EXPERIMENT", "Laboratory Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "laboratory_study"),
    (11, "QUALITATIVE_INTERVIEW", "In-depth or Key Informant Interviews", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "interview_study"),
    (12, "FOCUS_GROUP", "Focus Group Discussion", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "focus_group"),
    (13, "ETHNOGRAPHY", "Ethnographic Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "ethnographic_study"),
    (14, "PARTICIPATORY", "Participatory Action Research", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "community_based_participatory_study"),
    (15, "CASE_STUDY", "Case Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "case_study"),
    (16, "MIXED_METHODS", "Mixed Methods Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "mixed_method_evaluation"),
    (17, "SECONDARY_ANALYSIS", "Secondary Data Analysis", "http://purl.bioontology.org/ontology/MESH", "D000094422"),
    (18, "DESK_REVIEW", "Desk or Literature Review", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "literature_review"),
    (19, "TIME_MOTION", "Time and Motion Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "time_and_motion_study"),
    (20, "DIARY", "Diary Study", "http://purl.bioontology.org/ontology/CSP", "4009-0001"),
    (21, "LONGITUDINAL_OBSERVATION", "Longitudinal Observational Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "longitudinal_study"),
    (22, "SIMULATION", "Simulation Study", "http://edamontology.org", "data_3869"),
    (23, "AGENT_BASED_MODEL", "Agent-based Modelling", "https://i2insights.org/index/integration-and-implementation-sciences-vocabulary", "agent-based-modelling"),
    (24, "STATISTICAL_MODEL", "Statistical Modelling", "http://edamontology.org", "operation_3664"),
    (25, "SYSTEM_DYNAMICS", "Biological system modelling", "http://edamontology.org", "topic_3075"),
    (26, "GENOMICS", "Genomics Study", "http://ontologies.dbmi.pitt.edu/edda/StudyDesigns.owl", "genetic_study"),
    (27, "MULTIOMICS", "Multi-omics Study (e.g., proteomics, metabolomics)", "http://purl.bioontology.org/ontology/MESH", "D000095028"),
    (28, "BIOBANK", "Biobank-based Study", "http://purl.obolibrary.org/obo", "OBIB_0000616"),
    (29, "PHARMACOGENOMICS", "Pharmacogenomics Study", "http://edamontology.org", "topic_0208"),
]

# Text validation keys and their date/time formats.
VALUE_FORMATS = {
    "date_mdy": "%m/%d/%Y",
    "date_dmy": "%d/%m/%Y",
    "date_ymd": "%Y-%m-%d",
    "datetime_mdy": "%m/%d/%Y %H:%M",
    "datetime_dmy": "%d/%m/%Y %H:%M",
    "datetime_ymd": "%Y-%m-%d %H:%M",
    "datetime_seconds_mdy": "%m/%d/%Y %H:%M:%S",
    "datetime_seconds_dmy": "%d/%m/%Y %H:%M:%S",
    "datetime_seconds_ymd": "%Y-%m-%d %H:%M:%S",
    "time_mm_ss": "%M:%S",
    "time": "%H:%M",
    "time_hh_mm_ss": "%H:%M:%S",
}

# What a transformation may be, what an asset may be, the part of a variable in a key, how a rule compares.
TRANSFORMATION_TYPES = ("ingest", "transform", "entity", "export", "repository")
ASSET_TYPES = ("dataset", "file")
KEY_ROLES = ("none", "record", "external")
MAPPING_OPERATORS = ("eq", "gt", "ge", "lt", "le", "ne", "contains", "between", "map")


class Variable(NamedTuple):
    """What a typed projection needs to know about one column."""

    name: str
    value_type_id: int
    value_format: str | None = None


EAV_SCHEMA = "record STRING, field_name STRING, value STRING"

DICTIONARY_SCHEMA = (
    "field_name STRING, form_name STRING, field_type STRING, "
    "text_validation_type_or_show_slider_number STRING, "
    "select_choices_or_calculations STRING, field_label STRING, field_note STRING"
)

ITEMS_TYPE = "array<struct<value:bigint,code:string,description:string>>"

# Catalog tables. Names and keys are the data model; ids are BIGINT surrogates.
CATALOG_SCHEMAS = {
    "domains": "domain_id BIGINT, name STRING, uri STRING, description STRING",
    "studies": "study_id BIGINT, name STRING, description STRING, external_id STRING, study_type_id INT",
    "study_domains": "study_id BIGINT, domain_id BIGINT",
    "study_access": "study_id BIGINT, user_id STRING, access_level STRING",
    "vocabularies": "vocabulary_id BIGINT, domain_id BIGINT, name STRING, description STRING",
    "vocabulary_items": "vocabulary_item_id BIGINT, vocabulary_id BIGINT, value BIGINT, code STRING, description STRING",
    "vocabulary_mapping": "vocabulary_mapping_id BIGINT, from_vocabulary_item BIGINT, to_vocabulary_item BIGINT",
    "variables": (
        "variable_id BIGINT, domain_id BIGINT, name STRING, value_type_id INT, value_format STRING, "
        "vocabulary_id BIGINT, keyrole STRING, description STRING, note STRING, "
        "ontology_namespace STRING, ontology_class STRING"
    ),
    "assets": (
        "asset_id BIGINT, study_id BIGINT, name STRING, description STRING, asset_type STRING, date_created TIMESTAMP, created_by STRING"
    ),
    "asset_versions": (
        "version_id BIGINT, asset_id BIGINT, major INT, minor INT, patch INT, version_note STRING, "
        "doi STRING, is_latest BOOLEAN, created_at TIMESTAMP, created_by STRING, location STRING"
    ),
    "datafiles": "version_id BIGINT, storage_uri STRING, edam_format STRING, digest STRING, compressed BOOLEAN",
    "dataset_variables": "version_id BIGINT, variable_id BIGINT, ordinal INT, keyrole STRING",
    "transformations": (
        "transformation_id BIGINT, transformation_type STRING, description STRING, repository_url STRING, "
        "commit_hash STRING, file_path STRING, date_created TIMESTAMP"
    ),
    "transformation_inputs": "transformation_id BIGINT, version_id BIGINT",
    "transformation_outputs": "transformation_id BIGINT, version_id BIGINT",
    "entities": (
        "entity_id BIGINT, domain_id BIGINT, name STRING, description STRING, "
        "ontology_namespace STRING, ontology_class STRING"
    ),
    "entity_relations": (
        "entity_relation_id BIGINT, subject_entity_id BIGINT, object_entity_id BIGINT, domain_id BIGINT, "
        "name STRING, description STRING, ontology_namespace STRING, ontology_class STRING"
    ),
    "entity_instances": (
        "instance_id BIGINT, entity_id BIGINT, study_id BIGINT, external_id STRING, transformation_id BIGINT"
    ),
    "relation_instances": (
        "relation_instance_id BIGINT, entity_relation_id BIGINT, entity_instance_id_1 BIGINT, entity_instance_id_2 BIGINT, "
        "valid_from DATE, valid_to DATE, external_id STRING, transformation_id BIGINT"
    ),
    "data_asset_entities": "asset_id BIGINT, entity_instance_id BIGINT",
    "variable_mapping": (
        "mapping_id BIGINT, from_variable_id BIGINT, to_variable_id BIGINT, operator STRING, operants STRING, prerequisite_id BIGINT"
    ),
}


def lake_type(value_type_id: int) -> T.DataType:
    """Column type of a value type in a stored dataset."""
    return {
        INTEGER: T.IntegerType(),
        FLOAT: T.DoubleType(),
        DATE: T.DateType(),
        DATETIME: T.TimestampNTZType(),
        CATEGORY: T.IntegerType(),
    }.get(value_type_id, T.StringType())


def value_type_of(data_type: T.DataType) -> int:
    """Value type of a Spark column type."""
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return INTEGER
    if isinstance(data_type, T.FractionalType):
        return FLOAT
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.TimeType):
        return TIME
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.IntegralType):
        return MULTIRESPONSE
    return STRING
