"""Whole jobs: they write real files and read them back."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from studylake.operators.reconcile import assert_same_rows
from studylake.plans import jobs
from studylake.plans.store import StudyLake
from studylake.sources import files, readers, writers
from studylake.streaming.arrivals import collect_exports, collected_exports, first_lines
from studylake.types import CATEGORY, DATETIME, FLOAT, INTEGER, STRING, Variable

DICTIONARY = [
    {"field_name": "record_id", "form_name": "base", "field_type": "text", "field_label": "Id"},
    {"field_name": "age", "form_name": "base", "field_type": "text", "text_validation_type_or_show_slider_number": "integer", "field_label": "<b>Age</b>&nbsp;now"},
    {"field_name": "sex", "form_name": "base", "field_type": "radio", "select_choices_or_calculations": "1, Male | 2, Female", "field_label": "Sex"},
    {"field_name": "signs", "form_name": "exam", "field_type": "checkbox", "select_choices_or_calculations": "1, Fever | 2, Cough", "field_label": "Signs"},
    {"field_name": "seen", "form_name": "exam", "field_type": "text", "text_validation_type_or_show_slider_number": "date_dmy", "field_label": "Seen"},
    {"field_name": "note", "form_name": "exam", "field_type": "descriptive", "field_label": "Read this"},
    {"field_name": "happy", "form_name": "exam", "field_type": "yesno", "field_label": "Happy?"},
]
EXPORT = 'record,redcap_event,field_name,value\n1,e,age,30\n1,e,sex,2\n1,e,signs,2\n1,e,signs,1\n1,e,seen,3/4/2024\n2,e,age,41\n2,e,sex,unknown\n2,e,extra,"two\nlines, ""quoted"""\n'


@pytest.fixture
def lake(spark, tmp_path):
    lake = StudyLake(spark, str(tmp_path / "lake"))
    jobs.register_study(lake, "My study", 3, ["people", "places"])
    return lake


@pytest.fixture
def described(lake, tmp_path):
    path = tmp_path / "dictionary.json"
    path.write_text(json.dumps(DICTIONARY, indent=1))
    rows = readers.scan_dictionary_json(lake.spark, str(path))
    jobs.register_dictionary(lake, rows, 1, "src")
    return lake


def test_study_and_domains(lake):
    jobs.register_study(lake, "My study", 4, ["people", "things"])
    assert [tuple(r) for r in lake.table("studies").select("study_id", "study_type_id").collect()] == [(1, 4)]
    assert lake.table("domains").count() == 3 and lake.table("study_domains").count() == 3


def test_upserts_of_catalog_tables(lake, frame):
    entities = frame([(1, "person", "A person"), (1, "household", None)], "domain_id bigint, name string, description string")
    ids = {r.name: r.entity_id for r in jobs.upsert(lake, "entities", entities).collect()}
    assert sorted(ids.values()) == [1, 2]
    relation = frame([(1, "lives in", ids["person"], ids["household"])], "domain_id bigint, name string, subject_entity_id bigint, object_entity_id bigint")
    assert jobs.upsert(lake, "entity_relations", relation).first().object_entity_id == ids["household"]
    again = jobs.upsert(lake, "entities", entities.withColumn("description", F.lit("changed")).drop("nothing"))
    assert {(r.name, r.entity_id, r.description) for r in again.collect()} == {(n, i, "changed") for n, i in ids.items()}
    jobs.upsert(lake, "domains", frame([("onto", "http://x")], "name string, uri string"))
    jobs.upsert(lake, "domains", frame([("onto",)], "name string"))
    assert lake.table("domains").where("name = 'onto'").count() == 2
    access = frame([(1, "ann", "read"), (1, "ann", "read")], "study_id bigint, user_id string, access_level string")
    assert jobs.upsert(lake, "study_access", access).count() == 1
    with pytest.raises(ValueError, match="orphan entities.domain_id"):
        jobs.upsert(lake, "entities", frame([(77, "x")], "domain_id bigint, name string"))


def test_register_dictionary(described):
    variables = {r.name: r for r in described.table("variables").collect()}
    assert set(variables) == {"record_id", "age", "sex", "signs", "seen", "happy"}
    assert variables["record_id"].keyrole == "record" and variables["age"].keyrole == "none"
    assert variables["age"].description == "Age now"
    assert variables["seen"].value_format == "%d/%m/%Y"
    names = {r.vocabulary_id: r.name for r in described.table("vocabularies").collect()}
    assert set(names.values()) == {"src.sex", "src.signs", "src.happy"}
    items = sorted((names[r.vocabulary_id], r.value, r.code) for r in described.table("vocabulary_items").collect())
    assert items == [("src.sex", 1, "male"), ("src.sex", 2, "female"), ("src.signs", 1, "fever"), ("src.signs", 2, "cough")]
    assert names[variables["sex"].vocabulary_id] == "src.sex" and variables["age"].vocabulary_id is None


def test_dictionary_forms(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(DICTIONARY))
    rows = readers.scan_dictionary_json(spark, str(path), ["exam"])
    assert [r.field_name for r in rows.orderBy("ord").collect()] == ["signs", "seen", "note", "happy"]


def test_export_to_dataset(described, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "visits_eav.csv").write_text(EXPORT)
    jobs.ingest_files(described, "My study", str(folder))
    with pytest.warns(UserWarning, match="extra"):
        jobs.eav_to_dataset(described, "My study", "visits_eav", multi_line=True)
    location = described.table("asset_versions").where("location LIKE '%visits%' AND location NOT LIKE '%csv'").first().location
    assert [r.field_name for r in described.fields_left_out(location).collect()] == ["extra"]
    stored = described.read_dataset("My study", "visits")
    assert stored.columns == ["record", "age", "seen", "sex", "sex_raw", "signs"]
    assert sorted(tuple(str(v) for v in r) for r in stored.collect()) == [
        ("1", "30", "2024-04-03", "2", "2", "1, 2"), ("2", "41", "None", "None", "unknown", "None"),
    ]
    edges = described.table("transformation_inputs").count(), described.table("transformation_outputs").count()
    assert edges == (1, 2)
    kinds = sorted(r.transformation_type for r in described.table("transformations").collect())
    assert kinds == ["ingest", "transform"]
    assert described.table("dataset_variables").count() == 4


def test_project_in_another_character_set(lake, tmp_path):
    (tmp_path / "dictionary.json").write_text(json.dumps(DICTIONARY))
    folder = tmp_path / "exports"
    folder.mkdir()
    text = EXPORT.replace("unknown", "neznámé").replace("2,e,extra", "2,e,happy")
    (folder / "round_1_eav.csv").write_bytes(text.encode("iso8859-2"))
    manifest = jobs.ingest_project(lake, "My study", 1, str(tmp_path / "dictionary.json"), str(folder), forms=["base", "exam"])
    assert [(r.asset_name, r.major, r.patch) for r in manifest.collect()] == [("round_1_eav", 1, 0)]
    stored = jobs.eav_to_dataset(lake, "My study", "round_1_eav", charset="iso8859-2", multi_line=True).orderBy("record")
    assert [(r.record, r.sex, r.sex_raw) for r in stored.collect()] == [(1, 2, "2"), (2, None, "neznámé")]
    assert "REDCap.sex" in {r.name for r in lake.table("vocabularies").collect()}


def test_query_to_dataset(lake, frame):
    frame([(1, "x", 1.5), (2, None, None)], "id bigint, t string, d double").createOrReplaceTempView("source_rows")
    sql = "SELECT id, t, d, NULL AS nothing FROM source_rows"
    jobs.query_to_dataset(lake, "My study", 1, "copied", sql)
    assert_same_rows(lake.read_dataset("My study", "copied"), lake.spark.sql("SELECT id, t, d, CAST(NULL AS STRING) AS nothing FROM source_rows"))
    assert lake.table("asset_versions").count() == 1
    assert [r.transformation_type for r in lake.table("transformations").collect()] == ["ingest"]
    kinds = {r.name: r.value_type_id for r in lake.table("variables").collect()}
    assert kinds == {"id": INTEGER, "t": STRING, "d": FLOAT, "nothing": STRING}
    with pytest.raises(ValueError, match="exists"):
        jobs.query_to_dataset(lake, "My study", 1, "copied", sql)
    with pytest.raises(ValueError, match="legal"):
        jobs.query_to_dataset(lake, "My study", 1, "not legal", sql)
    jobs.query_to_dataset(lake, "My study", 1, "copied", "SELECT id FROM source_rows", replace=True)
    jobs.query_to_dataset(lake, "My study", 1, "copied", "SELECT t FROM source_rows", replace=True, new_version=(3, 0, 0))
    assert lake.read_dataset("My study", "copied").columns == ["t"]
    assert lake.read_dataset("My study", "copied", (1, 0, 1)).columns == ["id"]
    versions = lake.table("asset_versions").orderBy("version_id").collect()
    assert [(r.major, r.minor, r.patch, r.is_latest) for r in versions] == [(1, 0, 0, False), (1, 0, 1, False), (3, 0, 0, True)]
    for missing in (("Other", "copied", None), ("My study", "nothing", None), ("My study", "copied", (9, 9, 9))):
        with pytest.raises(ValueError):
            lake.read_dataset(*missing)


def test_query_with_vocabularies(lake, frame):
    frame([(1, 1), (2, 2)], "id bigint, cause int").createOrReplaceTempView("cases")
    refined = frame(
        [("cause", CATEGORY, "Cause", "cause_codes", "Code table values from causes", [{"value": 1, "code": "N", "description": "Natural"}])],
        "column_name string, value_type_id int, description string, vocabulary_name string, vocabulary_description string, "
        "items array<struct<value:bigint,code:string,description:string>>",
    )
    jobs.query_to_dataset(lake, "My study", 1, "cases", "SELECT * FROM cases", variables=refined)
    variable = lake.table("variables").where("name = 'cause'").first()
    assert variable.value_type_id == CATEGORY
    assert [tuple(r) for r in lake.table("vocabulary_items").collect()] == [(1, variable.vocabulary_id, 1, "N", "Natural")]


def test_refused_commit_changes_nothing(lake, frame):
    before = lake.locations()
    bad = frame([(1, 1, 1), (2, 1, 99)], "vocabulary_id bigint, x int, domain_id bigint").select(
        "vocabulary_id", "domain_id", F.lit("v").alias("name"), F.lit(None).cast("string").alias("description")
    )
    with pytest.raises(ValueError, match="orphan vocabularies.domain_id"):
        lake.commit({"vocabularies": bad})
    assert lake.locations() == before


def test_failed_job_leaves_the_lake_as_it_was(described, frame):
    rows = frame([("1", "age", "not a number")], "record string, field_name string, value string")
    before = described.locations()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        jobs.eav_to_dataset(described, "My study", "bad_eav", rows=rows)
    assert described.locations() == before
    with pytest.raises(ValueError, match="no dataset"):
        described.read_dataset("My study", "bad")


def test_file_versions(lake, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "table.csv").write_text("a,b\n1,2\n")
    (folder / "read me.txt").write_text("hello")
    jobs.ingest_files(lake, "My study", str(folder))
    (folder / "table.csv").write_text("a,b\n3,4\n")
    (folder / "read me.txt").unlink()
    jobs.ingest_files(lake, "My study", str(folder))
    assets = {r.name: r.asset_id for r in lake.table("assets").collect()}
    assert set(assets) == {"table", "read_me"}
    versions = lake.table("asset_versions").join(lake.table("datafiles"), "version_id").orderBy("asset_id", "patch").collect()
    table = [(r.major, r.minor, r.patch, r.is_latest, r.edam_format) for r in versions if r.asset_id == assets["table"]]
    assert table == [(1, 0, 0, False, "http://edamontology.org/format_3752"), (1, 0, 1, True, "http://edamontology.org/format_3752")]
    newest = [r for r in versions if r.asset_id == assets["table"]][-1]
    assert newest.digest == hashlib.sha256(b"a,b\n3,4\n").hexdigest()


def test_files_of_one_name_get_versions_in_order(lake, tmp_path):
    folder = tmp_path / "several"
    for name in ("a/x.csv", "b/x.csv", "b/x-y.csv", "b/x_y.csv"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(f"{name}\n")
    jobs.ingest_files(lake, "My study", str(folder), description="first")
    found = lake.table("asset_versions").join(lake.table("assets"), "asset_id").orderBy("name", "patch").collect()
    assert [(r.name, r.patch, r.is_latest, r.location.split("/", 3)[-1].rsplit("/", 2)[-2]) for r in found] == [
        ("x", 0, False, "a"), ("x", 1, True, "b"), ("x_y", 0, False, "b"), ("x_y", 1, True, "b"),
    ]
    with pytest.raises(ValueError, match="allow a new version"):
        jobs.ingest_files(lake, "My study", str(folder), new_version=False)
    jobs.ingest_files(lake, "My study", str(folder / "a"), bump="minor", edam_format="http://edamontology.org/format_1915")
    newest = lake.table("asset_versions").where("minor = 1").join(lake.table("datafiles"), "version_id").first()
    assert (newest.major, newest.minor, newest.patch, newest.edam_format) == (1, 1, 0, "http://edamontology.org/format_1915")


def test_code_list_that_became_empty(lake, frame):
    schema = readers.DICTIONARY_SCHEMA
    names = [part.strip().split()[0] for part in schema.split(",")] + ["ord"]

    def described_as(kind, choices):
        row = dict.fromkeys(names) | {"field_name": "sex", "form_name": "base", "field_type": kind, "field_label": "Sex", "ord": 1}
        row[next(n for n in names if n.startswith("select_choices"))] = choices
        return frame([tuple(row[n] for n in names)], schema + ", ord bigint")

    jobs.register_dictionary(lake, described_as("radio", "1, Male | 2, Female"), 1, "src")
    assert lake.table("vocabulary_items").count() == 2
    jobs.register_dictionary(lake, described_as("yesno", None), 1, "src")
    assert lake.table("vocabulary_items").count() == 0


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(bytes(range(256)) * 100)
    (tmp_path / "c.bin").write_bytes(b"")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d +%20é.bin").write_bytes(b"")
    whole = {r.file_name: (r.length, r.digest) for r in files.scan_files(spark, str(tmp_path)).collect()}
    streamed = {r.file_name: (r.length, r.digest) for r in files.scan_files(spark, str(tmp_path), cell_bytes=100).collect()}
    assert whole["c.bin"] == (0, hashlib.sha256(b"").hexdigest()) and set(whole) == {"a b.bin", "c.bin", "d +%20é.bin"}
    assert whole == streamed
    stored = files.scan_files(spark, str(tmp_path)).withColumn("digest", F.upper("digest"))
    assert files.verify_digests(stored, files.scan_files(spark, str(tmp_path))).count() == 0


def test_eav_readers(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(EXPORT)
    rows = {(r.record, r.field_name): r.value for r in readers.scan_eav_csv(spark, str(path)).collect()}
    assert rows[("2", "extra")] == 'two\nlines, "quoted"' and rows[("1", "age")] == "30"
    (tmp_path / "bad.csv").write_text("record,value\n1,2\n")
    with pytest.raises(ValueError, match="field_name"):
        readers.scan_eav_csv(spark, str(tmp_path / "bad.csv"))
    text = "record,field_name,value\n1,név,Łódź žluťoučký kůň őű\n"
    (tmp_path / "l2.csv").write_bytes(text.encode("iso8859-2"))
    assert [tuple(r) for r in readers.scan_eav_transcode(spark, str(tmp_path / "l2.csv")).collect()] == [("1", "név", "Łódź žluťoučký kůň őű")]


def test_files_with_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("record,field_name,value\n1,a,x\n")
    (tmp_path / "2.csv").write_text("record,value,field_name\n2,y,b\n")
    for multi_line in (True, False):
        with pytest.raises(Exception, match="header"):
            readers.scan_eav_csv(spark, str(tmp_path), multi_line).collect()


def test_exports_refuse_to_overwrite(spark, tmp_path):
    rows = spark.range(3).select("id", F.lit("  blanks ").alias("t"), F.lit(None).cast("string").alias("n"), F.lit("").alias("e"))
    for export in (writers.export_csv, writers.export_columnar):
        path = str(tmp_path / export.__name__)
        export(rows, path)
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            export(rows, path)
        export(rows, path, replace=True)
    back = spark.read.schema(rows.schema).options(header=True, escape='"').csv(str(tmp_path / "export_csv"))
    # An empty text and a NULL are the same empty cell.
    assert {tuple(r) for r in back.collect()} == {(i, "  blanks ", None, None) for i in range(3)}


def test_append_matches_columns_by_name(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    frame([(1, "a")], "id bigint, t string").write.parquet(path)
    table = spark.read.parquet(path)
    writers.append_rows(frame([("b", 2)], "t string, id int"), table, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="extra"):
        writers.append_rows(frame([("b", 2, 3)], "t string, id int, extra int"), table, path)


def test_table_schema():
    schema = writers.table_schema([Variable("a", INTEGER), Variable("b", DATETIME), Variable("c", CATEGORY), Variable("d", 6)])
    assert [f.dataType.simpleString() for f in schema.fields] == ["int", "timestamp_ntz", "int", "string"]


def test_category_values(frame):
    df = frame([(1, "low"), (2, "odd")], "id bigint, mood string")
    items = frame([(1, "low"), (2, "high")], "value bigint, code string")
    rows = sorted((r.id, r.mood, r.mood_raw) for r in jobs.category_values(df, "mood", items).collect())
    assert rows == [(1, 1, "low"), (2, None, "odd")]


def test_arriving_exports(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    folder.mkdir()
    (folder / "1.csv").write_text("record,field_name,value\n1,a,x\n")
    collect_exports(spark, str(folder), target, checkpoint).awaitTermination()
    (folder / "2.csv").write_text('record,field_name,value\n2,a,"y\nz"\n')
    collect_exports(spark, str(folder), target, checkpoint).awaitTermination()
    (folder / "3 +a%20.csv").write_text("record,redcap_event_name,field_name,value\n3,base,age,30\n")
    (folder / "4.csv").write_text("value,record,field_name\n31,4,age\n")
    collect_exports(spark, str(folder), target, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in collected_exports(spark, target).collect()) == [
        ("1", "a", "x"), ("2", "a", "y\nz"), ("3", "age", "30"), ("4", "age", "31"),
    ]


def test_first_lines_of_files_in_many_blocks(spark, tmp_path):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"head,{i}\n" + "".join(f"{j},row\n" for j in range(500)))
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "long.csv").write_text("x" * 3000 + "\r\nrow\r\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        found = {r.path.rsplit("/", 1)[1]: r.header for r in first_lines(spark, [str(p) for p in tmp_path.iterdir()]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {"0.csv": "head,0", "1.csv": "head,1", "2.csv": "head,2", "long.csv": "x" * 3000}


def test_query_reader_conforms_to_variables(spark, frame):
    frame([("1", "2.5", "x")], "a string, b string, c string").createOrReplaceTempView("texts")
    result = readers.read_query(spark, "SELECT * FROM texts")
    typed = writers.conform(result, writers.table_schema([Variable("b", FLOAT), Variable("a", INTEGER)]))
    assert typed.columns == ["b", "a"] and tuple(typed.first()) == (2.5, 1)
    assert readers.select_where_eq(result, ["c"], {"a": "1", "b": "2.5"}).count() == 1
    assert readers.select_where_eq(result, []).columns == ["a", "b", "c"]


def test_text_categories_are_stored_as_values(lake, frame):
    frame([(1, "low", "x"), (2, "odd", "y")], "id bigint, mood string, z string").createOrReplaceTempView("moods")
    refined = frame(
        [("mood", CATEGORY, None, "mood_enum", "Enum values for mood", [{"value": 1, "code": "low", "description": None}, {"value": 2, "code": "high", "description": None}])],
        "column_name string, value_type_id int, description string, vocabulary_name string, vocabulary_description string, "
        "items array<struct<value:bigint,code:string,description:string>>",
    )
    stored = jobs.query_to_dataset(lake, "My study", 1, "moods", "SELECT * FROM moods", variables=refined)
    assert stored.columns == ["id", "mood", "mood_raw", "z"]
    assert sorted((r.id, r.mood, r.mood_raw) for r in stored.collect()) == [(1, 1, "low"), (2, None, "odd")]


def test_harmonisation_tables(lake, frame):
    study = lake.study_id("My study")
    jobs.upsert(lake, "entities", frame([(1, "person"), (1, "home")], "domain_id bigint, name string"))
    ids = {r.name: r.entity_id for r in lake.table("entities").collect()}
    lives = frame([(1, "lives in", ids["person"], ids["home"])], "domain_id bigint, name string, subject_entity_id bigint, object_entity_id bigint")
    jobs.upsert(lake, "entity_relations", lives)
    done = lake.table("transformations")
    lake.commit({"transformations": done.unionByName(frame([(1, "entity")], "transformation_id bigint, transformation_type string"), allowMissingColumns=True)})
    rows = frame([(study, "p1", "h1", "2024-01-02"), (study, "p2", "h1", "2024-01-05")], "study_id bigint, person string, home string, day string")
    jobs.record_instances(lake, rows, ids["person"], "study_id", "person", 1)
    jobs.record_instances(lake, rows, ids["home"], "study_id", "home", 1)
    assert jobs.record_instances(lake, rows, ids["person"], "study_id", "person", 1).count() == 3
    relation = lake.table("entity_relations").first().entity_relation_id
    first = jobs.record_relations(lake, rows, relation, "person", "home", "day", 1).collect()
    later = rows.withColumn("day", F.lit("2024-03-01"))
    again = jobs.record_relations(lake, later, relation, "person", "home", "day", 1).collect()
    assert sorted(r.relation_instance_id for r in first) == sorted(r.relation_instance_id for r in again) == [1, 2]
    assert {str(r.valid_to) for r in again} == {"2024-03-01"} and {str(r.valid_from) for r in again} == {"2024-01-02", "2024-01-05"}
    lake.commit({"assets": frame([(5, study, "visits", None, "dataset")], "asset_id bigint, study_id bigint, name string, description string, asset_type string")})
    used = rows.withColumn("asset", F.lit(5).cast("bigint"))
    assert jobs.record_asset_entities(lake, used, "asset", "person", ids["person"]).count() == 2
    jobs.upsert(lake, "variables", frame([(1, "age", 1), (1, "adult", 7)], "domain_id bigint, name string, value_type_id int"))
    names = {r.name: r.variable_id for r in lake.table("variables").collect()}
    rule = (names["age"], names["adult"], "ge", "18")
    jobs.upsert(lake, "variable_mapping", frame([rule], "from_variable_id bigint, to_variable_id bigint, operator string, operants string"))
    assert [(r.destination, r.source, r.operands) for r in jobs.stored_rules(lake)] == [("adult", "age", "18")]
    with pytest.raises(ValueError, match="orphan variable_mapping"):
        jobs.upsert(lake, "variable_mapping", frame([(99, names["adult"], "ge", "1")], "from_variable_id bigint, to_variable_id bigint, operator string, operants string"))


EAV = "record string, field_name string, value string"
FIRST = [
    ("1", "age", "30"), ("1", "sex", "2"), ("1", "signs", "1"), ("1", "signs", "2"), ("2", "age", "41"), ("3", "age", "5"), ("3", "seen", "3/4/2024"),
    ("007", "age", "70"), ("7", "sex", "1"), (None, "age", "1"),
]


@pytest.mark.parametrize("convert", [True, False])
def test_only_changed_records_are_widened(described, frame, monkeypatch, convert):
    lake = described
    widened = []
    plain = jobs._widened
    monkeypatch.setattr(jobs, "_widened", lambda rows, *a: widened.append({r.record for r in rows.collect()}) or plain(rows, *a))

    def stored(rows, **more):
        jobs.eav_to_dataset(lake, "My study", "visits_eav", rows=frame(rows, EAV), convert=convert, **more)
        return lake.read_dataset("My study", "visits")

    def rebuilt(rows):
        jobs.eav_to_dataset(lake, "My study", "check_eav", rows=frame(rows, EAV), convert=convert)
        return lake.read_dataset("My study", "check")

    stored(FIRST, incremental=True)
    assert widened.pop() == {"1", "2", "3", "007", "7", None}
    # 2 is removed, 3 altered, 4 added, 1 comes in another order; 7 and 007 are one record of the typed table, and 7 loses its row.
    second = [r for r in reversed(FIRST) if r[0] not in ("2", "7")] + [("3", "sex", "1"), ("4", "age", "4")]
    renewed = stored(second, incremental=True)
    changed = widened.pop()
    assert changed == {"3", "4", "007", None} if convert else {"3", "4", None}
    assert_same_rows(renewed, rebuilt(second))
    widened.clear()
    # A repeated row counts, another value in one place and the same in another does too.
    third = [(r[0], r[1], "2" if r == ("1", "signs", "1") else "1" if r == ("1", "signs", "2") else r[2]) for r in second] + [("4", "signs", "1")] * 2
    assert_same_rows(stored(third, incremental=True), rebuilt(third))
    assert widened[0] == {"4", None}
    widened.clear()
    # Another way of making it: nothing can be taken over.
    again = stored(third, incremental=True, integer_record=False)
    assert widened[0] == ({"1", "3", "4", "007", None}) and again.count() == 5
    widened.clear()
    stored([], incremental=True, integer_record=False)
    assert lake.read_dataset("My study", "visits").count() == 0


def test_longitudinal_exports(described, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("record,visit,field_name,value\n1,first,age,30\n1,second,age,31\n1,second,sex,2\n2,first,age,9\n")
    by_visit = jobs.eav_to_dataset(described, "My study", "visits_eav", str(path), keys=["record", "visit"])
    assert sorted((r.record, r.visit, r.age, r.sex) for r in by_visit.collect()) == [(1, "first", 30, None), (1, "second", 31, 2), (2, "first", 9, None)]
    path.write_text("record,visit,field_name,value\n1,first,age,30\n1,second,age,32\n1,second,sex,2\n2,third,age,9\n")
    renewed = jobs.eav_to_dataset(described, "My study", "visits_eav", str(path), keys=["record", "visit"], incremental=True)
    assert sorted((r.record, r.visit, r.age, r.sex) for r in renewed.collect()) == [(1, "first", 30, None), (1, "second", 32, 2), (2, "third", 9, None)]
    raw = jobs.eav_to_dataset(described, "My study", "raw_eav", str(path), keys=["record", "visit"], convert=False)
    assert raw.columns == ["record", "visit", "age", "sex"] and raw.count() == 3
    ignored = jobs.eav_to_dataset(described, "My study", "plain_eav", str(path), convert=False)
    assert sorted((r.record, r.age) for r in ignored.collect()) == [("1", "30, 32"), ("2", "9")]
    with pytest.raises(ValueError, match="arm"):
        jobs.eav_to_dataset(described, "My study", "other_eav", str(path), keys=["record", "arm"])


def test_items_keep_their_ids_and_are_mapped(described, frame):
    lake = described
    jobs.register_dictionary(lake, frame([("mood", "f", "radio", None, "1, Good | 2, Bad", "Mood", None, 1)], ", ".join(DICTIONARY_COLUMNS)), 2, "other")
    names = {r.vocabulary_id: r.name for r in lake.table("vocabularies").collect()}
    items = {(names[r.vocabulary_id], r.value): r.vocabulary_item_id for r in lake.table("vocabulary_items").collect()}
    assert sorted(items.values()) == list(range(1, len(items) + 1))
    pairs = [(items["src.sex", 1], items["other.mood", 2]), (items["src.signs", 2], items["other.mood", 2])]
    stored = jobs.record_vocabulary_mapping(lake, frame(pairs, "from_vocabulary_item bigint, to_vocabulary_item bigint"))
    assert sorted(r.vocabulary_mapping_id for r in stored.collect()) == [1, 2]
    data = frame([(1, 1), (2, 2), (3, None)], "id bigint, sex int")
    recoded = jobs.recode(lake, data, "sex", "src.sex", "src.signs", "sign")
    assert {r.id: r.sign for r in recoded.collect()} == {1: 2, 2: None, 3: None}
    with pytest.raises(ValueError, match="no vocabularies 'nothing'"):
        jobs.recode(lake, data, "sex", "src.sex", "nothing", "sign")
    # A reloaded list keeps the ids of the items that stay.
    jobs.register_dictionary(lake, frame([("mood", "f", "radio", None, "2, Bad | 3, Odd", "Mood", None, 1)], ", ".join(DICTIONARY_COLUMNS)), 2, "other")
    later = {(names[r.vocabulary_id], r.value): r.vocabulary_item_id for r in lake.table("vocabulary_items").collect()}
    assert later["other.mood", 2] == items["other.mood", 2] and ("other.mood", 1) not in later
    assert later["other.mood", 3] == max(items.values()) + 1
    with pytest.raises(ValueError, match="orphan vocabulary_mapping.to_vocabulary_item"):
        jobs.register_dictionary(lake, frame([("mood", "f", "radio", None, "3, Odd", "Mood", None, 1)], ", ".join(DICTIONARY_COLUMNS)), 2, "other")


DICTIONARY_COLUMNS = [
    "field_name string", "form_name string", "field_type string", "text_validation_type_or_show_slider_number string",
    "select_choices_or_calculations string", "field_label string", "field_note string", "ord bigint",
]


def test_commits_refuse_unknown_values(lake, frame):
    with pytest.raises(ValueError, match="unknown studies.study_type_id"):
        jobs.register_study(lake, "Other", 999, ["people"])
    with pytest.raises(ValueError, match="unknown variables.keyrole"):
        jobs.upsert(lake, "variables", frame([(1, "v", 1, "key")], "domain_id bigint, name string, value_type_id int, keyrole string"))
    with pytest.raises(ValueError, match="orphan variables.domain_id"):
        jobs.upsert(lake, "variables", frame([(77, "v", 1, "none")], "domain_id bigint, name string, value_type_id int, keyrole string"))
    assert lake.table("variables").count() == 0


def test_who_made_a_version(described, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT)
    jobs.eav_to_dataset(described, "My study", "visits_eav", str(path), multi_line=True)
    (dataset,) = jobs.describe_datasets(described, "My study").collect()
    assert (dataset.name, dataset.major) == ("visits", 1) and {v.name for v in dataset.variables} == {"age", "seen", "sex", "signs"}
    assert [i.code for v in dataset.variables if v.name == "sex" for i in v["items"]]
    asset, version = described.table("assets").first(), described.table("asset_versions").first()
    assert asset.created_by and asset.created_by == version.created_by and asset.date_created is not None


def test_rows_without_audit_columns(lake, frame):
    study = lake.study_id("My study")
    plain = "asset_id bigint, study_id bigint, name string, description string, asset_type string"
    lake.commit({"assets": frame([(5, study, "visits", None, "dataset")], plain)})
    asset = lake.table("assets").first()
    assert (asset.asset_id, asset.name, asset.date_created, asset.created_by) == (5, "visits", None, None)
    lake.commit({"assets": frame([(5, study, "visits", None, "dataset", "me")], f"{plain}, Created_By string")})
    assert lake.table("assets").first().created_by == "me"
    with pytest.raises(AnalysisException, match="asset_type"):
        lake.commit({"assets": lake.table("assets").drop("asset_type")})
    assert lake.table("assets").first().created_by == "me"
