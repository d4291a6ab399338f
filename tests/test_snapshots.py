"""Catalog queries of the flavours that run inside the test process, on the mortality schema."""

import sqlite3

import duckdb
import pytest

from studylake import types as VT
from studylake.session import local_rows
from studylake.sources import snapshots
from studylake.operators import profile as prof

TABLES = """
CREATE TABLE causes (code INTEGER NOT NULL PRIMARY KEY, label {text} NOT NULL, description {text});
CREATE TABLE cause_categories (cause_category INTEGER NOT NULL PRIMARY KEY, label {text} NOT NULL);
CREATE TABLE sources (id INTEGER NOT NULL PRIMARY KEY, name {text} NOT NULL);
CREATE TABLE sites (site_id INTEGER NOT NULL PRIMARY KEY, source_id INTEGER, FOREIGN KEY (source_id) REFERENCES sources (id));
CREATE TABLE deaths (death_id INTEGER NOT NULL PRIMARY KEY, site_id INTEGER NOT NULL, cause INTEGER, cause_category INTEGER,
  state {text} CHECK (state IN ('final', 'open')), seen DATE,
  FOREIGN KEY (site_id) REFERENCES sites (site_id), FOREIGN KEY (cause) REFERENCES causes (code));
INSERT INTO causes VALUES (1, 'Natural', 'Died from natural causes'), (2, 'Unnatural', 'Did not die from natural causes');
INSERT INTO cause_categories VALUES (1, 'Medical'), (2, 'External');
INSERT INTO sources VALUES (1, 'Alpha'), (2, 'Beta');
INSERT INTO sites VALUES (10, 1), (20, 2);
"""


def reader(spark, execute):
    def read(sql):
        cursor = execute(sql)
        names = [d[0] for d in cursor.description]
        rows = cursor.fetchall()

        def kind(i):
            values = [r[i] for r in rows if r[i] is not None]
            return "boolean" if values and isinstance(values[0], bool) else "bigint" if values and isinstance(values[0], int) else "string"

        return local_rows(spark, rows, ", ".join(f"{n} {kind(i)}" for i, n in enumerate(names)))

    return read


@pytest.fixture
def profiles(spark):
    db = duckdb.connect()
    db.execute(TABLES.format(text="VARCHAR"))
    db.execute("CREATE TYPE mood AS ENUM ('low', 'high'); CREATE TABLE moods (k INTEGER PRIMARY KEY, m mood)")
    db.execute("COMMENT ON COLUMN deaths.cause IS 'The cause of the death'")
    lite = sqlite3.connect(":memory:")
    lite.executescript(TABLES.format(text="TEXT"))
    readers = {"duckdb": reader(spark, db.execute), "sqlite": reader(spark, lite.execute)}
    return {
        flavour: {(r.table_name, r.column_name): r for r in snapshots.profile_database(read, flavour).collect()}
        for flavour, read in readers.items()
    }


def test_profiles(profiles):
    for flavour, found in profiles.items():
        assert found["causes", "code"].value_type_id == VT.INTEGER
        assert found["causes", "label"].value_type_id == VT.STRING
        assert found["deaths", "seen"].value_type_id == VT.DATE
        cause = found["deaths", "cause"]
        assert cause.value_type_id == VT.CATEGORY and cause.vocabulary_name == "cause_codes"
        assert [(i.value, i.code) for i in cause["items"]] == [(1, "Natural"), (2, "Unnatural")]
        state = found["deaths", "state"]
        assert state.value_type_id == VT.CATEGORY and [(i.value, i.code) for i in state["items"]] == [(1, "final"), (2, "open")]
        category = found["deaths", "cause_category"]
        assert category.value_type_id == (VT.CATEGORY if flavour == "duckdb" else VT.INTEGER)
        assert found["deaths", "site_id"].value_type_id == VT.INTEGER
    assert profiles["duckdb"]["deaths", "cause"].description == "The cause of the death"
    mood = profiles["duckdb"]["moods", "m"]
    assert mood.value_type_id == VT.CATEGORY and [(i.value, i.code) for i in mood["items"]] == [(1, "low"), (2, "high")]


def test_every_flavour_has_its_queries():
    assert set(snapshots.COLUMN_QUERIES) == set(snapshots.CONSTRAINT_QUERIES) == set(prof.DEFAULT_SCHEMA) | {"mysql", "duckdb", "sqlite"}
    assert snapshots.quoted("mssql", "a]b") == "[a]]b]" and snapshots.quoted("mysql", "a") == "`a`"
