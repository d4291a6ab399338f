"""Mapping rules and entity instances on small inputs."""

import random

import pytest

from studylake.operators import harmonize as har
from studylake.operators.classes import equivalence_classes

MAPPING = "mapping_id int, from_variable_id bigint, to_variable_id bigint, operator string, operants string, prerequisite_id bigint"


@pytest.fixture
def variables(frame):
    names = ["age", "cough", "days", "adult", "long_cough", "group"]
    return frame([(i + 1, name) for i, name in enumerate(names)], "variable_id bigint, name string")


def test_rules_from_tables(frame, variables):
    mapping = frame(
        [(2, 3, 5, "gt", "14", 2), (1, 1, 4, "ge", "18", None), (3, 1, 6, "map", "30=thirty|40=forty", None)], MAPPING
    )
    rules = har.mapping_rules(mapping, variables)
    assert [(r.destination, r.source, r.operator, r.prerequisite) for r in rules] == [
        ("adult", "age", "ge", None), ("long_cough", "days", "gt", "cough"), ("group", "age", "map", None),
    ]
    data = frame([(1, 30, 1, 20), (2, 17, 0, 20), (3, None, 1, 3), (4, 40, None, 99)], "id bigint, age int, cough int, days int")
    derived = {r.id: (r.adult, r.long_cough, r.group) for r in har.apply_variable_mapping(data, rules, ["id"]).collect()}
    assert derived == {1: ("1", "1", "thirty"), 2: ("0", None, None), 3: (None, "0", None), 4: ("1", None, "forty")}
    with pytest.raises(ValueError, match="unknown variable"):
        har.mapping_rules(frame([(1, 99, 4, "ge", "18", None)], MAPPING), variables)


def test_several_rules_for_one_destination(frame):
    rules = [har.MappingRule("fever", "temp", "gt", "38"), har.MappingRule("fever", "note", "contains", "hot")]
    data = frame([(1, 39.0, "fine"), (2, 37.0, "hot"), (3, 37.0, "fine"), (4, None, None)], "id bigint, temp double, note string")
    assert {r.id: r.fever for r in har.apply_variable_mapping(data, rules, ["id"]).collect()} == {1: "1", 2: "1", 3: "0", 4: None}


def test_known_instances_keep_their_ids(frame):
    rows = frame([(7, "a"), (7, "b"), (7, "a"), (8, "a"), (7, None)], "study bigint, person string")
    first = har.extract_entity_instances(rows.where("study = 7"), 1, "study", "person", 5)
    assert {(r.external_id, r.transformation_id) for r in first.collect()} == {("a", 5), ("b", 5)}
    later = har.extract_entity_instances(rows, 1, "study", "person", 6, existing=first)
    assert [(r.instance_id, r.study_id, r.external_id) for r in later.collect()] == [(3, 8, "a")]


def test_instances_belong_to_one_study(frame):
    rows = frame([(1, "p1", "h1", "2024-01-02"), (1, "p1", "h1", "2024-01-05"), (2, "p1", "h2", "2024-02-01")], "study_id bigint, person string, home string, day string")
    known = "study_id bigint, external_id string, instance_id bigint"
    people = frame([(1, "p1", 11), (2, "p1", 21)], known)
    homes = frame([(1, "h1", 12), (2, "h1", 22), (2, "h2", 23)], known)
    found = har.extract_relation_instances(rows, "person", "home", "day", people, homes, 4, 9).collect()
    assert sorted((r.entity_instance_id_1, r.entity_instance_id_2, str(r.valid_from), str(r.valid_to)) for r in found) == [
        (11, 12, "2024-01-02", "2024-01-05"), (21, 23, "2024-02-01", "2024-02-01"),
    ]
    used = frame([(100, 1, "p1"), (100, 1, "p1"), (200, 2, "p1"), (300, 3, "p1")], "asset bigint, study bigint, person string")
    links = har.asset_entities(used, "asset", "person", people, study_id="study").collect()
    assert sorted(map(tuple, links)) == [(100, 11), (200, 21)]


def test_recoding_refuses_several_targets(frame):
    items = frame([(1, 10), (2, 20), (3, 30)], "vocabulary_item_id bigint, value int")
    data = frame([(1, 10), (2, 20), (3, 99), (4, None)], "id bigint, code int")
    mapping = frame([(1, 2), (1, 2), (2, 3)], "from_item bigint, to_item bigint")
    assert {r.id: r.new for r in har.recode_vocabulary(data, "code", mapping, items, items, "new").collect()} == {1: 20, 2: 30, 3: None, 4: None}
    two = frame([(1, 2), (1, 3)], "from_item bigint, to_item bigint")
    with pytest.raises(Exception, match="several counterparts of 10"):
        har.recode_vocabulary(data, "code", two, items, items, "new").collect()


def test_rules_in_layers(frame):
    rule = har.MappingRule
    rules = [
        rule("c", "b", "eq", "1"), rule("b", "a", "gt", "5"), rule("d", "x", "map", "1=one|2=two", prerequisite="c"),
        rule("e", "d", "contains", "w"), rule("x", "n", "ge", "10", prerequisite="e"), rule("f", "n", "lt", "100"), rule("f", "d", "eq", "one"),
    ]
    # `x` is a column of the data, so rule d reads that and not the derived one.
    assert har.rule_layers(rules, ["id", "a", "x", "n"]) == [["b"], ["c"], ["d"], ["e", "f"], ["x"]]
    data = frame([(1, 9, 2, 7), (2, 9, 1, 70), (3, 1, 2, 170), (4, None, 2, None)], "id bigint, a int, x int, n int")
    derived = {r.id: (r.b, r.c, r.d, r.e, r.x, r.f) for r in har.apply_variable_mapping(data, rules, ["id"]).collect()}
    assert derived == {
        1: ("1", "1", "two", "1", "0", "1"), 2: ("1", "1", "one", "0", None, "1"), 3: ("0", "0", None, None, None, "0"),
        4: (None, None, None, None, None, None),
    }


def test_rules_that_need_each_other_are_refused(frame):
    rule = har.MappingRule
    cycle = [rule("a", "b", "eq", "1"), rule("b", "id", "eq", "1", prerequisite="c"), rule("c", "a", "eq", "1"), rule("d", "id", "eq", "1")]
    with pytest.raises(ValueError, match="a <- b <- c <- a"):
        har.apply_variable_mapping(frame([(1,)], "id bigint"), cycle, ["id"])
    with pytest.raises(ValueError, match="'a' needs 'nothing'"):
        har.rule_layers([rule("a", "nothing", "eq", "1")], ["id"])
    with pytest.raises(ValueError, match="a <- a"):
        har.rule_layers([rule("a", "a", "eq", "1")], ["id"])


def test_a_long_chain_of_rules(frame):
    rules = [har.MappingRule(f"v{i}", f"v{i - 1}" if i else "id", "eq", "1") for i in range(40)]
    row = har.apply_variable_mapping(frame([(1,), (2,)], "id bigint"), rules, ["id"]).orderBy("id").collect()
    assert [row[0][f"v{i}"] for i in range(40)] == ["1"] * 40 and [row[1].v0, row[1].v39] == ["0", "0"]


def test_separators_in_operands(frame):
    rules = [
        har.MappingRule("a", "t", "map", r"x\|y=1\=2|p\\=q"), har.MappingRule("b", "t", "between", r"a\,b,c"),
        har.MappingRule("c", "t", "contains", "|"), har.MappingRule("d", "t", "eq", r"x\|y"),
    ]
    texts = ["x|y", "p\\", "b", "a", "a,b"]
    got = {r.t: (r.a, r.b, r.c, r.d) for r in har.apply_variable_mapping(frame([(t,) for t in texts], "t string"), rules, ["t"]).collect()}
    assert got == {
        "x|y": ("1=2", "0", "1", "1"), "p\\": ("q", "0", "0", "0"), "b": (None, "1", "0", "0"), "a": (None, "0", "0", "0"),
        "a,b": (None, "1", "0", "0"),
    }
    with pytest.raises(ValueError, match="unknown operator 'like'"):
        har.apply_variable_mapping(frame([("a",)], "t string"), [har.MappingRule("a", "t", "like", "x")], [])


PAIRS = "from_vocabulary_item bigint, to_vocabulary_item bigint"


def test_classes_equal_a_walk(frame):
    rng = random.Random(3)
    for n, m in ((5, 3), (60, 40), (200, 190)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (1, None)]
        label = {x: x for pair in pairs if None not in pair for x in pair}
        for _ in range(n):
            for a, b in pairs:
                if a is not None and b is not None:
                    label[a] = label[b] = min(label[a], label[b])
        found = {r["item"]: r.class_id for r in equivalence_classes(frame(pairs, PAIRS), *PAIRS.replace(" bigint", "").split(", ")).collect()}
        assert found == label


def test_classes_of_a_long_chain_and_a_hub(frame, monkeypatch):
    from studylake.operators import classes

    written = []
    plain = classes.materialize
    monkeypatch.setattr(classes, "materialize", lambda df, name: written.append(name) or plain(df, name))
    chain = [(i, i + 1) for i in range(600)]
    hub = [(10_000, 20_000 - i) for i in range(500)]
    found = {r["item"]: r.class_id for r in equivalence_classes(frame(chain + hub, PAIRS), "from_vocabulary_item", "to_vocabulary_item").collect()}
    assert {found[i] for i in range(601)} == {0} and {found[20_000 - i] for i in range(500)} == {10_000}
    assert written.count("class-labels") < 20
    assert equivalence_classes(frame([], PAIRS), "from_vocabulary_item", "to_vocabulary_item").collect() == []


def test_recoding_between_vocabularies(frame):
    items = frame([(1, 1, 10), (2, 1, 20), (3, 2, 5), (4, 3, 7), (5, 3, 8), (6, 3, 9)], "vocabulary_item_id bigint, vocabulary_id bigint, value bigint")
    classes = har.item_classes(items, frame([(3, 1), (3, 4), (5, 2)], PAIRS))
    assert sorted((r.vocabulary_item_id, r.class_id) for r in classes.collect()) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 2), (6, 6)]
    data = frame([(1, 10), (2, 20), (3, 99), (4, None)], "id bigint, code int")
    # 1 and 4 are the same over an item of a third vocabulary.
    assert {r.id: r.new for r in har.recode_between(data, "code", classes, 1, 3, "new").collect()} == {1: 7, 2: 8, 3: None, 4: None}
    assert {r.id: r.new for r in har.recode_between(data, "code", classes, 1, 2, "new").collect()} == {1: 5, 2: None, 3: None, 4: None}
    assert har.class_conflicts(classes).collect() == []
    chosen = {r.class_id: r.vocabulary_item_id for r in har.representatives(classes, [3, 2]).collect()}
    assert chosen == {1: 4, 2: 5, 6: 6}
    merged = har.item_classes(items, frame([(3, 1), (3, 4), (5, 2), (5, 4)], PAIRS))
    assert sorted(map(tuple, har.class_conflicts(merged).collect())) == [(1, 1, 2, 1, 2), (1, 3, 2, 4, 5)]
    with pytest.raises(Exception, match="several counterparts of 10"):
        har.recode_between(data, "code", merged, 1, 3, "new").collect()


def test_asset_entities_keep_their_partitions(frame):
    """Adaptive execution would merge them by bytes, into one here."""
    used = frame([(1, 7, "a"), (1, 7, "a"), (1, 8, "a"), (2, 7, None), (None, 7, "a")], "asset int, study int, person string")
    people = frame([(7, "a", 70), (8, "a", 80), (8, "a", 80), (7, None, 71)], "study_id bigint, external_id string, instance_id bigint")
    links = har.asset_entities(used, "asset", "person", people, study_id="study")
    assert sorted((r.asset_id or 0, r.entity_instance_id) for r in links.collect()) == [(0, 70), (1, 70), (1, 80)]
    assert links.rdd.getNumPartitions() >= 32
