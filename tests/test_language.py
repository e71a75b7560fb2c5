from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from askframe.functions.literals import extract
from askframe.functions.text import compound, lemma, parts, similarity, tokenize
from askframe.plans.intent import IntentModel, by_rules, choose
from askframe.plans.link import CatalogIndex, implicit_values, score_columns, score_tables
from tests.fixtures import FLAGS, FLEET, SHOP, catalog

NOW = date(2024, 5, 15)


@pytest.mark.parametrize(
    "word, base",
    [("categories", "category"), ("orders", "order"), ("services", "service"), ("scaled", "scale"), ("employees", "employee"), ("address", "address"), ("status", "status"), ("boxes", "box"), ("people", "person")],
)
def test_lemma(word, base):
    assert lemma(word) == base


def test_identifier_parts():
    assert parts("createdAt") == ("create", "at") and parts("parent_id") == ("parent", "id") and parts("HTTPServer") == ("http", "server")
    assert parts("onlineorders") == ("online", "order")
    assert compound("orders") == ["orders"] and compound("name") == ["name"]


def test_similarity():
    assert round(similarity("categris", "category"), 2) == 0.75
    assert similarity("a", "") == 0 and similarity("x", "x") == 1


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_similarity_is_symmetric_and_bounded(a, b):
    assert similarity(a, b) == similarity(b, a) and 0 <= similarity(a, b) <= 1


def test_tokens_keep_quoted_apart():
    q = tokenize("show employees named 'John Smith' and don't count")
    assert q.quoted == ("John Smith",)
    assert [t.lemma for t in q.tokens if not t.quoted][:2] == ["show", "employee"]


def test_literals_use_up_their_text():
    v = extract("orders of 1995-01-01 with priority '1-URGENT' top 5", NOW)
    assert [x.value for x in v.dates] == [date(1995, 1, 1)] and v.numbers == [] and v.top == 5 and v.quoted == ["1-URGENT"]


def test_numbers():
    v = extract("price 10 or 2.5 and -3 but not x7", NOW)
    assert [x.value for x in v.numbers] == [10, 2.5, -3]
    assert extract("limit 7", NOW).limit == 7 and extract("first 3 rows", NOW).top == 3


@pytest.mark.parametrize("text, op", [("price > 5", ">"), ("price at least 5", ">="), ("price less than 5", "<"), ("price is 5", "="), ("price at most 5", "<="), ("price other than 5", "<>")])
def test_comparisons(text, op):
    assert [(x.op, x.value) for x in extract(text, NOW).numbers] == [(op, 5)]


def test_between():
    x = extract("size between 10 and 20", NOW).numbers[0]
    assert (x.op, x.value, x.upper) == ("between", 10, 20)


@pytest.mark.parametrize(
    "text, day",
    [("today", NOW), ("yesterday", date(2024, 5, 14)), ("tomorrow", date(2024, 5, 16)), ("3 days ago", date(2024, 5, 12)), ("5 March 2020", date(2020, 3, 5)), ("March 5, 2020", date(2020, 3, 5)),
     ("december 1", date(2023, 12, 1)), ("monday", date(2024, 5, 13)), ("2 months ago", date(2024, 3, 15)), ("1 year ago", date(2023, 5, 15)), ("12/31/2020", date(2020, 12, 31))],
)
def test_dates(text, day):
    assert [x.value for x in extract(f"orders from {text}", NOW).dates] == [day]


def test_impossible_date_is_dropped():
    assert extract("orders on 2020-13-45", NOW).dates == []


def test_yes_no_and_predicates():
    assert extract("list active employees").booleans == [True]
    v = extract("list employees that are not active")
    assert v.booleans == [] and v.predicates == [("active", False)]
    assert extract("products that are services").predicates == [("service", True)]
    assert extract("where name is null").nulls == [("name", True)] and extract("where name is not null").nulls == [("name", False)]


@pytest.mark.parametrize(
    "question, intent",
    [("how many employees are there", "count"), ("are there any orders", "exists"), ("sum of salary", "sum"), ("total salary of employees", "sum"), ("average salary", "avg"), ("lowest price", "min"),
     ("highest price", "max"), ("top 5 employees by salary", "top"), ("list all clients", "list"), ("earliest date", "min"), ("latest hired date", "max"), ("total orders", "count")],
)
def test_rules(question, intent):
    assert by_rules(question) == (intent, 0.4)


def test_model_round_trip(tmp_path):
    from askframe.operators.training import seed_corpus

    m = IntentModel.fit(seed_corpus())
    m.save(str(tmp_path / "m.json"))
    again = IntentModel.load(str(tmp_path / "m.json"))
    assert IntentModel.load(str(tmp_path / "none.json")) is None
    held_out = [("how many widgets are there", "count"), ("average weight of widgets", "avg"), ("top 7 widgets by weight", "top"), ("list all widgets", "list"), ("are there any widgets", "exists")]
    assert all(choose(q, again)[0] == label for q, label in held_out)
    assert abs(sum(p for _, p in again.ranks("anything")) - 1) < 1e-6
    assert choose("list", again, "count") == ("count", 0.6)
    with pytest.raises(ValueError):
        choose("x", None, "nonsense")


def test_table_scores():
    index = CatalogIndex(FLEET)
    assert score_tables(tokenize("how many employees"), index)[0].table == "Employee"
    assert score_tables(tokenize("how many emplyees"), index)[0].table == "Employee"
    # equal scores go by mention; a whole name beats a part
    assert score_tables(tokenize("products with their categories"), CatalogIndex(SHOP))[0].table == "products"
    both = CatalogIndex(catalog(onlineorders=["id integer pk"], orders=["id integer pk"]))
    assert score_tables(tokenize("list orders"), both)[0].table == "orders"


def test_column_scores():
    index = CatalogIndex(FLEET)
    best = score_columns(tokenize("average salary"), index)[0]
    assert (best.table, best.column, best.reason) == ("Employee", "salary", "exact")
    assert any(m.column == "active" and m.reason == "synonym" for m in score_columns(tokenize("enabled employees"), index, ["Employee"]))
    assert score_columns(tokenize("salry"), index)[0].reason == "fuzzy"


def test_join_paths():
    assert FLEET.path("Employee", "Client") == [("Employee", "clientId", "Client", "id")]
    assert [e[2] for e in FLEET.path("Employee", "Organization")] == ["Client", "Organization"]
    assert FLEET.path("User", "User") == [] and SHOP.path("products", "orphan") is None and SHOP.path("products", "nothing") is None


def implicit(question, c):
    v = extract(question)
    return [(x.table, x.value) for x in implicit_values(tokenize(question), CatalogIndex(c), {w for w, _ in v.predicates})]


def test_implicit_values():
    assert implicit("total users belongs to org swaraj", FLEET) == [("Organization", "swaraj")]
    assert implicit("employees of client Acme", FLEET) == [("Client", "Acme")]
    assert implicit("list employee named John", FLEET) == [("Employee", "John")]
    assert implicit("list all products under the Pizza category", SHOP) == [("categories", "Pizza")]
    assert implicit("how many employees are there", FLEET) == []
    assert implicit("list products that are services", FLAGS) == []
    assert implicit("list products by suplier", FLAGS) == []
    assert implicit("list product named 276", FLAGS) == []


def test_case_collisions_are_refused():
    with pytest.raises(ValueError, match="differ in case"):
        catalog(a=["id integer"], A=["id integer"])
