"""The stored index of names against a plain search of every account."""

from __future__ import annotations

import random

import pytest

from conftest import collect
from folio.operators import accounts
from folio.operators.name_index import PART, NameIndex, write_name_index

SCHEMA = "tenant_id string, customer_id string, customer_full_name string, customer_email string, risk_score double, risk_band string, customer_country string"


def people():
    draw = random.Random(2)
    names = ["Mary Smith", "Ann Smithson", "Zoë Ångström", "Ana 100%", "Li _x_", "日本 太郎", "A", "", "Bo Bo Bo", None, "ann smith"]
    rows = [(draw.choice("tu"), f"C{i}", draw.choice(names), draw.choice([f"user{i}@example.com", "ann@x.org", None, "SMITH@ex.com"]), draw.choice([None, float(i % 5)]), None, None) for i in range(150)]
    return rows + [("t", "C7", "Ann Smith", "other@x.org", 3.0, None, None), ("t", "C7", "Bob", "bob@x.org", 3.0, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(people(), SCHEMA)


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("names"))
    write_name_index(table, folder)
    return folder


@pytest.fixture
def index(spark, folder):
    return NameIndex(spark, folder)


NEEDLES = ["smith", "s", "mi", "mary smith", "0%", "_x", "ö", "ng", "日本", "太", "bo bo", "bob", "bo bo bo bo", "user1", "user12@", "@example.com", "xyz", "smithx", "a", " ", "n smith", "h@ex", "smith" * 40]


@pytest.mark.parametrize("rarest", [1, 2, 5])
def test_pairs_are_those_of_a_search_of_every_account(spark, folder, rarest):
    index = NameIndex(spark, folder, rarest)
    needles = spark.createDataFrame([(t, n) for t in ("t", "u", "v") for n in NEEDLES] + [("t", ""), ("t", "smith")], "tenant_id string, needle string")
    got = collect(index.find_containing(needles), "tenant_id", "needle", "customer_id")
    want = sorted(
        {(t, n, c) for t, c, name, mail, *_ in people() for n in NEEDLES if any(n in (x or "").lower() for x in (name, mail))}, key=repr
    )
    assert got == want


def test_resolved_names_do_not_depend_on_the_index(spark, table, index):
    asked = spark.createDataFrame([(t, n) for t in "tu" for n in ["Mary Smith", "smith", "Zed Smith", "nobody", "", "ann", "user12"]], "tenant_id string, request string")
    unique = table.filter("customer_id <> 'C7'")
    with_index = collect(accounts.resolve_names(unique, asked, containing=lambda n: index.find_containing(n).filter("customer_id <> 'C7'")))
    assert with_index == collect(accounts.resolve_names(unique, asked))


def test_search(spark, table, index):
    unique = table.filter("customer_id <> 'C7'")
    for text in ("Smith", "ANN", "b", "nobody"):
        want = collect(accounts.search_accounts(unique, text, 1000), "tenant_id", "customer_id")
        assert [r for r in collect(index.search(text, 1000), "tenant_id", "customer_id") if r[1] != "C7"] == want


def test_few_needles_read_few_files(spark, index):
    one = spark.createDataFrame([("t", "smithson")], "tenant_id string, needle string")
    grams = index.rarest_grams(one)
    postings = index.postings_of(grams)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({PART}" in plan or f"{PART}#" in plan.split("PartitionFilters")[1][:60]
    parts = {r[0] for r in postings.select(PART).distinct().collect()}
    assert 0 < len(parts) <= 2 < index.postings.select(PART).distinct().count()


def test_an_empty_book(spark, table, tmp_path):
    write_name_index(table.limit(0), str(tmp_path / "none"))
    needles = spark.createDataFrame([("t", "smith")], "tenant_id string, needle string")
    assert NameIndex(spark, str(tmp_path / "none")).find_containing(needles).count() == 0
