"""Substring search by trigrams: the same rows as a scan, from fewer postings."""

import random

import pytest

from retentia.operators import search, substring


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(2)
    some = ["".join(rng.choices("abcXY. %_é", k=rng.randint(0, 12))) for _ in range(400)]
    rows = [(k, v) for k, v in enumerate([*some, *some[:50], None, "", "a", "ab", "ABC"])]
    return spark.createDataFrame(rows, "id long, name string")


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    substring.build(names, "name", root)
    return substring.Index(spark, root)


@pytest.mark.parametrize("most", [0, 1000])
def test_same_rows_as_a_scan(names, index, monkeypatch, most):
    monkeypatch.setattr(substring, "MOST_LISTED", most)
    rows = [(r.id, r.name) for r in names.collect() if r.name is not None]
    for term in ("a", "AB", "abc", "x.", "%", "_", "é", "cab x", "bca", "nowhere", "yy%", "abcabcabcabc"):
        want = sorted(i for i, v in rows if term.lower() in v.lower())
        got = substring.holding(names, "name", index, term)
        assert got.columns == names.columns
        assert sorted(r.id for r in got.collect()) == want, term


def test_reads_the_rarest_postings_only(names, index):
    values = names.where("name <> ''").distinct().count()
    assert 0 < index.candidates("abc").count() < values / 10
    # no value holds all trigrams of the term: nothing is read
    assert index.candidates("abzzc").count() == 0
    plan = index.candidates("abc")._jdf.queryExecution().toString()
    assert "EqualTo(gram,abc)" in plan


def test_versions_and_empty_tables(spark, names, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        substring.Index(spark, root)
    substring.build(names.where("id < 0"), "name", root)
    empty = substring.Index(spark, root)
    assert substring.holding(names, "name", empty, "a").count() == 0
    with pytest.raises(ValueError):
        empty.matches("")
    substring.build(names, "name", root)
    assert substring.Index(spark.newSession(), root).matches("ab").count() > 0


def test_search_pages(spark, small, tmp_path):
    wide, root = small.wide, str(tmp_path)
    substring.build(wide, "customer_id", f"{root}/ids")
    substring.build(wide, "city", f"{root}/cities")
    ids, cities = (substring.Index(spark, f"{root}/{n}") for n in ("ids", "cities"))
    for term in ("R#0000", "12", "#000000001"):
        plain, quick = (
            search.search_subscribers(wide, term=term, status="retained", index=i).select("customer_id")
            for i in (None, ids))
        assert plain.count() == quick.count() == plain.intersect(quick).count()
        assert plain.count() > 0 or term != "R#0000"
    plain, quick = (search.search_cities(wide, 1, term="nation_1", index=i) for i in (None, cities))
    assert plain.collect() == quick.collect() != []
