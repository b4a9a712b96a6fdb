import pytest

from graphloom.operators.versions import Conflict, VersionCache, VersionedTable

ROW = "id string, n bigint"


@pytest.fixture()
def table(spark, tmp_path):
    clock = [0.0]
    out = VersionedTable(spark, f"file://{tmp_path}/t", ROW, clock=lambda: clock[0])
    out.test_clock = clock
    return out


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def held(table, version=None):
    return {r.id: r.n for r in table.read(version).collect()}


def test_versions_are_read_as_of(spark, table):
    assert table.head() == 0 and held(table) == {}
    assert table.commit(rows(spark, ("a", 1), ("b", 2), ("c", 3), (None, 9)), note="first") == 1
    assert table.commit(rows(spark, ("b", 20), ("d", 4)), ids(spark, "c", "d", "none")) == 2
    assert table.commit(removals=ids(spark, "a")) == 3
    assert [held(table, v) for v in (0, 1, 2, 3)] == [{}, {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 20, "d": 4}, {"b": 20, "d": 4}]
    assert sorted(r.id for r in table.touched(2).collect()) == ["b", "c", "d", "none"]
    with pytest.raises(ValueError):
        table.read(4)
    with pytest.raises(ValueError):
        table.commit()


def test_one_of_two_writers_on_a_key_is_refused(spark, table):
    table.commit(rows(spark, ("a", 1), ("b", 2), ("c", 3)))
    base = table.head()
    other = VersionedTable(spark, table.root, ROW)
    assert other.commit(rows(spark, ("a", 10)), base=base) == 2
    with pytest.raises(Conflict) as refused:
        table.commit(rows(spark, ("a", 11), ("b", 12)), base=base)
    assert refused.value.version == 2 and refused.value.keys == ["a"]
    assert held(table) == {"a": 10, "b": 2, "c": 3} and table.head() == 2  # nothing of it is left
    assert table.commit(rows(spark, ("b", 12)), ids(spark, "c"), base=base) == 3  # other keys: both commits stay
    assert held(table) == {"a": 10, "b": 12}
    assert table.commit(rows(spark, ("a", 11)), base=3) == 4  # on top of what the writer has seen


def test_a_number_is_claimed_once(spark, table):
    path = table._name(7)
    assert table._create(path, "x") and not table._create(path, "y")


def test_a_commit_claims_the_next_number_when_another_came_first(spark, table, monkeypatch):
    table.commit(rows(spark, ("a", 1)))
    create, other = table._create, VersionedTable(spark, table.root, ROW)

    def late(path, text):
        monkeypatch.setattr(table, "_create", create)
        other.commit(rows(spark, ("z", 26)))  # between the look and the claim
        return create(path, text)

    monkeypatch.setattr(table, "_create", late)
    assert table.commit(rows(spark, ("a", 2))) == 3 and held(table) == {"a": 2, "z": 26}


def test_revert_is_a_commit_of_its_own(spark, table):
    table.commit(rows(spark, ("a", 1), ("b", 2)))
    table.commit(rows(spark, ("a", 5), ("new", 6)), ids(spark, "b"))
    table.commit(rows(spark, ("other", 7)))
    assert table.revert(2) == 4 and held(table) == {"a": 1, "b": 2, "other": 7}
    assert held(table, 3) == {"a": 5, "new": 6, "other": 7}
    assert table.revert(4) == 5 and held(table) == held(table, 3)  # and back again
    table.commit(rows(spark, ("a", 8)))
    with pytest.raises(Conflict):  # a later commit touched what this one did
        table.revert(5)


def test_snapshot_and_expiry(spark, table):
    for n in range(4):
        table.test_clock[0] = 10.0 * n
        table.commit(rows(spark, ("a", n), (f"k{n}", n)))
    want = held(table)
    assert table.snapshot() == 5 and held(table) == want
    base = 4
    assert table.commit(rows(spark, ("a", 9)), base=base) == 6  # a snapshot touches nothing
    assert table.expire(keep=3) == []  # versions 4 to 6 need all before the snapshot
    table.test_clock[0] = 100.0
    assert table.expire(keep=2, older=75.0) == [1, 2, 3] and held(table) == want | {"a": 9}
    with pytest.raises(ValueError):
        table.read(3)


def test_cache_of_many_vaults(spark, tmp_path):
    clock, tables = [0.0], {}

    def open_(name):
        return tables.setdefault(name, VersionedTable(spark, f"file://{tmp_path}/{name}", ROW))

    for name in "xyz":
        open_(name).commit(rows(spark, (name, 1)))
    cache = VersionCache(open_, ttl=60, most=2, clock=lambda: clock[0])
    first = cache.get("x")
    open_("x").commit(rows(spark, ("x", 2)))
    clock[0] = 59.0
    assert cache.get("x") is first and first.first().n == 1
    clock[0] = 61.0
    assert cache.get("x") is not first and cache.get("x").first().n == 2
    again = cache.get("x")
    clock[0] = 130.0
    assert cache.get("x") is again  # looked at, but it is the same version
    cache.get("y"), cache.get("x"), cache.get("z")
    assert list(cache.held) == ["x", "z"]
    open_("z").commit(rows(spark, ("z", 3)))
    assert cache.refresh() == ["z"] and cache.get("z").first().n == 3
