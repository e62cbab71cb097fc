"""The reader of one large JSON array, with splits that fall anywhere in a record."""

import json
import random

import pytest

from veilmap.sources.json_arrays import read_array

SCHEMA = "id bigint, name string, inner array<struct<a:string,b:array<bigint>>>"


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


def nasty(rng, n):
    part = ["}", "{", "]", "[", '"', "\\", ",", "é", "😀", "\n", " ", "x", "\\u007d"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(9)))
    return [{"id": i, "name": word(), "inner": [{"a": word(), "b": [1, 2]} for _ in range(rng.randrange(4))]} for i in range(n)]


def rows(df):
    return sorted((r["id"], r["name"], [(x["a"], list(x["b"])) for x in r["inner"]]) for r in df.collect())


def wanted(records):
    return sorted((r["id"], r["name"], [(x["a"], x["b"]) for x in r["inner"]]) for r in records)


@pytest.mark.parametrize("size", [7, 64, 700, 10**7])
@pytest.mark.parametrize("layout", [dict(), dict(indent=2), dict(ensure_ascii=False, separators=(",", ":"))])
def test_any_split_gives_the_same_rows(spark, tmp_path, small_splits, size, layout):
    records = nasty(random.Random(size), 12 if size == 7 else 60)
    path = tmp_path / "one.json"
    path.write_text(json.dumps(records, **layout), encoding="utf-8")
    small_splits(max(size, path.stat().st_size // 25))
    assert size > path.stat().st_size or spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
    assert rows(read_array(spark, str(path), SCHEMA)) == wanted(records)


def test_several_files_and_the_shuffled_join(spark, tmp_path, small_splits):
    records = nasty(random.Random(5), 40)
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps(records[10 * i:10 * i + 10]), encoding="utf-8")
    small_splits(90)
    assert rows(read_array(spark, str(tmp_path), SCHEMA, broadcast_splits=3)) == wanted(records)


def test_a_record_larger_than_many_splits(spark, tmp_path, small_splits):
    records = [{"id": 1, "name": "}" * 500 + '"{' * 300, "inner": []}, {"id": 2, "name": "", "inner": [{"a": "[", "b": []}]}]
    (tmp_path / "big.json").write_text(json.dumps(records))
    small_splits(50)
    assert rows(read_array(spark, str(tmp_path / "big.json"), SCHEMA)) == wanted(records)


@pytest.mark.parametrize("text", ["", "[]", " [ ]\n", "[1, null]", '["a{b"]'])
def test_no_records(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    assert read_array(spark, str(tmp_path / "e.json"), SCHEMA).count() == 0


def test_other_elements_give_no_row(spark, tmp_path):
    (tmp_path / "m.json").write_text('[1, "a{b", {"id": 1}, null, {"id": "no"}, true]')
    assert sorted((r["id"] is None, r["id"]) for r in read_array(spark, str(tmp_path / "m.json"), SCHEMA).collect()) == [(False, 1), (True, None)]


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": 2}', '[{"name": "x}]', '{"id": 1}', '{"id": 1}\n{"id": 2}\n'])
def test_broken_files_are_errors(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(Exception, match="array of objects"):
        read_array(spark, str(tmp_path / "b.json"), SCHEMA).collect()
