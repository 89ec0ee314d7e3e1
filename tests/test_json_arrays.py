"""Arrays of JSON records, cut into splits of any size."""

import json
import random

import pytest

from larder.sources.files import read_json_records
from larder.sources.json_arrays import array_records

ODD = [{"a": 1}, {"t": 'brace } and { in "text" \\'}, {"n": {"x": {"y": [1, {"z": "}"}]}}, "t": "\\\\"}, {"t": "ünï}😀{"}, {}, {"long": "}{" * 700}]


@pytest.fixture
def splits(spark):
    """Sets the size of the splits; the session's own comes back afterwards."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def size(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield size
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [37, 400, 1 << 20])
def test_records_are_whole_in_splits_of_any_size(spark, tmp_path, splits, size, indent):
    draw = random.Random(size)
    files = [[draw.choice(ODD) for _ in range(n)] for n in (0, 1, 25)]
    for i, rows in enumerate(files):
        (tmp_path / f"f{i}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=i == 0) + "\n" * i)
    (tmp_path / "single.json").write_text(json.dumps(ODD[2]))
    splits(size)
    found = array_records(spark, str(tmp_path))
    got = sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in found.collect())
    assert got == sorted(json.dumps(r, sort_keys=True) for r in [*sum(files, []), ODD[2]])
    if size == 400:
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 10


def test_broken_arrays_are_refused(spark, tmp_path, splits):
    from larder.schemas import FILE_SCHEMAS

    name = FILE_SCHEMAS["purchase_orders"].names[0]
    whole = '[{"%s": "p1"}, {"%s": "p2"}]' % (name, name)
    splits(16)
    for i, text in enumerate([whole[:-1][:-1], whole.replace("}, {", "}, 7, {"), whole + "}", whole.replace('"p1"', '"p1')]):
        path = tmp_path / f"b{i}.json"
        path.write_text(text)
        with pytest.raises(Exception):
            read_json_records(spark, str(path), "purchase_orders").collect()
        loose = read_json_records(spark, str(path), "purchase_orders", strict=False)
        assert any(r["_corrupt_record"] for r in loose.collect())
    good = tmp_path / "good.json"
    good.write_text(whole)
    assert sorted(r[name] for r in read_json_records(spark, str(good), "purchase_orders").collect()) == ["p1", "p2"]
