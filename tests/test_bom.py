"""Component lists of unknown depth, and cycles in them."""

from __future__ import annotations

import pytest

from larder.operators import bom

SHAPE = "parent_sku string, component_sku string, quantity_per int"
CASES = {
    "chain": [(f"s{i}", f"s{i + 1}", 2) for i in range(7)],
    "diamond": [("a", "b", 2), ("a", "c", 3), ("b", "d", 5), ("c", "d", 7), ("d", "e", 1)],
    "cycles": [("a", "b", 2), ("b", "c", 3), ("c", "a", 1), ("c", "d", 4), ("d", "d", 2), ("b", "a", 1)],
    "odd": [("a", "b", 2), ("a", "b", 3), (None, "b", 1), ("b", None, 1), ("b", "c", None)],
    "none": [],
}


def plain(edges):
    """All paths and cycles by a walk from every parent."""
    edges = [e for e in edges if e[0] is not None and e[1] is not None]
    paths, cycles = [], set()

    def walk(path, needed):
        for parent, part, each in edges:
            if parent != path[-1]:
                continue
            total = None if needed is None or each is None else needed * each
            if part in path:
                if part == path[0] == min(path):
                    cycles.add(tuple(path))
                continue
            paths.append((path[0], part, len(path), total))
            walk([*path, part], total)

    for root in sorted({e[0] for e in edges}):
        walk([root], 1.0)
    return sorted(paths, key=str), sorted(cycles)


@pytest.mark.parametrize("case", CASES)
def test_paths_and_cycles_equal_a_plain_walk(spark, case):
    tables = {"bom": spark.createDataFrame(CASES[case], SHAPE)}
    paths, cycles = plain(CASES[case])
    assert sorted(map(tuple, bom.bom_paths(tables).collect()), key=str) == paths
    assert sorted(tuple(r.cycle.split(" > ")) for r in bom.bom_cycles(tables).collect()) == cycles
