import numpy as np
import pytest

from geoweft.operators import index

from .oracles import cloud

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 9, 10, 11, 17, 18])
@pytest.mark.parametrize("dims", [2, 3])
def test_tree(spark, n, dims):
    xyz = RNG.random((n, dims))
    points = cloud(spark, xyz)
    order = [r.pid for r in index.morton_order(points).orderBy("leaf_pos").collect()]
    assert sorted(order) == list(range(n))
    nodes = index.tree_nodes(points)
    rows = {(r.level, r.j): r for r in nodes.collect()}
    meta = index.tree_metadata(points).first()
    assert len(rows) == meta.num_real_nodes and sorted(r.mem_idx for r in rows.values()) == list(range(len(rows)))
    names = "xyz"[:dims]
    for (level, j), r in rows.items():
        lo, hi = (np.array([r[f"{s}_{a}"] for a in names]) for s in ("lo", "hi"))
        width = 1 << (meta.leaf_level - level)
        own = xyz[order[j * width : (j + 1) * width]]
        np.testing.assert_array_equal(lo, own.min(axis=0))
        np.testing.assert_array_equal(hi, own.max(axis=0))
    links = {r.mem_idx: r for r in index.tree_links(nodes).collect()}
    assert sum(r.mem_to_leaf >= 0 for r in links.values()) == n
    for (level, j), r in rows.items():
        child = rows.get((level + 1, 2 * j))
        assert links[r.mem_idx].left_child_mem == (child.mem_idx if child else -1)


def test_codes(spark):
    rows = [[0.0, 0, 0], [1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]]
    codes = {r.pid: r.code for r in index.morton_encode(cloud(spark, rows)).collect()}
    ones = sum(1 << (3 * k) for k in range(10))
    assert codes == {0: 0, 1: (1 << 30) - 1, 2: ones, 3: ones << 1, 4: ones << 2}
    flat = index.morton_encode(cloud(spark, [[0.0, 5], [1, 5]])).orderBy("pid").collect()
    assert [r.code for r in flat] == [0, sum(1 << (2 * k) for k in range(16))]
