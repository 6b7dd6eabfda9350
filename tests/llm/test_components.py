import random

from vectide.llm.components import connected_components


def plain(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_paths_hubs_and_random_graphs(spark):
    rng = random.Random(9)
    order = list(range(1000, 1120))
    rng.shuffle(order)
    links = list(zip(order, order[1:]))  # a path in random order
    links += [(5000, k) for k in range(5001, 5400)] + [(6000 - k, 6001) for k in range(1, 300)]  # hubs, smallest and largest
    links += [(rng.randrange(-300, 0), rng.randrange(-300, 0)) for _ in range(200)]
    links += [(7, 8), (8, 7), (7, 8), (9, 9), (None, 10), (10, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = plain(links)
    roots = {k: v for k, v in expected.items() if k != v}
    assert got == roots


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b").count() == 0
