import random

from palaver.llm.components import components


def test_long_chains(spark):
    """More hops between clusters than the 64 rounds that once were the most."""
    rnd = random.Random(0)
    ids = rnd.sample(range(10**9), 3500)
    chain, thick, pair = ids[:1500], ids[1500:3498], ids[3498:]
    links = list(zip(chain, chain[1:])) + [(a, thick[j]) for i, a in enumerate(thick) for j in range(i + 1, min(i + 9, len(thick)))] + [tuple(pair), (pair[0], None), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {7: 7} | {x: min(part) for part in (chain, thick, pair) for x in part}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
