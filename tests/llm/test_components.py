import numpy as np

from tessera.llm.components import components


def test_long_chains_of_shuffled_ids(spark):
    rng = np.random.RandomState(3)
    ids = [int(x) for x in rng.permutation(2000) + 5]
    chains = [ids[:1000], ids[1000:1990], ids[1990:1992]]
    links = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: min(c) for c in chains for i in c}
