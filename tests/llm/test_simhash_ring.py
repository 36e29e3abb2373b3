"""Fingerprint links for every limit, and what the chains of segments prune."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import links, simhash

from .test_llm import plain_groups


def crowd(seed, bits):
    """Fingerprints up to ``bits`` flips around a few roots that share most of their bits."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2 ** 63))
    roots = [base ^ (int(x) << 40) for x in rng.integers(0, 2 ** 20, 5)]
    out = set(roots)
    for r in roots:
        for _ in range(30):
            out.add(r ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(1, bits + 1)).tolist())))
    return dict(enumerate(sorted(out)))


@pytest.mark.parametrize("limit", [0, 5, 64])
@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4])
def test_every_limit(spark, max_bits, limit):
    """Segments shared by more fingerprints than ``limit`` take the way without pairs."""
    nodes = crowd(max_bits, max(max_bits, 1) + 1)
    table = spark.createDataFrame(list(nodes.items()), "node bigint, fp bigint")
    got = {r["node"]: r["component"] for r in links.components(simhash.pigeonring_links(table, max_bits, limit)).collect()}
    assert {k: got.get(k, k) for k in nodes} == plain_groups(nodes, max_bits)


@pytest.mark.parametrize("max_bits", [2, 3, 4])
def test_chains_prune_before_the_full_comparison(spark, max_bits):
    rng = np.random.default_rng(3)
    near = crowd(9, 6)
    nodes = near | {len(near) + i: int(x) for i, x in enumerate(rng.integers(0, 2 ** 63, 3000))}
    table = spark.createDataFrame(list(nodes.items()), "node bigint, fp bigint")
    keyed = table.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("s"))
                                                           for i, (_, m, _) in enumerate(simhash._ring(max_bits))])).alias("k")).select("node", "fp", "k.i", "k.s")
    pairs = simhash.sharing_pairs(keyed).persist()
    shared, left = pairs.count(), pairs.where(simhash.chains_hold(max_bits)).count()
    within = {(r["a"], r["b"]) for r in pairs.where(simhash.chains_hold(max_bits)).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits).collect()}
    pairs.unpersist()
    ids = sorted(near)
    want = {(a, b) for a in ids for b in ids if a < b and (nodes[a] ^ nodes[b]).bit_count() <= max_bits}
    assert want <= within and all((nodes[a] ^ nodes[b]).bit_count() <= max_bits for a, b in within)  # nothing within the limit is lost
    assert len(within) <= left < shared / 3
