"""Rounds of packing go on while they gain."""

import numpy as np

from docloom.llm import packing
from docloom.llm.common import written


def test_rounds_go_on_while_they_gain(spark, monkeypatch):
    lengths = np.random.default_rng(5).integers(20, 60, 12000)
    items = written(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "slot long, length long"), "items")
    rounds, plain = [], packing._packed_groups

    def counted(pool, number, groups, capacity):
        out = written(plain(pool, number, groups, capacity), "counted")
        rounds.append((number, out.where("offset = 0").count()))
        return out

    monkeypatch.setattr(packing, "_packed_groups", counted)
    packed = packing.pack(items, capacity=100, group=12).collect()
    assert sorted(r.slot for r in packed) == list(range(12000))
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, int(lengths[r.slot])))
    assert all(sum(n for _, n in parts) <= 100 and max(o + n for o, n in parts) <= 100 for parts in used.values())
    assert len(rounds) > 5, rounds
