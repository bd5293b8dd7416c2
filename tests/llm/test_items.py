"""Benchmark items whose ids repeat, clash or are missing."""

import random

from fleetfold.llm import decontaminate


def test_items_with_repeated_conflicting_and_null_ids(spark):
    rng = random.Random(4)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    twice, first, second, unnamed, other = (text(40) for _ in range(5))
    stretches = [twice[i : i + 8] for i in range(0, 40, 8)]
    rng.shuffle(stretches)
    shuffled = [w for s in stretches for w in s + text(1)]
    items = [(1, twice), (1, twice), (2, first), (2, second), (None, unnamed), (None, other)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(1, None), (None, None)], "item_id LONG, text STRING")
    docs = {1: shuffled, 2: text(9) + first, 3: second + text(9), 4: text(50), 5: text(3) + unnamed, 6: other, 7: first[:36] + second}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(None, " ".join(twice))], "doc_id LONG, text STRING")
    found = decontaminate.contaminated(table, bench).collect()
    got = sorted((str(r.doc_id), str(r.item_id), r.coverage) for r in found)
    want = [("1", "1"), ("2", "2"), ("3", "2"), ("5", "None"), ("6", "None"), ("7", "2"), ("None", "1")]
    assert got == [(*w, 1.0) for w in want]
    assert [r.doc_id for r in decontaminate.decontaminated(table, bench).collect()] == [4]
