import random

import pytest

from auralake.operators import models
from auralake.streaming.generation import generate_long_stream


class Halves:
    """As many ids as half of the prompt, told by all of it; none at all for some prompts."""

    def generate(self, prompts, **options):
        out = []
        for p in prompts:
            seed = sum((i + 1) * x for i, x in enumerate(p)) + options.get("seed", 0)
            out.append([] if seed % 7 == 0 else [(seed * (i + 3)) % 1009 for i in range(len(p) // 2)])
        return out


def make():
    return Halves()


@pytest.mark.parametrize("most, overlap, prompt", [(10, 4, ([], [])), (7, 0, ([1], [2, 3]))])
def test_equals_the_batch_form_over_restarts(spark, tmp_path, most, overlap, prompt):
    rng, pieces, sources = random.Random(most), [], {}
    for key in [*"abcdef", "whole", "step", "none"]:
        ids = [rng.randrange(500) for _ in range({"whole": most * 3, "step": most + 2 * (most - overlap), "none": 0}.get(key, rng.randrange(1, 60)))]
        sources[key] = ids
        cuts = sorted(rng.randrange(len(ids) + 1) for _ in range(rng.randrange(4)))
        parts = [ids[i:j] for i, j in zip([0, *cuts], [*cuts, len(ids)])]
        pieces += [(key, n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    rng.shuffle(pieces)
    pieces += pieces[:5]  # some come twice
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    how = dict(key="k", make=make, most=most, overlap=overlap, marks=(900, 901, 902), limit=40, prompt=prompt, seed=5)
    for n in range(3):
        rows = pieces[n * len(pieces) // 3 : (n + 1) * len(pieces) // 3]
        spark.createDataFrame(rows, "k string, piece int, ids array<int>, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = generate_long_stream(spark.readStream.schema("k string, piece int, ids array<int>, last boolean").parquet(str(tmp_path / "in")), **how)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.k, r.chunk))
    got = {k: [i for r in rows if r.k == k for i in r.target] for k in sources}
    batch = spark.createDataFrame(list(sources.items()), "k string, ids array<int>")
    want = {r.k: list(r.target) for r in models.generate_long(batch, "k", "ids", **{a: b for a, b in how.items() if a != "key"}).collect()}
    assert got == want
    assert sorted(r.k for r in rows if r.done) == sorted(sources)
    assert all([r.chunk for r in rows if r.k == k] == list(range(sum(r.k == k for r in rows))) for k in sources)
