import itertools
import random

from tidemill.llm import packing
from tidemill.llm.packing import bucket_boundaries, pack, plan


def padding(histogram, edges):
    return sum(n * (min(e for e in edges if e >= s) - s) for s, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(20):
        histogram = {s: rng.randint(1, 9) for s in rng.sample(range(1, 60), 8)}
        sizes = sorted(histogram)
        for k in (1, 2, 3, 9):
            best = min(padding(histogram, [*c, sizes[-1]]) for r in range(k) for c in itertools.combinations(sizes[:-1], r))
            edges = bucket_boundaries(histogram, k)
            assert len(edges) <= k and padding(histogram, edges) == best
    assert bucket_boundaries({}, 3) == []


def test_plan_fills_without_overflow():
    rng = random.Random(1)
    for _ in range(30):
        capacity = rng.randint(5, 40)
        histogram = {s: rng.randint(1, 30) for s in rng.sample(range(1, capacity + 1), min(capacity, 9))}
        runs, made = plan(histogram, capacity, bucket_boundaries(histogram, 4))
        fill, count = [0] * made, dict.fromkeys(histogram, 0)
        for size, low, high, first, each, _ in runs:
            for rank in range(low, high):
                fill[first + (rank - low) // each] += size
                count[size] += 1
        assert count == histogram and max(fill) <= capacity and min(fill) > 0
        assert made <= 1.25 * sum(s * n for s, n in histogram.items()) / capacity + 1.25 * sum(n for s, n in histogram.items() if 2 * s > capacity) + 2


def batches(histogram, capacity, edges):
    """Containers as {container: [(size, pieces, bucket that formed it)]}."""
    out = {}
    for size, low, high, first, each, bucket in plan(histogram, capacity, edges)[0]:
        for c in range(first, first - (low - high) // each):
            out.setdefault(c, []).append((size, each, bucket))
    return out


def test_boundaries_form_the_batches():
    """Padding of the batches' own pieces is what the boundaries make it, and other boundaries give other containers."""
    rng = random.Random(4)
    capacity, histogram = 1000, {}
    for _ in range(4000):
        size = min(1000, max(1, int(rng.choice([rng.gauss(40, 6), rng.gauss(130, 15), rng.expovariate(1 / 300)]))))
        histogram[size] = histogram.get(size, 0) + 1
    best, top = bucket_boundaries(histogram, 8), max(histogram)
    results = {}
    for name, edges in (("best", best), ("even", sorted({-(-top * (i + 1) // 8) for i in range(8)})), ("one", [top])):
        made = batches(histogram, capacity, edges)
        bounds = list(zip([0, *edges], edges))
        padded = sum(n * (bounds[b][1] - s) for pieces in made.values() for s, n, b in pieces if s > bounds[b][0])
        assert all(s <= bounds[b][1] for pieces in made.values() for s, _, b in pieces)
        used = sum(s * n for s, n in histogram.items()) / (capacity * len(made))
        results[name] = (padded, used, {c: sorted(p) for c, p in made.items()})
    assert results["best"][0] < 0.7 * results["even"][0] and results["best"][0] < 0.3 * results["one"][0]
    assert results["best"][1] > 0.98 and len({str(r[2]) for r in results.values()}) == 3


def test_the_sweep_equals_the_plain_programme_on_many_sizes():
    rng = random.Random(5)
    histogram = {s: rng.randint(1, 50) for s in range(1, 400)}
    sizes = sorted(histogram)
    count = [sum(histogram[s] for s in sizes[:j]) for j in range(len(sizes) + 1)]
    total = [sum(histogram[s] * s for s in sizes[:j]) for j in range(len(sizes) + 1)]
    best = [0] + [10**12] * len(sizes)
    for _ in range(5):
        best = [0] + [min(best[i] + (count[j] - count[i]) * sizes[j - 1] - total[j] + total[i] for i in range(j)) for j in range(1, len(sizes) + 1)]
    assert padding(histogram, bucket_boundaries(histogram, 5)) == best[-1]


def check(spark, sizes, capacity=10):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint")
    rows = pack(df, "doc_id", "tokens", capacity, 3).collect()
    assert len({(r["container"], r["bucket"]) for r in rows if r["tokens"]}) == len({r["container"] for r in rows if r["tokens"]})
    fill, total = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        total.setdefault(r["doc_id"], []).append((r["part"], r["tokens"]))
    assert all(f <= capacity for f in fill.values())
    for i, size in enumerate(sizes):
        parts = sorted(total[i])
        assert sum(t for _, t in parts) == size and len(parts) == max(1, -(-size // capacity))
        assert all(t == capacity for _, t in parts[:-1])
    return fill


def test_corpus(spark):
    rng = random.Random(2)
    fill = check(spark, [rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 10, 23, 40]) for _ in range(300)])
    assert sum(fill.values()) / (10 * len(fill)) > 0.95


def test_edges(spark, monkeypatch):
    check(spark, [0, 0, 0])
    check(spark, [4] * 200)  # one hot length
    monkeypatch.setattr(packing, "PART", 7)
    check(spark, [4] * 200 + [1, 2, 3, 0, 0, 0, 0] * 9)
    check(spark, [10, 20, 30])
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), "doc_id", "tokens").count() == 0
