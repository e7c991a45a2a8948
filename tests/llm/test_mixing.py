import random
import re
from collections import defaultdict

from probewise.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return target


def check(docs, out, block=mixing.BLOCK):
    sizes, rows = defaultdict(int), docs.collect()
    for r in rows:
        sizes[r.source] += len(re.findall("[^ \t-\r]+", r.text or ""))
    got = out.collect()
    assert len(got) == len(rows)
    target, taken = plain_targets(sizes), defaultdict(int)
    of_source = {s: set() for s in sizes}
    for r in got:
        source = r.row["source"]
        of_source[source].add((r.target, r.source_size))
        taken[source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        (aim, size), = of_source[s]
        assert size == sizes[s] and abs(aim - target[s]) < 1e-6 * max(1, target[s])
        assert abs(taken[s] - aim) <= 0.5


def test_odd_rows(odd):
    check(odd, mixing.mixed(odd, carry=odd.columns))


def test_without_rows(none):
    assert mixing.mixed(none).collect() == []


def test_many_sources_of_uneven_size_reach_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(0.8)), None if s == 40 else f"s{s}")
            for i, s in enumerate(rng.choices(range(41), [100] + [1] * 40, k=3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs, mixing.mixed(docs, carry=docs.columns))
    once, again = (sorted(mixing.mixed(docs.repartition(n)).select("doc_id", "taken").collect()) for n in (3, 7))
    assert once == again


def test_schedule_spreads_the_turns_of_each_source(spark):
    needs = {1: 500, 2: 30, 3: 7, 4: 463}
    sources = spark.createDataFrame(list(needs.items()), "rank int, needs long")
    rows = mixing.schedule(sources, 1000, step=64).collect()
    assert len(rows) == 1000 and len({r.slot for r in rows}) == 1000
    for rank, n in needs.items():
        slots = sorted(r.slot for r in rows if r["rank"] == rank)
        assert sorted((r.turn for r in rows if r["rank"] == rank)) == list(range(len(slots)))
        for upto in (100, 250, 1000):
            assert abs(sum(s < upto for s in slots) - upto * n / 1000) <= 7
