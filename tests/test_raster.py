"""Runs, components, neighbourhoods and contraction against small hand-made and random rasters."""

import random
import time

import numpy as np
import pytest

from isobath.operators import contraction, graph, neighbourhood, regions, runs
from isobath.operators.graph import components
from isobath.operators.verify import mask_difference


def grid(spark, text):
    rows = [(x, z, c) for z, line in enumerate(text.split("/")) for x, c in enumerate(line) if c != "."]
    return spark.createDataFrame(rows, "x int, z int, key string")


@pytest.mark.parametrize(("text", "sizes"), [("ww.ww/ww.ww/...../wwwww", [4, 4, 5]), ("aaabbb/aaabbb", [6, 6]), ("w.w/w.w/www", [7])])
def test_components_of_small_grids(spark, text, sizes):
    labelled = runs.label(grid(spark, text), "key")
    assert sorted(r.area for r in runs.measures(labelled, "component").collect()) == sizes


def test_canonical_ids_follow_first_cells(spark):
    own = runs.canonical(runs.label(grid(spark, "a.b/..b/c.."), "key"))
    assert {r.key: r.id for r in own.select("key", "id").distinct().collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize(("second", "weight"), [((0, 4, 5), 1), ((0, 5, 6), None), ((1, 4, 9), None), ((1, 0, 9), 4)])
def test_adjacency_weights(spark, second, weight):
    rows = spark.createDataFrame([(1, 0, 0, 3), (2, *second)], "region_id long, z int, x0 int, x1 int")
    assert [r.w for r in runs.adjacency(rows).collect()] == ([weight] if weight else [])


def test_wide_runs_span_buckets(spark):
    rows = spark.createDataFrame([(1, 0, -200, 300), (2, 1, -100, 100)], "region_id long, z int, x0 int, x1 int")
    assert [tuple(r) for r in runs.adjacency(rows).collect()] == [(1, 2, 201)]


def test_perimeters(spark):
    rows = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 2), (2, 9, 5, 5)], "region_id long, z int, x0 int, x1 int")
    assert {r.region_id: (r.area, r.perimeter) for r in runs.perimeters(rows).collect()} == {1: (6, 10), 2: (1, 4)}


def test_distance_density_and_components_match_brute_force(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((40, 150)) < 0.7
    z, x = np.nonzero(mask)
    columns = spark.createDataFrame([(int(a) - 75, int(b) - 20) for a, b in zip(x, z, strict=True)], "x int, z int")
    dry = np.pad(mask, 1)
    dz, dx = np.nonzero(~dry)
    expected = {(int(a) - 75, int(b) - 20): int((abs(dx - 1 - a) + abs(dz - 1 - b)).min()) for a, b in zip(x, z, strict=True)}
    assert {(r.x, r.z): r.distance for r in neighbourhood.shore_distance(columns).collect()} == expected
    wide = np.pad(mask, 8)
    counts = {(int(a) - 75, int(b) - 20): int((wide[b : b + 17, a : a + 17].sum() * 255 + 144) // 289) for a, b in zip(x, z, strict=True)}
    assert {(r.x, r.z): r.d8 for r in neighbourhood.density(columns, (8,)).collect()} == counts
    labelled = runs.label(columns)
    assert mask_difference(columns, labelled).first().asDict() == {"columns": len(x), "lost": 0, "gained": 0, "overlaps": 0}


def test_majority_keeps_ties_and_frozen_cells(spark):
    cells = spark.createDataFrame([(0, 0, "a", False), (1, 0, "b", False), (2, 0, "b", False), (9, 9, "a", True), (10, 9, "b", False), (11, 9, "b", False)], "x int, z int, code string, still boolean")
    got = {(r.x, r.z): r.code for r in neighbourhood.majority(cells, frozen="still").collect()}
    assert got == {(0, 0): "a", (1, 0): "b", (2, 0): "b", (9, 9): "a", (10, 9): "b", (11, 9): "b"}


def test_components_of_random_graphs(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = list(range(60))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    for parts, lot in ((1, graph.LOT), (7, graph.LOT), (3, 8)):
        monkeypatch.setattr(graph, "LOT", lot)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(parts), "a", "b").collect()}
        assert got == {i: top(i) for e in edges if e[0] != e[1] for i in e}
    chain = spark.range(0, 3000).selectExpr("cast(id as string) a", "cast(id + 1 as string) b").repartition(9)
    assert components(chain, "a", "b").select("component").distinct().collect() == [("0",)]
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _absorbed(sizes, kinds, caves, edges, least):
    a, b, w = (np.array([e[k] for e in edges], int) for k in range(3))
    group, donor = contraction.absorb(np.array(sizes), np.array(kinds), np.array(caves, bool), a, b, w, least)
    return group.tolist(), donor.tolist()


def _consolidated(areas, edges, limit):
    a, b, w = (np.array([e[k] for e in edges], int) for k in range(3))
    return contraction.consolidate(np.array(areas), a, b, w, np.full(len(areas), limit))[0].tolist()


def test_absorption_rules():
    assert _absorbed([10, 100], [0, 0], [False, False], [(0, 1, 1)], 1)[1] == [1, 1]
    assert len(set(_absorbed([50, 100], [0, 0], [False, False], [(0, 1, 1)], 1)[0])) == 2
    assert len(set(_absorbed([10, 100], [0, 1], [False, False], [(0, 1, 1)], 1)[0])) == 2
    assert _absorbed([10, 100], [0, 1], [False, False], [(0, 1, 1)], 20)[1] == [1, 1]
    assert len(set(_absorbed([10, 100], [0, 0], [True, False], [(0, 1, 1)], 20)[0])) == 2
    assert len(set(_absorbed([5000, 50000], [0, 0], [False, False], [(0, 1, 1)], 9999)[0])) == 2


def test_consolidation_rules():
    assert _consolidated([4999, 5000], [(0, 1, 3)], 5000) == [1, 1]
    assert _consolidated([5000, 6000], [(0, 1, 3)], 5000) == [0, 1]
    assert _consolidated([10, 10], [(0, 1, 3)], 50) == [1, 1]
    assert len(set(_consolidated([1] * 40, [(i, i + 1, 1) for i in range(39)], 100))) == 1


class Groups:
    """One region after another, by the words of the rules: sets of members, contacts summed anew whenever they are asked."""

    def __init__(self, sizes, edges):
        self.members = {i: {i} for i in range(len(sizes))}
        self.size, self.edges = dict(enumerate(sizes)), edges

    def of(self, i):
        return next(k for k, m in self.members.items() if i in m)

    def contacts(self, k):
        out = {}
        for a, b, w in self.edges:
            a, b = self.of(a), self.of(b)
            if a != b and k in (a, b):
                out[a + b - k] = out.get(a + b - k, 0) + w
        return out

    def join(self, gone, stays):
        self.members[stays] |= self.members.pop(gone)
        self.size[stays] += self.size.pop(gone)


def one_by_one(areas, edges, limit):
    g, alone = Groups(areas, edges), set()
    while small := [(g.size[k], k) for k in g.members if g.size[k] < limit and (g.size[k], k) not in alone]:
        size, k = min(small)
        options = [(w, g.size[o], -o) for o, w in g.contacts(k).items() if g.size[o] >= size]
        if options:
            g.join(k, -max(options)[2])
        else:
            alone.add((size, k))
    return [g.of(i) for i in range(len(areas))]


def absorbed_one_by_one(sizes, kinds, caves, edges, least):
    g = Groups(sizes, edges)
    says = {i: (i, kinds[i], caves[i]) for i in range(len(sizes))}
    name, depth = {i: i for i in range(len(sizes))}, dict.fromkeys(range(len(sizes)), 0)
    for _ in range(contraction.ABSORB_ROUNDS):
        # groups are keyed by a member; seen: what each group touched when the round began, by name
        seen = {name[k]: {name[o]: w for o, w in g.contacts(k).items()} for k in g.members}
        order = sorted((name[k] for k in g.members if g.size[k] < contraction.ABSORB_BELOW), key=lambda n: ({name[k]: g.size[k] for k in g.members}[n], n))
        done = False
        for n in order:
            k = g.of(n)
            if name[k] != n or g.size[k] >= contraction.ABSORB_BELOW:
                continue
            options = []
            for other, w in seen[n].items():
                o = g.of(other)
                if o != k and says[o][2] == says[k][2] and (g.size[k] < least or g.size[o] >= 4 * g.size[k] and says[o][1] == says[k][1]):
                    options.append((w, g.size[o], -name[o], o))
            if options:
                o = max(options)[3]
                keeps = name[o] if depth[k] < depth[o] else n
                deep = max(depth[k], depth[o]) + (depth[k] == depth[o])
                said = says[o] if g.size[o] >= g.size[k] else says[k]
                g.join(k, o)
                name[o], depth[o], says[o], done = keeps, deep, said, True
        if not done:
            break
    return [name[g.of(i)] for i in range(len(sizes))], [says[g.of(i)][0] for i in range(len(sizes))]


def test_turns_taken_at_once_are_turns_taken_one_by_one():
    own = np.random.default_rng(1)
    for _ in range(120):
        n, most = int(own.integers(2, 26)), int(own.choice([4, 20, 6000]))
        edges = [tuple(e) for e in np.stack([own.integers(0, n, 2 * n), own.integers(0, n, 2 * n), own.integers(1, 4, 2 * n)], 1).tolist() if e[0] != e[1]] or [(0, 1, 1)]
        sizes, kinds, caves = own.integers(1, most, n).tolist(), own.integers(0, 3, n).tolist(), (own.random(n) < 0.2).tolist()
        limit = int(own.integers(1, 3 * most))
        assert _consolidated(sizes, edges, limit) == one_by_one(sizes, edges, limit)
        assert _absorbed(sizes, kinds, caves, edges, limit) == absorbed_one_by_one(sizes, kinds, caves, edges, limit)


def test_absorption_by_a_hub_is_not_a_pass_over_all_regions_a_turn():
    n = 40_000
    size = np.concatenate([[5000], np.ones(n, int)])
    began = time.process_time()
    group, donor = contraction.absorb(size, np.zeros(n + 1, int), np.zeros(n + 1, bool), np.zeros(n, int), np.arange(1, n + 1), np.ones(n, int), 6)
    assert len(set(group.tolist())) == 1 and not donor.any()
    assert time.process_time() - began < 10


def test_contraction_of_parts(spark):
    nodes = spark.createDataFrame([(1, 10, 0, False), (2, 100, 0, False), (3, 7, 1, False)], "id long, size long, kind int, cave boolean")
    edges = spark.createDataFrame([(1, 2, 4)], "a long, b long, w long")
    assert {r.id: r.donor for r in contraction.absorb_regions(nodes, edges, 1).collect()} == {1: 2, 2: 2, 3: 3}


def test_sieve(spark):
    pixels = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 2, 50), (9, 9, 3, 1)], "px int, pz int, code int, weight long")
    assert {(r.px, r.pz): r.code for r in contraction.sieve(pixels, 10).collect()} == {(0, 0): 2, (1, 0): 2}


def test_lookup_and_index(spark):
    own = spark.createDataFrame([(0, 5, -70, 70), (1, 6, 0, 3)], "id long, z int, x0 int, x1 int")
    points = spark.createDataFrame([(-70, 5), (71, 5), (2, 6), (500, 500)], "x int, z int")
    assert {(r.x, r.z): r.id for r in regions.lookup(points, own).collect()} == {(-70, 5): 0, (71, 5): None, (2, 6): 1, (500, 500): None}


def test_sea_level_fallbacks(spark):
    level = lambda rows: regions.sea_level(spark.createDataFrame(rows, "y int, ocean_n long, all_n long")).first().sea_level
    assert level([(62, 20_000, 20_000), (40, 100, 100)]) == 63
    assert level([(40, 0, 20_000)]) == 41
    assert level([(62, 10, 10)]) == 63
    assert level([(y, 1000, 1000) for y in range(40, 60)]) == 63


def test_region_pipeline_joins_regions_once(spark, monkeypatch):
    from isobath.plans import queries

    seen, joined = spark.sparkContext.accumulator(0), contraction.absorb_regions

    def counted(*rows):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return joined(*rows).mapInArrow(run, "id long, group long, donor long")

    monkeypatch.setattr(contraction, "absorb_regions", counted)
    folder = "/root/testdata/sf0.001"
    queries.region_pipeline(spark, folder).collect()
    assert seen.value == queries.component_bbox_area(spark, folder).count()
